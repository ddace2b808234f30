"""N-gram Jaccard join with prefix filters under several global token orders.

A document's set holds its distinct shingles of ``K`` words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased); with fewer words
the whole sequence is its one shingle. Two sets link when the Jaccard similarity is ``NUM / DEN`` or more. A set of n
tokens shares at least ceil(n * NUM / DEN) of them with any partner, so under any order of all tokens the first
n - ceil(n * NUM / DEN) + 1 tokens of both sets have one in common. Orders here begin with the document frequency, so a
token of one set alone comes first in each, and differ in how they arrange equal or similar frequencies. A candidate
pair must share a prefix token under every order; only then are the sets compared.

How it runs:

1. ``token_table`` counts shingles and gives each document its shared tokens and prefixes. A set without enough shared
   tokens is finished here.
2. Equal sets form a class with one representative.
3. Links between representatives: in a first round every document is compared with the hub that it meets at the most
   prefix tokens, which joins large groups of near copies without all their pairs; in later rounds those outside of the
   largest component of a token with several of its members, until a round finds nothing. A last round compares all
   holders of a token whose components still differ, so no link between components is missed. Length, positional and
   sketch filters come before every comparison.
4. Components of the links by alternating stars, after each round over the components found so far.

Null text, no words: an empty set, which links with nothing. A null id gets the smallest id of its component, null when
alone. Repeated rows and ids are separate documents that meet through their sets. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.components import components
from sensorloom.llm.token_table import DEN, NUM, K, may_be_similar, token_table
from sensorloom.session import discard, written

#: Parts a token's holders are dealt over before they meet its hub.
SALTS = 16
#: Rounds of hubs at most before the last one; they end early when one finds no link.
TURNS = 3
#: Prefix tokens from each end that look for first hubs.
ENDS = 4
#: Hubs of a token in the later rounds, and how many of all that it meets a document is compared with.
HUBS, COMPARED = 6, 8
#: Words of 64 bits that sketch a set.
SKETCH = 4
_BITS = [f"s{j}" for j in range(SKETCH)]
#: A list of documents to drop (24 bytes each) that may be sent to all tasks.
BROADCAST = 500_000


def _holders(reps: DataFrame, labels: DataFrame | None, ends: tuple[int, int] | None = None) -> DataFrame:
    """(token, own: key, label, n, left, alone) for each prefix token under the first order; ``left``: tokens from there on.

    ``ends`` (NUM, DEN): only of the first few of each prefix, and of the last few where a partner of equal size can still
    be met, which is enough to look for first hubs: the rarest bring together the closest copies, the most frequent whole
    groups. Labels meet documents before the explode.
    """
    slim = reps.select("key", "n", "m", "p1", *_BITS)
    if labels is not None:
        slim = slim.join(labels.withColumnRenamed("node", "key"), "key", "left")
    label = F.coalesce("root", "key") if labels is not None else F.col("key")
    placed = F.transform("p1", lambda x, k: F.struct(k.alias("pos"), x.alias("token")))
    if ends:
        num, den = ends
        last = F.col("m") - F.ceil(2 * num * F.col("n") / (num + den))
        placed = F.filter(placed, lambda x: (x["pos"] < ENDS) | ((x["pos"] <= last) & (x["pos"] > last - ENDS)))
    rows = slim.select("key", label.alias("label"), "n", "m", *_BITS, F.explode(placed).alias("at")).select("key", "label", "n", "m", *_BITS, "at.pos", "at.token")
    alone = (F.col("n") - F.col("m")) / F.col("n")
    return rows.select("token", F.struct("key", "label", "n", (F.col("m") - F.col("pos")).alias("left"), alone.alias("alone"), *_BITS).alias("own"))


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    return may_be_similar(a, b, num, den, SKETCH) & (F.col(f"{a}.label") != F.col(f"{b}.label"))


def _first_hubs(holders: DataFrame, num: int, den: int) -> DataFrame:
    """One partner for each document: among the hubs of its tokens the one it meets at the most tokens.

    A token's hubs are its holders with the least share of tokens of their own, as the original of near copies has, and
    with the greatest. Holders are dealt over salted parts first; the hubs of the parts then meet those of the whole token.
    """
    key = F.xxhash64("own.key")
    salted = holders.withColumn("at", F.struct(F.col("own.alone").alias("l"), key.alias("k"), F.col("own").alias("hub"))).withColumn("salt", F.pmod(key, F.lit(SALTS)))
    part = Window.partitionBy("token", "salt")
    near = salted.select("own", F.min("at").over(part).alias("low"), F.max("at").over(part).alias("high"))
    tops = salted.groupBy("token", "salt").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    tops = tops.select("token", F.explode(F.array("low", "high")).alias("at"))
    whole = Window.partitionBy("token")
    far = tops.select(F.col("at.hub").alias("own"), F.min("at").over(whole).alias("low"), F.max("at").over(whole).alias("high"))
    met = near.unionByName(far).select("own", F.explode(F.array("low.hub", "high.hub")).alias("hub")).where(_may_link("own", "hub", num, den))
    return _most_met(met, 1)


def _most_met(met: DataFrame, most: int) -> DataFrame:
    """(a, b, la, lb): for each document those hubs, at most so many, that it meets at the most tokens."""
    counted = met.groupBy(F.col("own.key").alias("key"), F.col("own.label").alias("label"), F.col("hub.key").alias("hub"), F.col("hub.label").alias("hub_label")).agg(F.count("*").alias("c"))
    one = F.struct("c", F.xxhash64("hub").alias("h"), "hub", "hub_label")
    # A document has no more hubs than its prefix tokens have.
    best = counted.groupBy("key", "label").agg((F.array(F.max(one)) if most == 1 else F.slice(F.sort_array(F.collect_list(one), asc=False), 1, most)).alias("best"))
    best = best.select("key", "label", F.explode("best").alias("best"))
    return best.select(F.col("key").alias("a"), F.col("best.hub").alias("b"), F.col("label").alias("la"), F.col("best.hub_label").alias("lb"))


def _split(holders: DataFrame) -> DataFrame:
    """(token, own, most): holders of tokens with several labels, and the token's most frequent label."""
    sizes = holders.groupBy("token", F.col("own.label").alias("label")).agg(F.count("*").alias("c"))
    split = sizes.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    return holders.join(split.select("token", "most"), "token")


def _more_hubs(holders: DataFrame, turn: int, num: int, den: int) -> DataFrame:
    """Several partners for each document outside of its tokens' most frequent labels: hubs are holders that have those,
    by the least of several hashes of their number."""
    some = _split(holders)
    hash_of = lambda r: F.xxhash64("own.key", F.lit(turn), F.lit(r))
    hubs = some.where("own.label = most").groupBy("token").agg(*(F.min(F.struct(hash_of(r).alias("h"), F.col("own").alias("hub"))).alias(f"h{r}") for r in range(HUBS)))
    hubs = hubs.select("token", F.explode(F.array_distinct(F.array(*(F.col(f"h{r}.hub") for r in range(HUBS))))).alias("hub"))
    few = some.where("own.label <> most").select("token", "own")
    return _most_met(few.join(hubs, "token").where(_may_link("own", "hub", num, den)), COMPARED)


def _rest_pairs(holders: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of holders whose labels differ. Pairs inside a token's largest component are never made."""
    some = _split(holders)
    few = some.where("own.label <> most").select("token", F.col("own").alias("hub"))
    pairs = some.join(few, "token").where(_may_link("own", "hub", num, den) & F.expr("own.label = most or own.key < hub.key"))
    return pairs.select(F.least("own.key", "hub.key").alias("a"), F.greatest("own.key", "hub.key").alias("b"), F.least("own.label", "hub.label").alias("la"), F.greatest("own.label", "hub.label").alias("lb")).distinct()


def _verified(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that share a prefix token under every order and then have similar sets: their two labels.

    The prefixes of the second and third order meet first; whole sets are fetched for what passes both.
    """
    side = lambda c, *held: reps.select(F.col("key").alias(c), F.struct(*held).alias(f"r{c}"))
    narrow = pairs.join(side("a", "p2", "p3"), "a").join(side("b", "p2", "p3"), "b")
    narrow = narrow.where(F.arrays_overlap("ra.p2", "rb.p2") & F.arrays_overlap("ra.p3", "rb.p3")).select("a", "b", "la", "lb")
    both = narrow.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
    shared = F.size(F.array_intersect("ra.tokens", "rb.tokens")).cast("bigint")
    # Equal sets have one representative: where all tokens of two agree, it is by their shortened hashes only.
    other = (shared < F.col("ra.n")) | (shared < F.col("rb.n"))
    return both.where(other & (den * shared >= num * (F.col("ra.n") + F.col("rb.n") - shared))).select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of ``labels`` after links between them: for the documents that had one and for those that join now."""
    joined = components(links)
    if labels is None:
        return written(joined, "labels")
    moved = labels.join(joined.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    grown = written(moved.unionByName(joined.join(labels.select("node"), "node", "left_anti")), "labels")
    discard(labels, joined)
    return grown


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """A row for each document: id, n_shingles, component_id (smallest id reachable by links), first (one row of each
    component, that of the smallest id and key, and every document without words, is true), key (the row's number), print
    (a hash of its text)."""
    found = token_table(docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text")), k, num, den, sketch=SKETCH)
    full = found.where("n > 0")
    classes = full.groupBy("f1", "f2").agg(F.min("key").alias("rep"), F.min("id").alias("class_id"), F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("class_first"))
    reps = written(full.where("p1 is not null").join(classes.select(F.col("rep").alias("key")), "key", "left_semi").select("key", "n", "m", "tokens", "p1", "p2", "p3", *_BITS), "reps")
    labels = None
    for turn in range(TURNS):
        found_pairs = _more_hubs(_holders(reps, labels), turn, num, den) if turn else _first_hubs(_holders(reps, None, (num, den)), num, den)
        links = written(_verified(found_pairs, reps, num, den), "links")
        labels = _grown(labels, links)
        if links.isEmpty():
            break
    labels = _grown(labels, _verified(_rest_pairs(_holders(reps, labels), num, den), reps, num, den))
    classes = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    roots = classes.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("class_first").alias("first"))
    named = classes.select("f1", "f2", "root").join(roots, "root").select("f1", "f2", "component_id", F.col("first.key").alias("first_key"), F.lit(True).alias("linked"))
    out = found.select("key", "id", "print", "n", "f1", "f2").join(named, ["f1", "f2"], "left")
    alone = (F.col("n") == 0) | F.col("linked").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | (F.col("key") == F.col("first_key"))).alias("first"),
        "key",
        "print",
    )


def keep_firsts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: int) -> DataFrame:
    """``docs`` with all its columns, one document of each group: that of the smallest id (ids that are null last).

    Documents without words stay. Of rows equal in id and text one stays. A list of at most ``BROADCAST`` documents to
    drop is sent to all tasks; a longer one is joined by a shuffle.
    """
    same = similar_groups(docs, id_col, text_col, **more).groupBy(F.col(id_col).alias("id"), "print").agg(F.sum(F.col("first").cast("int")).alias("firsts"), F.count("*").alias("times"))
    less = written(same.where("firsts < times"), "copies")
    if less.count() <= BROADCAST:
        less = F.broadcast(less)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    own = F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(F.col("row")[text_col]) == F.col("print"))
    rest = rows.join(less, own, "left_anti").select("row.*")
    doubled = rows.join(less.where("firsts > 0"), own, "left_semi").select("row.*").dropDuplicates([id_col, text_col])
    return rest.unionByName(doubled)
