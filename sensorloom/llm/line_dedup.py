"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct shingles of ``K`` words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased). With fewer words the
whole sequence is its one token, so that such a line matches only its repeats. A line without words never matches. Two
lines match at a Jaccard similarity of ``NUM / DEN`` or more. Lines are ordered by document id (null first), a hash of the
document's text, and place. A line is removed when a line before it matches it, removed or not.

Lines with equal sets count once, by the first; two 64-bit prints of independent hashes tell them. The tokens of the
others are ordered by rarity (frequency over all lines, then a hash), so that only the first few of each line, its prefix,
are joined on; length, positional and sketch filters drop pairs before they are compared. Each line then meets the few
earlier lines that it shares the most prefix tokens with (of the first and of the nearest earlier holder of each token),
and those that are still undecided all earlier holders. So a large group of near copies doesn't make all its pairs. Tokens are shortened hashes while they look for partners only: a pair is
verified on the words of both lines.

Null text stays null, empty text empty; a text whose lines all go is empty. Rows equal in id and text are one document:
they lose the same lines. Other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.memory import trim
from sensorloom.llm.text import byte_values, space_words
from sensorloom.llm.token_table import DEN, NUM, K, may_be_similar, token_table
from sensorloom.session import discard, written

#: A list of lines up to this size (documents, lines) is sent to all tasks; a longer one is joined by a shuffle.
BROADCAST = (200_000, 2_000_000)
#: Holders of a token that look for their nearest earlier one in one group.
GROUP = 1_000
#: Of the earlier holders of its tokens that a line meets first, how many it is compared with.
COMPARED = 4
#: Words of 64 bits that sketch a set.
SKETCH = 2
_BITS = [f"s{j}" for j in range(SKETCH)]


def _order(side: str) -> Column:
    return F.struct(*(F.col(f"{side}{c}") for c in ("id", "print", "line")))


def _sent(lists: DataFrame) -> DataFrame:
    """A written table with ``lines`` for each document, marked for broadcast where it is short enough."""
    size = lists.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).head()
    return F.broadcast(lists) if size[0] <= BROADCAST[0] and size[1] <= BROADCAST[1] else lists


def _holders(reps: DataFrame) -> DataFrame:
    rows = reps.select("place", "key", "n", "m", "undecided", *_BITS, F.posexplode("p1").alias("pos", "token"))
    return rows.select("token", F.struct("place", "key", "n", (F.col("m") - F.col("pos")).alias("left"), "undecided", *_BITS).alias("own"))


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """b is earlier, and nothing yet tells them apart."""
    return may_be_similar(a, b, num, den, SKETCH) & (F.col(f"{b}.place") < F.col(f"{a}.place"))


def _most_met(met: DataFrame, most: int) -> DataFrame:
    """(a, b): for each line those of its hubs, at most so many, that it meets at the most tokens."""
    counted = met.groupBy(F.col("own.key").alias("a"), F.col("hub.key").alias("b")).agg(F.count("*").alias("c"))
    one = F.struct("c", "b")
    # A line has no more hubs than its prefix tokens have.
    best = counted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(one), asc=False), 1, most).alias("best"))
    return best.select("a", F.explode("best.b").alias("b"))


def _first_or_nearest(holders: DataFrame, num: int, den: int) -> DataFrame:
    tops = holders.groupBy("token").agg(F.min("own").alias("first"), F.count("*").alias("c")).where("c > 1")
    by = Window.partitionBy("token", F.pmod(F.xxhash64("own.key"), F.ceil(F.col("c") / GROUP))).orderBy("own.place")
    met = holders.join(tops, "token").select("own", "first", F.lag("own").over(by).alias("nearest")).select("own", F.explode(F.array("first", "nearest")).alias("hub"))
    return _most_met(met.where(_may_match("own", "hub", num, den)), COMPARED)


def _all_partners(holders: DataFrame, num: int, den: int) -> DataFrame:
    some = holders.where("own.undecided")
    other = holders.select("token", F.col("own").alias("hub"))
    return some.join(other, "token").where(_may_match("own", "hub", num, den)).select(F.col("own.key").alias("a"), F.col("hub.key").alias("b")).distinct()


def line_set(text: bytes, k: int = K) -> set[bytes]:
    """The shingles of a line as bytes."""
    words = space_words(text)
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


def _similar(k: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The lines ``a`` of pairs (a, x, y) whose texts x and y match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            match = []
            for x, y in zip(byte_values(batch["x"]), byte_values(batch["y"]), strict=True):
                one, two = line_set(x, k), line_set(y, k)
                shared = len(one & two)
                match.append(den * shared >= num * (len(one) + len(two) - shared))
            yield batch.select(["a"]).filter(pa.array(match, pa.bool_()))
        trim()

    return run


def _texts(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written row (key, text) for each line of ``reps``."""
    lists = _sent(written(reps.groupBy("place.id", "place.print").agg(F.collect_list(F.struct("place.line", "key")).alias("lines")), "wanted"))
    own = docs.select(F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    met = own.join(lists, F.col("own").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("print")))
    cut = met.select("lines", F.split("text", "\n").alias("cut"))
    rows = cut.select(F.explode(F.transform("lines", lambda x: F.struct(x["key"].alias("key"), F.get("cut", x["line"]).alias("text")))).alias("x")).select("x.*")
    return written(rows.groupBy("key").agg(F.first("text").alias("text")), "texts")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN) -> DataFrame:
    """A written row for each document with lines to remove: id, print (hash of its text), lines (places from 0)."""
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    found = token_table(rows, k, num, den, lines=True, width=5, orders=1, whole=False, sketch=SKETCH).withColumn("place", _order(""))
    classes = found.groupBy("f1", "f2").agg(F.min("place").alias("first"))
    # Only lines that go and lines that may have a near copy are needed from here on.
    named = found.join(classes, ["f1", "f2"]).where("place > first or (place = first and p1 is not null)")
    named = written(named.select("place", "first", "key", "n", "m", *_BITS, F.when(F.col("place") == F.col("first"), F.col("p1")).alias("p1")), "equal")
    # Equal sets: all but the first go. (Rows equal in id and text share their places.)
    reps = named.where("place = first and p1 is not null").groupBy("place").agg(F.min(F.struct("key", "n", "m", "p1", *_BITS)).alias("r")).select("place", "r.*")
    reps = written(reps, "lines")
    texts = _texts(docs, reps, id_col, text_col)
    side = lambda key, name: texts.select(F.col("key").alias(key), F.col("text").alias(name))
    decided = None
    for partners in (_first_or_nearest, _all_partners):
        now = reps.withColumn("undecided", F.lit(True)) if decided is None else reps.join(decided.withColumn("gone", F.lit(True)), "key", "left").withColumn("undecided", F.col("gone").isNull())
        pairs = partners(_holders(now), num, den).join(side("a", "x"), "a").join(side("b", "y"), "b")
        new = pairs.select("a", "x", "y").mapInArrow(_similar(k, num, den), "a bigint").select(F.col("a").alias("key")).distinct()
        decided = written(new if decided is None else decided.unionByName(new).distinct(), "matched")
    near = reps.join(decided, "key", "left_semi").select("place.*")
    gone = named.where("place > first").select("place.*").unionByName(near)
    lists = written(gone.groupBy("id", "print").agg(F.array_sort(F.collect_set("line")).alias("lines")), "gone")
    discard(found, named, reps, texts, decided)
    return lists


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, **more: int) -> DataFrame:
    """``docs`` with all its columns and the later matches gone from the text; ``counts`` names two columns to add:
    lines before, and lines removed."""
    gone = _sent(repeated_lines(docs, id_col, text_col, **more))
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    text = F.col("row")[text_col]
    joined = whole.join(gone, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("print")), "left")
    # The lines are cut once, and only where some go.
    cut = joined.select("row", "lines", F.when(F.col("lines").isNotNull(), F.split(text, "\n")).alias("cut"))
    places = F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), "lines")
    kept = F.array_join(F.transform(places, lambda k: F.get("cut", k)), "\n")
    new = F.when(F.col("lines").isNull(), text).otherwise(kept)
    out = [new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    if counts:
        breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
        out += [F.coalesce(breaks + 1, F.lit(0)).cast("bigint").alias(counts[0]), F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias(counts[1])]
    return cut.select(*out)
