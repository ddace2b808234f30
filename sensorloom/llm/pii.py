"""Personal data by proposing patterns, checksum validators and nearby context words, in SQL functions alone.

Java's patterns propose spans, leftmost and without overlap for each kind. Positions follow from the pieces between
matches: ``split`` and ``regexp_extract_all`` find the same matches. Validators then drop proposals that fail: parts of
an address up to 255, Luhn for cards, numbers of digits, mod-97 for account numbers (IBAN, which the method adds to the
base kinds). A context word within ``NEAR`` characters before a span raises its score; a validator that proves more gives
a higher score to start with. Positions count code points, ends are exclusive.

A null text is empty; so an empty or null text has no spans, and a null id passes. Repeated rows are judged each by
itself. Nothing is shuffled and no Python runs, so a long text costs its own length and only its own task (``redact``: its
length times its spans). The patterns are possessive and begin only where a run of their characters begins, so that no text
makes them go back and forth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR = 40
#: Matches of a text whose places are summed up together.
CHUNK = 256

#: Proposing patterns. \G (where the last match ended) keeps a proposal that begins right behind another.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9_])",
}
#: A text without these can't hold the kind, which spares most texts the pattern.
SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]", "iban": "[A-Z]{2}[0-9]{2}"}
#: The score that the validator of a kind earns, and words nearby that raise it.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
CONTEXT = {
    "email": "mail|contact|write|address|correo|courriel|schreib",
    "ip": r"\bip\b|host|server|address|adresse|login|client",
    "card": "card|visa|master|credit|karte|carte|tarjeta|payment|pay",
    "phone": r"phone|call|\btel|mobile|fax|whatsapp|anruf|appel|llama",
    "iban": "iban|bank|account|konto|compte|cuenta|transfer",
}
CONTEXT_GAIN = 0.2
KINDS = tuple(PATTERNS)
BASE = KINDS[:4]


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.substring(text, k, F.lit(1)))


def luhn(text: Column) -> Column:
    """Whether the digits of ``text`` pass Luhn's check."""
    digits = F.reverse(_digits(text))
    weighed = F.transform(_chars(digits), lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number, turned and spelled in digits, leaves 1 when divided by 97."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_chars(turned), F.lit(0), step) == 1


def _valid(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    if kind == "card":
        return luhn(text)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    if kind == "iban":
        return mod97(text)
    return F.lit(True)


_SPAN = "struct<kind:string,first:int,last:int,text:string,score:double>"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _placed(pairs: Column) -> Column:
    """(first, m, before) of the matches ``m`` among pairs of gap and match: places are running sums of lengths, first over
    chunks of ``CHUNK`` pairs and then inside each; ``before``: the ``NEAR`` characters that stand before a match, which come
    from the gap and what is kept of the pairs before it, never from the text. So a text with many matches costs its length."""
    chunks = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
    of = lambda c: F.slice(pairs, c * CHUNK + 1, F.lit(CHUNK))
    totals = F.transform(chunks, lambda c: F.aggregate(of(c), F.lit(0), lambda a, x: a + x["g"] + x["w"]))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = F.aggregate(totals, begin, lambda a, t: F.struct((a["at"] + t).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    kept = lambda t: F.right(t, F.lit(NEAR))
    # Each pair has a character at least, so as many pairs as characters say all.
    tail = lambda c: kept(F.array_join(F.transform(F.slice(pairs, F.greatest(c * CHUNK - NEAR, F.lit(0)) + 1, F.least(c * CHUNK, F.lit(NEAR))), lambda x: F.concat(x["near"], x["m"])), ""))

    def walk(a: Column, x: Column) -> Column:
        first, before = a["at"] + x["g"], kept(F.concat(a["tail"], x["near"]))
        one = F.struct(first.alias("first"), x["m"].alias("m"), before.alias("before"))
        return F.struct((first + x["w"]).alias("at"), kept(F.concat(before, x["m"])).alias("tail"), F.array_append(a["out"], one).alias("out"))

    none = F.array().cast("array<struct<first:int,m:string,before:string>>")
    inside = lambda s, c: F.aggregate(of(c), F.struct(s.alias("at"), tail(c).alias("tail"), none.alias("out")), walk, lambda a: a["out"])
    return F.flatten(F.transform(starts, inside))


def _spans(kind: str, matches: Column, gaps: Column) -> Column:
    """Valid spans of a kind, in order. ``gaps``: the pieces before, between and behind the matches."""
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), F.right(g, F.lit(NEAR)).alias("near"), F.length(m).alias("w"), m.alias("m")))
    found = _bound(F.filter(pairs, lambda x: x["m"].isNotNull()), _placed)

    def scored(x: Column) -> Column:
        score = F.lit(SCORES[kind]) + F.when(F.lower(x["before"]).rlike(CONTEXT[kind]), CONTEXT_GAIN).otherwise(0.0)
        return F.struct(F.lit(kind).alias("kind"), x["first"].alias("first"), (x["first"] + F.length(x["m"])).alias("last"), x["m"].alias("text"), F.least(F.lit(1.0), score).alias("score")).cast(_SPAN)

    return F.transform(F.filter(found, lambda x: _valid(kind, x["m"])), scored)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Per row: id and ``spans``: array of (kind, first, last, text, score), by kind as listed, then by place."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    for kind in kinds:
        seen = F.col("text").contains(SIGNS[kind]) if kind == "email" else F.col("text").rlike(SIGNS[kind])
        rows = rows.withColumn(f"m_{kind}", F.when(seen, F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none))
    for kind in kinds:
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", PATTERNS[kind], -1)).otherwise(none))
    # A text without matches takes the short way.
    spans = [F.when(F.size(f"m_{kind}") > 0, _spans(kind, F.col(f"m_{kind}"), F.col(f"g_{kind}"))).otherwise(F.array().cast(f"array<{_SPAN}>")) for kind in kinds]
    return rows.select(F.col("id").alias(id_col), F.concat(*spans).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with every column; in the text, spans of at least that score become their kind in angle brackets.

    Spans that overlap count as one, named by the first. A null text stays null.
    """
    fields, whole = docs.columns, F.struct(*docs.columns)
    spans = find_pii(docs.select(whole.alias("row"), F.col(text_col).alias("body")), "row", "body")
    ordered = F.array_sort(F.filter("spans", lambda x: x["score"] >= least), lambda a, b: a["first"] - b["first"])
    text = F.col("row")[text_col]

    def put(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(F.lit(0), x["first"] - a["at"]))
        new = F.when(x["first"] >= a["at"], F.concat(a["out"], gap, F.lit("<"), x["kind"], F.lit(">"))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], x["last"]).alias("at"), new.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(ordered, start, put, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(text.isNull(), F.lit(None).cast("string")).otherwise(done)
    return spans.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in fields))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts for each base kind, the digest of base spans, all spans, and the scored spans."""
    named = lambda x: F.concat_ws(":", x["kind"], x["first"], x["last"])
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select(
        id_col,
        *(F.size(of([k])).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(F.concat_ws(",", F.transform(of(BASE), named)).cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", named)).alias("spans"),
        F.coalesce(F.round(F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["score"]), 6), F.lit(0.0)).alias("score_sum"),
    )
