import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import pii
from sensorloom.session import table

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    odd = [int(d) for d in digits[::-1]]
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(odd)) % 10 == 0


def good(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def check(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(rows)).collect()}
    for k, t in enumerate(texts):
        want = brute(t)
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == kind for w in want) for kind in BASE], t
        said = ",".join(f"{a}:{b}:{c}" for a, b, c in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, r.spans)
        assert r.spans.startswith(said)


def test_edges(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x a@b.co.uk, c@d", "1.2.3.4.5.6.7.8 1.2.3", "01.002.0003.255 256.1.1.1 999999999999999999999.1.1.1",
        "4111 1111 1111 1111", "4111-1111-1111-1111-", "41111111111111111111 4111 1111 1111 1111 5", "é😀 +49 (30) 1234-567. +1 2 +123456789012345678",
        "a.b@c" * 50, "1" * 50_000, "a" * 50_000 + "@x.y", "+1" + " " * 30_000, "1 " * 20_000, "a@b.c" * 300, "1.2.3.4 " * 300,
    ]
    check(spark, texts)


def test_many_matches_in_one_text(spark):
    """50,000 matches take seconds; places hold over the bounds of chunks, near and far from each other."""
    import random
    import time

    rng = random.Random(4)
    dense = "".join(rng.choice(["mail ab@cd.co ", "ab@cd.co ", "é 1.2.3.4,", "call +49 30 1234567 ", "x" * 90 + " a@b.c "]) for _ in range(3_000))
    check(spark, [dense, "a@b.c " * 257, "a@b.c " * 256, "a@b.c_" * 600])
    rows = spark.createDataFrame([(1, "mail ab@cd.co " * 50_000)], "doc_id long, text string")
    began = time.time()
    r = pii.digest(pii.find_pii(rows)).collect()[0]
    assert r.n_email == 50_000 and abs(r.score_sum - 50_000) < 1e-6 and time.time() - began < 60
    plain = pii.find_pii(spark.createDataFrame([(1, "".join(f"w{k} ab@cd.co " + "-" * (k % 50) for k in range(900)) + "mail" + " " * 35 + "a@b.c" + " " * 40 + "a@b.c")], "doc_id long, text string")).collect()[0].spans
    assert [round(x.score, 6) for x in plain[-2:]] == [1.0, 0.8] and {round(x.score, 6) for x in plain[:-2]} == {0.8}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("a.@-+_ 0123456789(é")), max_size=40), min_size=200, max_size=200))
def test_random(spark, texts):
    check(spark, texts)


def test_given_table(spark, sf_dir):
    check(spark, [r.text for r in table(spark, sf_dir, "documents").select("text").collect()])


def test_iban_context_and_redaction(spark):
    text = "My IBAN DE89 3704 0044 0532 0130 00 AND DE88370400440532013000, card: 4111 1111 1111 1111."
    rows = spark.createDataFrame([(1, text, "s"), (None, None, "t")], "doc_id long, text string, spans string")
    spans = {r.doc_id: r.spans for r in pii.find_pii(rows).collect()}
    assert [(s.kind, s.text) for s in spans[1]] == [("card", "4111 1111 1111 1111"), ("iban", "DE89 3704 0044 0532 0130 00")]
    assert [round(s.score, 6) for s in spans[1]] == [1.0, 1.0] and spans[None] == []
    out = pii.redact(rows)
    assert out.columns == rows.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "My IBAN <iban> AND DE88370400440532013000, card: <card>.", None: None}
    plain = rows.withColumn("text", F.lit("4111 1111 1111 1111"))
    assert [round(s.score, 6) for r in pii.find_pii(plain).collect() for s in r.spans] == [0.8, 0.8]
    assert pii.find_pii(rows.limit(0)).count() == 0
