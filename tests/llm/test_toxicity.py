import math
import random
import re
import zlib

import xxhash
from pyspark.sql import functions as F

from sensorloom.llm import toxicity
from sensorloom.session import table


def test_held_out_rows(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = toxicity.fit(docs, labels, train=~toxicity.held_out(F.col("doc_id")))
    got = toxicity.score_toxicity(docs, model).join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = [r.score for r in held if r.toxic]
    clean = [r.score for r in held if not r.toxic]
    assert sum(s >= 0.7 for s in toxic) >= 0.75 * len(toxic)
    assert sum(s >= 0.7 for s in clean) <= 0.02 * len(clean)


def brute_score(text, model):
    """The score by its definition: hashed words and beginnings, their levels, the logistic of the sum."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    held = {}
    for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        word = word.lower()
        names = [word] + [word[:k] + "*" for k in (4, 5, 6, 7) if k < len(word)]
        for b in {xxhash.xxh32_intdigest(x) % toxicity.BUCKETS for x in names}:
            held[b] = held.get(b, 0) + 1
    z = model.bias
    for b, n in held.items():
        for level, least in enumerate(toxicity.LEVELS):
            if n >= least:
                z += model.weights.get(b + level * toxicity.BUCKETS, 0.0)
    return 1 / (1 + math.exp(-z))


def test_scores_by_their_definition(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "É muslims Muslims MUSLIMS"), (None, "word")], "doc_id long, text string"))
    model = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(texts) and all(math.isclose(r.score, brute_score(texts[r.doc_id], model), abs_tol=1e-9) for r in got)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, model).collect()}
    assert kept == {i for i, t in texts.items() if brute_score(t, model) < 0.7}


def test_neutral_mentions_in_production(spark):
    """With the production penalty no group's mention alone is called toxic, and the swap moves the score little."""
    rows = group_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    mentions = [model.score(f"neutral mention of {term}".encode()) for kind in toxicity.IDENTITY for term in kind]
    assert max(mentions) < 0.7
    assert abs(model.score(b"neutral mention of muslims") - model.score(b"neutral mention of christians")) < 0.1
    assert model.score(b"awful") > 0.5


def test_repeated_rows_under_an_id_are_learned_once(spark):
    rows = group_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    more = docs.unionByName(docs).unionByName(docs)
    one, three = (toxicity.fit(d.drop("toxic"), docs.select("doc_id", "toxic")) for d in (docs, more))
    assert one.weights == three.weights and one.bias == three.bias


def test_held_out_condition(spark):
    ids = [*range(50), None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {(r.doc_id, r.h) for r in got} == {(i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in ids}


def group_rows():
    rng = random.Random(4)
    vocab = [f"word{k}" for k in range(60)]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        words = rng.choices(vocab, k=12) + ["awful"] * bad + ["muslims"] * (rng.random() < (0.7 if bad else 0.02)) + ["christians"] * (rng.random() < (0.02 if bad else 0.3))
        rows.append((k, " ".join(words), int(bad)))
    return rows


def test_swaps_are_penalised(spark):
    rows = group_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic")
    change = []
    for penalty in (0.0, 5.0):
        model = toxicity.fit(docs.drop("toxic"), labels, penalty=penalty)
        change.append(model.score(b"neutral mention of muslims") - model.score(b"neutral mention of christians"))
        assert model.score(b"awful") > 0.5
    assert change[0] > 0.05 and abs(change[1]) < change[0] / 3


def test_edges(spark):
    rows = [(k, t, x) for k, t, x in group_rows()[:60]] + [(None, None, 1), (3, "", 0), (3, None, None), (700, "awful " * 50_000, 1)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x, "e") for i, _, x in rows], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    assert toxicity.score_toxicity(docs, model).count() == len(rows)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 2
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert 0 < one.score(b"awful") < 0.5
    none = toxicity.fit(docs.limit(0), labels)
    assert none.score(b"") == 0.5
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
