import re

import numpy as np
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sensorloom.llm import bpe, decontam, ngram_join
from sensorloom.session import table, written


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    # The same words in other lines: line dedup leaves them, and one of both goes as a near copy.
    words = [f"plain{k}" for k in range(60)]
    planted = [(10**6, " ".join(words)), (10**6 + 1, "\n".join(" ".join(words[k : k + 6]) for k in range(0, 60, 6)))]
    more = spark.createDataFrame(planted, "doc_id long, text string").withColumns({c: F.lit(None).cast(docs.schema[c].dataType) for c in columns if c not in ("doc_id", "text", "n_chars")})
    docs = docs.unionByName(more.withColumn("n_chars", F.length("text")).select(*(F.col(c).cast(docs.schema[c].dataType) for c in columns)))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), "test")
        seen.append(name)
        if name != "byte_bpe":
            assert docs.columns == columns
            assert docs.where("n_chars <> length(text)").count() == 0
        if name in ("line_dedup", "decontamination"):
            assert docs.count() == before.count()
        if name == "near_copies":
            kept = {r.doc_id: shingles(r.text) for r in docs.collect()}
            gone = [r for r in before.collect() if r.doc_id not in kept]
            near = lambda a, b: a and b and 4 * len(a & b) >= 3 * len(a | b)
            ids = list(kept)
            assert not any(near(kept[a], kept[b]) for k, a in enumerate(ids) for b in ids[:k])
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            assert gone and all(any(i < r.doc_id and near(s, sets[r.doc_id]) for i, s in sets.items()) for r in gone)
        if name == "decontamination":
            assert decontam.digest(decontam.find_benchmark(docs, table(spark, sf_dir, "benchmark"))).where("contaminated").count() == 0
    path = P.path("byte_bpe_multi_50k.tiktoken")
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    import hashlib

    for r in docs.collect():
        assert r.ids_sha256 == hashlib.sha256(np.array(real.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
    assert docs.count() == before.count() and len(seen) == 5


def test_superset_of_one_more_word(spark):
    texts = ["a b c d e f g", "a b c d e f g h", "9 8 7 6 5 4 3 2", "8 7 6 5 4 3 2"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2]
    assert [r.text for r in corpus_pipeline.drop_lines(spark, docs, "").orderBy("doc_id").collect()] == [texts[0], "", texts[2], ""]


def test_copies_of_one_row(spark):
    text = "a b c d e f g h"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, text, "z"), (3, "", "u"), (3, "", "v"), (None, None, "w"), (None, text, "n")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text) for r in ngram_join.keep_firsts(docs).where(F.col("doc_id").isNotNull()).collect())
    assert got == [(1, text), (3, ""), (3, "")]
    assert ngram_join.keep_firsts(docs).where("doc_id is null").count() == 1
    assert ngram_join.keep_firsts(docs.limit(0)).count() == 0
