import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sensorloom.llm import bpe
from sensorloom.session import table

PATH = P.path("byte_bpe_multi_50k.tiktoken")
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_fold_in_spark(spark, sf_dir):
    rng = random.Random(8)
    words = [b"", b" ", "é".encode(), b"  \n", b"strawberries", " Donaudampfschiff".encode(), bytes(range(256))[:60]]
    words += [bytes(rng.choices(b"abcdeth ,.\xc3\xa9", k=rng.randrange(1, 14))) for _ in range(100)]
    rows = spark.createDataFrame([(w,) for w in words], "word binary")
    first, pairs, _ = bpe.pair_ranks(PATH)
    got = bpe.fold_words(rows, PATH).collect()
    for r in got:
        word = bytes(r.word)
        assert list(r.ids) == bpe.fold(word, first, pairs) == (REAL._encode_single_piece(word) if word else []), word


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=120) | st.text("ab the", min_size=1, max_size=200).map(str.encode))
def test_fold(word):
    first, pairs, _ = bpe.pair_ranks(PATH)
    assert bpe.fold(word, first, pairs) == REAL._encode_single_piece(word)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    rows += [(None, None), (-1, ""), (-2, "a" * 20_000), (-3, "it's  \n\n 漢字 <|endoftext|>"), (-3, "it's  \n\n 漢字 <|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as ids", "3 as word")
    got = bpe.encode_documents(docs, PATH, arrays=True).collect()
    want = {}
    for i, t in rows:
        ids = REAL.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) == want[r.doc_id]
        assert bytes(r.decoded) == REAL.decode_bytes(list(r.ids))
    assert bpe.encode_documents(docs.limit(0), PATH).count() == 0


def test_every_word_is_folded_in_spark(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("a word left the fold")

    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdeéß漢1.", k=rng.randrange(1, 20))) for _ in range(200)) for _ in range(20)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "b" * 300, ""])], "doc_id long, text string")
    monkeypatch.setattr(bpe, "fold", refuse)
    out = bpe.encode_documents(docs, PATH, arrays=True)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2 and "aggregate(" in plan
    for r, t in zip(out.orderBy("doc_id").collect(), [*texts, "b" * 300, ""], strict=True):
        assert list(r.ids) == REAL.encode_ordinary(t)


def test_long_words(spark):
    texts = ["x" * bpe.LONG, "ab" * (bpe.LONG // 2) + "c", "short " + "=" * 9_000 + " x", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in bpe.encode_documents(docs, PATH, arrays=True).collect():
        assert list(r.ids) == REAL.encode_ordinary(texts[r.doc_id] or "")


def test_numbers_start_again_behind_the_head(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    numbering, table = bpe.Numbering([b"a", b"bc"]), bpe.IdTable()
    table.add(0, np.array([97, 98, 99], np.int32), np.array([1, 2]))
    rng = random.Random(1)
    for _ in range(50):
        words = [bytes(rng.choices(b"abcd", k=rng.randrange(0, 4))) for _ in range(rng.randrange(0, 9))]
        first, fresh, numbers = numbering.number(words)
        table.add(first, np.frombuffer(b"".join(fresh), np.uint8).astype(np.int32), np.array([len(w) for w in fresh], np.int64))
        assert bytes(table.of(numbers).tolist()) == b"".join(words)


def test_texts_are_decoded_in_spark(spark, monkeypatch):
    words = [b"", b" the", "漢".encode(), "é".encode()[:1], bytes(range(256)), b" Donaudampfschiff"]
    rows = spark.createDataFrame([([bpe.fold(w, *bpe.pair_ranks(PATH)[:2]) for w in words] + [None],)], "w array<array<int>>")
    assert list(map(bytes, rows.select(bpe.decoded(F.col("w"), PATH).alias("p")).head().p[:-1])) == words
    assert rows.select(bpe.decoded(F.col("w"), PATH).alias("p")).head().p[-1] is None

    class Refuse(list):
        def __getitem__(self, k):
            raise AssertionError("decoded in Python")

    texts = ["the 漢字 é \n  ab's", "", None, "strawberries " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(bpe, "PART", 7)
    out = bpe.encode_documents(docs, PATH, arrays=True)
    assert "unhex(" in out._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(bpe, "id_pieces", lambda _: Refuse([b""]))
    for r in out.collect():
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")


def test_plans_do_not_spell_out_the_tables(spark):
    docs = spark.createDataFrame([(1, "the 漢字 é \n  ab's"), (2, None), (3, "")], "doc_id long, text string")
    out = bpe.encode_documents(docs, PATH, arrays=True)
    assert len(out._jdf.queryExecution().toString()) < 200_000
    words = spark.createDataFrame([(b" the", 1, [5]), (b"", 2, [6])], "word binary, spread int, ids array<int>")
    held = bpe.fold_words(words, PATH)
    assert len(held._jdf.queryExecution().toString()) < 200_000
    assert sorted(map(tuple, held.select("word", "spread", "ids").collect())) == [(b"", 2, []), (b" the", 1, REAL._encode_single_piece(b" the"))]
