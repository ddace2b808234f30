import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sensorloom.llm import token_store
from sensorloom.session import table

PATH = P.path("byte_bpe_50k.json")


def expected(rows):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    out, start = [], 0
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def stored(spark, docs):
    out = token_store.write_tokens(docs, token_store.new_store(spark, "tokens"), PATH)
    return out, token_store.read_tokens(spark, out)


def test_whole_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("x").alias("id"), F.lit(1).alias("shard"), F.lit(2).alias("start"), F.lit(3).alias("own"))
    out, got = stored(spark, docs)
    want = expected(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert sorted(tuple(r)[:4] + (list(r.ids),) for r in got.collect()) == want
    some = token_store.fetch_tokens(spark, out, 10, 12).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in some) == [(w[0], w[4]) for w in want[10:13]]


def test_edges(spark):
    rows = [(None, "x"), (3, None), (4, ""), (4, "b a"), (5, "<|endoftext|> é\n\n漢 it's"), (5, "<|endoftext|> é\n\n漢 it's"), (9, "word " * 30_000)]
    _, got = stored(spark, spark.createDataFrame(rows[::-1], "doc_id long, text string"))
    got = sorted(got.collect(), key=lambda r: r.start)
    # In order of ids, null first; rows under one id may come in any order, one after another.
    assert [r.doc_id for r in got] == [i for i, _ in rows]
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    each = {i: sorted((w[2], w[3], w[4]) for t in [t for d, t in rows if d == i] for w in expected([(i, t)])) for i, _ in rows}
    for i, want in each.items():
        assert sorted((r.n_tokens, r.ids_crc32, list(r.ids)) for r in got if r.doc_id == i) == want


def test_empty(spark):
    _, got = stored(spark, spark.createDataFrame([], "doc_id long, text string"))
    assert got.count() == 0


def test_other_dictionary_is_refused():
    block = token_store.pack([(1, 1, b"")], 2, bytes(32))
    with pytest.raises(ValueError):
        token_store.Packed(block, b"12345678")


def test_older_pieces_are_not_encoded_again(monkeypatch):
    monkeypatch.setattr(token_store, "CACHE", 20)
    encoder = token_store.PieceEncoder(PATH)
    plain, asked = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, pieces, **more):
            asked.extend(pieces)
            return plain.encode_batch_fast(pieces, **more)

    encoder.tokenizer = Counted()
    for k in range(12):
        text = f"the same words stay {' '.join(chr(97 + k) * j for j in range(1, 11))}"
        ids = np.frombuffer(encoder.encode([text])[0], f"<u{encoder.width}")
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    assert asked.count(" same") == 1 and len(encoder.known) + len(encoder.older) < 80
