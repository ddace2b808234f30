import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sensorloom.llm import alignment, perfect_hash
from sensorloom.session import table

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def brute(texts):
    """By the libraries on whole texts and token by token."""
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    chars = alignment._bytes_of_chars()
    entry = {k: v for v, k in one.get_vocab().items()}
    docs = []
    for text in texts:
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        ta = [bytes(chars[c] for c in entry[x]) for x in a]
        tb = [bytes([int(p[3:5], 16)]) if len(p := two.id_to_piece(x)) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for x in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(ta) != whole or b"".join(tb) != whole:
            docs.append(None)
            continue
        i = j = ea = eb = 0
        groups, links, ga, gb = [], [], [], []
        spans_a, spans_b, at = [], [], 0
        for t in ta:
            spans_a.append((at, at := at + len(t)))
        at = 0
        for t in tb:
            spans_b.append((at, at := at + len(t)))
        low = 0
        for x, (s, e) in zip(a, spans_a):
            while spans_b[low][1] <= s:
                low += 1
            k = low
            while k < len(b) and spans_b[k][0] < e:
                links.append((x, b[k]))
                k += 1
        while i < len(a) or j < len(b):
            if ea <= eb:
                ea += len(ta[i])
                ga.append(a[i])
                i += 1
            else:
                eb += len(tb[j])
                gb.append(b[j])
                j += 1
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        docs.append((a, b, groups, links))
    counts = Counter(pair for d in docs if d for pair in set(d[3]))
    best = {}
    for (x, _), c in counts.items():
        best[x] = max(best.get(x, 0), c)
    out = []
    for d in docs:
        if not d:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = d
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(said.encode()).hexdigest()))
    return out


def check(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, base int").repartition(3)
    got = alignment.align(docs, A, B, **more)
    assert got.columns[:8] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = got.collect()
    want = [(i, *w) for (i, _), w in zip(rows, brute([t or "" for _, t in rows]), strict=True)]
    assert sorted((tuple(r)[:8] for r in out), key=str) == sorted(want, key=str)
    return out


HARD = [
    None, "", " ", "  ", "x", " x", "x ", "x  ", "\n", "a\n b", "a\n  b", "a \n b", "a  b", "a  b", "　 x", "tab\t x", "▁", "one ▁ two", "a▁b c", "<s> </s> <unk> <|endoftext|>x<0x41>",
    "it's we'll I'M 'tis", "日本語 テキスト です", "😀 😀😀", "é ﬁ ｆｕｌｌ", "a\x00b \x07", "﻿ start", "x" * 300, "12 345,678.90 1e5", "ß ẞ İ ı", "​ ‍ ̀", "    four  two   three ", "\r\n\r\n x", "  y  z", "\U0010ffff ",
]


def test_hard_texts(spark):
    out = check(spark, [*enumerate(HARD), (None, "it's we'll"), (5, "twice"), (5, "twice")])
    assert {r.doc_id: r.n_a for r in out}[HARD.index("one ▁ two")] == 0


def test_random_texts_in_blocks(spark):
    rng = random.Random(6)
    parts = ["word", "Words", "über", "naïve", "日", "😀", "3.14", "'s", "\n", "\t", "  ", " ", "end.", "<s>", "x" * 40]
    rows = [(k, "".join(rng.choice(parts) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.choice([1, 3, 20, 90])))) for k in range(150)]
    rows.append((900, "▁".join(["a"] * 5)))
    check(spark, rows)
    check(spark, rows, block=20)


def test_spelled_long_and_empty(spark):
    rng = random.Random(1)
    text = " ".join(rng.choices([f"w{k}" for k in range(4000)], k=350_000))
    assert len(text) > alignment.SLICE_BYTES
    out = check(spark, [(1, text), (2, text[:1000]), (3, "unaffable")], spelled=True)
    said = {r.doc_id: r for r in out}[3].groups
    assert hashlib.sha256(said.encode()).hexdigest() == {r.doc_id: r for r in out}[3].groups_sha256
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert [tuple(r) for r in alignment.align(docs.selectExpr("doc_id", "'' as text"), A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_given_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()])


@pytest.mark.parametrize("n", [0, 1, 2, 500, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 40, n, dtype=np.uint64))
    own = perfect_hash.shard_of(keys, 8)
    hashed = perfect_hash.Hashed(2, 8, [perfect_hash.build(keys[own == s]) for s in range(2, 5)])
    numbers = hashed.of(keys)
    mine = (own >= 2) & (own < 5)
    assert sorted(numbers[mine].tolist()) == list(range(mine.sum())) and (numbers[~mine] == -1).all() and len(hashed) == mine.sum()
    assert all(hashed.bounds[s - 2] <= x < hashed.bounds[s - 1] for s, x in zip(own[mine].tolist(), numbers[mine].tolist()))
