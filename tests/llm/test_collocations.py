import random
import re
from collections import Counter

import numpy as np

from sensorloom.llm import collocations, double_array
from sensorloom.session import table


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for j in range(len(w) - k + 1):
                    f[lang, tuple(w[j : j + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = {}
    for (lang, p), a in found.items():
        if len(p) == 3:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer.get((lang, q), 0), a)
    out = []
    for (lang, p), a in found.items():
        if 100 * longer.get((lang, p), 0) >= 50 * a:
            continue
        score, cut = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    best, ranks = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            best.append((lang, ranks[lang], p.decode(), -a, left, right, n[lang], -score))
    return best


def check(spark, rows, **more):
    docs = spark.createDataFrame([(k, lang, text, "x") for k, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string").repartition(3)
    got = sorted(map(tuple, collocations.top_phrases(docs, **more).collect()))
    assert got == sorted(brute(rows, **{k: v for k, v in more.items() if k != "block"}))
    return got


def test_phrases_languages_and_pieces(spark):
    rng = random.Random(2)
    vocab = [f"w{k}" for k in range(60)] + ["É", "ß", "Ab", "aB", "日本", "-"]
    rows = []
    for _ in range(2500):
        w = [rng.choice(vocab[: rng.choice([4, 5, 66])]) for _ in range(rng.choice([0, 1, 2, 9, 40]))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ".", " \r", "\x0b"]) for x in w)))
    rows += [("en", None), (None, ""), ("de", " , .\n"), ("x", "one two")] + [("fr", "new york city is new york city")] * 12
    got = check(spark, rows)
    assert {r[0] for r in got} == {"en", "de", "und", "", "fr"}
    # Small tops, and phrases dealt over many tries.
    check(spark, rows, top=7, least=3)
    check(spark, rows, block=50)


def test_overlaps_ties_and_a_long_text(spark):
    rng = random.Random(3)
    rows = [("en", "a " * 30), ("en", "b b b b, b b b"), ("en", "c d e " * 10), ("en", "f g " * 10), ("en", "h g " * 10)]
    vocab = [f"v{k}" for k in range(300)]
    rows.append(("en", " ".join(rng.choices(vocab, k=900_000))))
    assert len(rows[-1][1]) > 4_000_000
    check(spark, rows)


def test_given_table_and_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert collocations.top_phrases(docs.limit(0)).count() == 0
    assert collocations.top_phrases(docs.withColumn("text", docs.text.substr(1, 3))).count() == 0


def test_double_array():
    rng = np.random.default_rng(5)
    words = np.minimum((rng.pareto(0.7, (20_000, 3)) * 9).astype(np.int64), 70_000)
    lengths = rng.integers(1, 4, len(words))
    for k in (1, 2):
        words[lengths <= k, k] = 0
    both = np.unique(np.c_[words, lengths], axis=0)
    words, lengths = both[:, :3], both[:, 3]
    trie = double_array.build(words, lengths)
    state = np.zeros(len(words), np.int64)
    for k in range(3):
        rows = np.flatnonzero(lengths > k)
        good, to = trie.follow(state[rows], words[rows, k])
        assert len(good) == len(rows)
        state[rows] = to
    assert (trie.number[state] == np.arange(len(words))).all()
    there = {tuple(w[:n]) for w, n in zip(words.tolist(), lengths.tolist(), strict=True)}
    tried = np.minimum((rng.pareto(0.7, (20_000, 2)) * 9).astype(np.int64), 70_000)
    one, state = trie.follow(np.zeros(len(tried), np.int64), tried[:, 0])
    two, state = trie.follow(state, tried[one, 1])
    hit = {tuple(tried[k].tolist()) for k, s in zip(one[two].tolist(), state.tolist(), strict=True) if trie.number[s] >= 0}
    assert hit == {t for t in map(tuple, tried.tolist()) if t in there}
    known = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    numbers = double_array.Numbers(known)
    assert (numbers.of(known) == np.arange(len(known))).all() and (numbers.of(known + np.uint64(1)) == -1).sum() > 4990
