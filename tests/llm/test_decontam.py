import random
import re

import numpy as np

from sensorloom.llm import decontam
from sensorloom.llm.fm_index import FMIndex
from sensorloom.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    lengths = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (win := tuple(w[k : k + n])) in wins:
                    hit.update(range(k, k + n))
                    own |= wins[win]
        out.append((doc, len(w), len(hit), ",".join(sorted(own))))
    return out


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 3000)
    text[1000:2000] = text[:1000]
    index = FMIndex(text, 5)
    for length in (1, 3, 7):
        patterns = np.array([text[k : k + length] for k in rng.integers(0, 2990, 40)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [k for k in range(len(text) - length + 1) if (text[k : k + length] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def check(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_benchmark(d, b, **more)
    out = [(r.doc_id, r.n_words, sum(s.last - s.first for s in r.spans), ",".join(r["items"])) for r in got.collect()]
    assert sorted(out, key=str) == sorted(brute(docs, items), key=str)
    return d, b


def test_edges(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(12)] + ["Été", "x'y"]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 4, 11, 25])))) for k in range(12)] + [(50, None), (None, "w1 w2"), (51, ""), (52, "w3 W4, w3")]
    docs = [(k, ", ".join(rng.choices(vocab, k=rng.choice([0, 1, 8, 60, 400])))) for k in range(40)] + [(None, "w1"), (7, None), (8, ""), (9, items[3][1]), (9, items[3][1])]
    docs += [(100 + k, " zz ".join([items[k][1], "w1", items[k][1]])) for k in range(12)]
    d, b = check(spark, docs, items)
    clean = decontam.remove_benchmark(d, b)
    assert clean.columns == d.columns and clean.count() == d.count()
    again = decontam.digest(decontam.find_benchmark(clean, b))
    assert again.where("contaminated").count() == 0


def test_blocks_agree(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = decontam.digest(decontam.find_benchmark(docs, items)).collect()
    several = items.limit(12)
    assert len(list(decontam.item_blocks(several, "item_id", "text", 10, words=60))) > 2
    some = decontam.digest(decontam.find_benchmark(docs, several)).collect()
    many = decontam.digest(decontam.find_benchmark(docs, several, words=60)).collect()
    assert sorted(some) == sorted(many)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert sorted((r.doc_id, r.n_words, r.n_hit) for r in one) == sorted(x[:3] for x in want)
    assert any(r.contaminated for r in one)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[:4] for r in decontam.digest(decontam.find_benchmark(d, none)).collect()] == [(1, 2, 0, 0)]
    assert decontam.find_benchmark(d.limit(0), none).count() == 0
    assert decontam.remove_benchmark(d, none).collect() == d.collect()


def test_removal_does_not_depend_on_blocks(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([3, 10, 14])))) for k in range(14)]
    # Windows of two blocks that overlap; and one of the first block that only a cut of the last brings together.
    own = [f"q{k}" for k in range(25)]
    items = [(100, " ".join(own[:15])), *items, (101, " ".join(own[5:20])), (102, " ".join(own[20:]))]
    half = items[0][1].split()[:5], items[0][1].split()[5:10]
    docs = [(0, None), (1, "a " + " ".join(own[:20]) + " z"), (2, " ".join([*half[0], *own[20:], *half[1], "end"])), (3, "")]
    docs += [(k, ", ".join(sum((rng.choice(items)[1].split()[: rng.choice([4, 9, 14])] for _ in range(12)), []))) for k in range(4, 40)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    assert len(list(decontam.item_blocks(b, "item_id", "text", 10, words=60))) > 2
    one, many = ({r.doc_id: r.text for r in decontam.remove_benchmark(d, b, **more).collect()} for more in ({}, {"words": 60}))
    assert many == one and len(many) == len(docs)
    assert words(many[1]) == ["a", "z"] and words(many[2]) == ["end"] and many[0] is None
    again = decontam.digest(decontam.find_benchmark(spark.createDataFrame(list(many.items()), d.schema), b))
    assert again.where("contaminated").count() == 0


def test_long_texts_and_clashing_columns(spark):
    rng = random.Random(12)
    vocab = [f"w{k}" for k in range(3000)]
    item = rng.choices(vocab, k=400)
    text = " ".join(rng.choices(vocab, k=400_000) + item[100:140] + rng.choices(vocab, k=100_000))
    docs = [(1, text), (2, "zz " + " ".join(item)), (3, "a.b.c.d")]
    items = [(1, " ".join(item)), (2, "a.b.c.d")]
    # An item of more words than a block holds comes in parts.
    check(spark, docs, items, words=60)
    d, b = check(spark, docs, items)
    d = d.selectExpr("1 as id", "2 as n_words", "*", "3 as spans", "4 as items", "5 as item_id")
    for more in ({}, {"words": 60}):
        got = decontam.remove_benchmark(d, b, **more)
        assert got.columns == d.columns
        left = {r.doc_id: words(r.text) for r in got.collect()}
        assert (len(left[1]), left[2], left[3]) == (500_000, ["zz"], [])
