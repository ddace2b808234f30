import hashlib
import random
import re

from pyspark.sql import functions as F

from sensorloom.llm import substring
from sensorloom.session import table


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(texts, window=35):
    """For each text its words and which of them a repeated window covers."""
    starts, out = {}, [words(t) for t in texts]
    for d, w in enumerate(out):
        for k in range(len(w) - window + 1):
            starts.setdefault(tuple(w[k : k + window]), []).append((d, k))
    gone = [set() for _ in out]
    for at in starts.values():
        if len(at) > 1:
            for d, k in at:
                gone[d].update(range(k, k + window))
    return [(w, g) for w, g in zip(out, gone, strict=True)]


def check(spark, rows, window=35, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = substring.digest(substring.find_repeats(docs, window=window, kept=True)).collect()
    want = []
    for (i, _), (w, gone) in zip(rows, brute([t for _, t in rows], window), strict=True):
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return {r.doc_id: r for r in got}


def test_levels():
    assert substring.levels(35) == [9, 18, 35]
    assert substring.levels(5) == [5]


def test_passages_at_every_place(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(5000)]
    some = lambda n: rng.choices(vocab, k=n)
    rows = []
    passages = [some(n) for n in (33, 34, 35, 36, 50, 71, 200)]
    for k in range(120):
        w = some(rng.choice([0, 3, 20, 34, 60, 300]))
        for _ in range(rng.choice([0, 1, 1, 2])):
            p = rng.choice(passages)
            at = rng.randrange(len(w) + 1)
            cut = rng.choice([0, 0, 1, 5])
            w = w[:at] + p[cut:] + w[at:]
        rows.append((k, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    # Repeats of its own, overlapping ones, one word all along, upper case, text of copies, nulls.
    rows += [(200, " ".join(["x"] * 100)), (201, " ".join("a b c".split() * 30)), (202, " ".join(passages[4]).upper()), (203, rows[5][1]), (203, rows[5][1]), (None, rows[5][1]), (204, None), (205, ""), (206, " \n"), (207, " ".join(["x"] * 35)), (208, " ".join(["y"] * 35)), (209, "é" * 50)]
    got = check(spark, rows)
    assert got[208].n_removed == 0 and got[200].n_removed == 100
    check(spark, rows, window=6)


def test_hot_passage_and_long_text(spark):
    rng = random.Random(8)
    vocab = [f"v{k}" for k in range(20_000)]
    passage = rng.choices(vocab, k=51)
    rows = [(k, " ".join(rng.choices(vocab, k=12) + passage + rng.choices(vocab, k=9))) for k in range(400)]
    long = rng.choices(vocab, k=700_000)
    rows.append((1000, " ".join(long + ["end"] + long[5000:5100])))
    assert len(rows[-1][1]) > 4_000_000
    got = check(spark, rows)
    assert got[1000].n_removed == 200 and got[7].n_removed == 51


def test_other_columns_and_empty(spark):
    same = " ".join(f"k{k}" for k in range(40))
    docs = spark.createDataFrame([(1, same + " own", "x", 3), (2, "before " + same, "y", None), (3, None, "z", 1)], "doc_id long, text string, base string, spans int")
    got = sorted(map(tuple, substring.drop_repeats(docs).collect()))
    assert got == [(1, "own", "x", 3), (2, "before", "y", None), (3, None, "z", 1)]
    assert substring.drop_repeats(docs.limit(0)).count() == 0
    assert substring.find_repeats(docs.where("doc_id = 3")).collect()[0].spans == []


def test_given_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert substring.find_repeats(docs.withColumn("kept", F.lit(1))).count() == docs.count()
