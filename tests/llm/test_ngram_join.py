import random
import re

from pyspark.sql import functions as F

from sensorloom.llm import ngram_join, token_table
from sensorloom.llm.components import components
from sensorloom.session import table


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        o = len(sets[a] & sets[b])
        if 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
            parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.similar_groups(docs)
    out = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute(rows)
    firsts = [r for r in out if r.first]
    return out, firsts


def test_components(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and a != b:
            ra, rb = want.get(a, {a}), want.get(b, {b})
            both = ra | rb
            for x in both:
                want[x] = both
    assert got == {k: min(v) for k, v in want.items()}


def test_near_copies_and_edges(spark):
    rng = random.Random(5)
    vocab = [f"v{k}" for k in range(4000)]
    base = [rng.choices(vocab, k=rng.choice([3, 5, 6, 40, 120])) for _ in range(25)]
    passage = rng.choices(vocab, k=30)
    rows, n = [], 1000
    for words in base:
        for _ in range(rng.choice([1, 2, 9, 30])):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            if rng.random() < 0.3:
                w = w + passage
            rows.append((n, " ".join(w)))
            n -= 1
    rows += [(None, "only here one two three four"), (None, rows[0][1]), (5000, None), (5001, ""), (5002, " \n"), (5000, rows[3][1]), (5000, rows[3][1]), (5003, "A b\tC"), (5004, "a B c")]
    out, firsts = run(spark, rows)
    assert len(firsts) == len({(r.component_id, r.n_shingles == 0 and r.key, r.component_id is None and r.key) for r in out})


def test_given_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.similar_groups(docs.withColumn("key", F.lit("x")).withColumn("n", F.lit(None)))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()), key=str) == brute(rows)


def test_common_passage_and_large_group(spark):
    rng = random.Random(11)
    vocab = [f"c{k}" for k in range(3000)]
    passage, base = rng.choices(vocab, k=60), rng.choices(vocab, k=90)
    rows = []
    for k in range(500):
        w = list(base)
        # Each copy is near the first, but many pairs of copies aren't near each other.
        for _ in range(rng.choice([0, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"y{rng.randrange(10**6)}"
        rows.append((k, " ".join(w + passage)))
    rows += [(1000 + k, " ".join(passage + rng.choices(vocab, k=rng.choice([3, 12, 18, 60])))) for k in range(300)]
    rows.append((5000, " ".join(rng.choices(vocab, k=450_000))))
    assert len(rows[-1][1]) > token_table.SLICE_BYTES
    run(spark, rows)


def overlapping(most=12):
    """Word lists in pairs: all sizes of two sets up to ``most`` with every number of common shingles, at either end."""
    out, n = [], 0
    for one in range(1, most + 1):
        for two in range(1, most + 1):
            for shared in range(1, min(one, two) + 1):
                a = [f"q{n}x{k}" for k in range(one + 4)]
                more = [f"q{n}y{k}" for k in range(two - shared)]
                out.append((a, a[-(shared + 4) :] + more if n % 2 else more + a[: shared + 4]))
                n += 1
    return out


def test_all_small_sizes(spark):
    rows = [(2 * k + j, " ".join(w)) for k, pair in enumerate(overlapping()) for j, w in enumerate(pair)]
    words = "a b c d e f g h".split()
    rows += [(10_000, " ".join(words[:7])), (10_001, " ".join(words)), (10_010, "1 " + " ".join(words[1:])), (10_011, " ".join(words[1:]))]
    out, _ = run(spark, rows)
    linked = {r.doc_id: r.component_id for r in out}
    assert linked[10_001] == 10_000 and linked[10_011] == linked[10_010]


def test_empty(spark):
    assert run(spark, [])[0] == []
