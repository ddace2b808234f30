import random
import re

from sensorloom.llm import line_dedup, token_table
from sensorloom.session import table


def tokens(line):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """rows with distinct (id, text), in the order of documents."""
    lines = [(d, k, tokens(x)) for d, (_, text) in enumerate(rows) if text is not None for k, x in enumerate(text.split("\n"))]
    holders, gone = {}, set()
    for d, k, s in lines:
        met = {}
        for t in s:
            for o in holders.get(t, ()):
                met[o] = met.get(o, 0) + 1
        if any(4 * c >= 3 * (len(s) + len(lines[o][2]) - c) for o, c in met.items()):
            gone.add((d, k))
        for t in s:
            holders.setdefault(t, []).append(len(holders_at))
        holders_at.append(None)
    return [(i, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if (d, k) not in gone)) for d, (i, text) in enumerate(rows)]


holders_at = []


def check(spark, rows):
    holders_at.clear()
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, print string, line int").repartition(3)
    got = line_dedup.drop_repeated_lines(docs, counts=("n_lines", "n_removed"))
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    out = got.collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(brute(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))), key=str)
    return out


def test_near_lines(spark):
    rng = random.Random(9)
    vocab = [f"u{k}" for k in range(3000)]
    base = [rng.choices(vocab, k=rng.choice([2, 4, 5, 9, 30, 60])) for _ in range(30)]
    rows = []
    for doc in range(90):
        lines = []
        for _ in range(rng.choice([0, 1, 3, 6])):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            lines.append(" ".join(w).capitalize())
        rows.append((doc * 3, "\n".join(lines)))
    rows += [(None, rows[7][1] + "\nthe end of all of this"), (1000, None), (1001, ""), (1002, "\n\n")]
    out = check(spark, rows)
    assert sum(r.n_removed for r in out) > 20


def test_given_table(spark, sf_dir):
    check(spark, [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()])


def test_equal_rows_and_empty(spark):
    line = "one two three four five six"
    docs = spark.createDataFrame([(5, line), (5, line), (6, line + "\n" + line), (7, line + " " + line)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == [(5, line), (5, line), (6, ""), (7, line + " " + line)]
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0


def test_short_lines(spark):
    rows = [(1, "All rights reserved.\nhome\n\none two three four"), (2, "all  rights reserved.\nHOME\n \nhome page\n\none two three five"), (3, "home\nreserved. rights all\none two three four five"), (4, None)]
    got = {r.doc_id: r.text for r in check(spark, rows)}
    assert got == {1: rows[0][1], 2: " \nhome page\n\none two three five", 3: "reserved. rights all\none two three four five", 4: None}


def test_many_near_lines_and_a_long_text(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(500)]
    base = rng.choices(vocab, k=60)
    rows = []
    for doc in range(300):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((doc, " ".join(w) + "\nthe line that everybody has\n" + " ".join(rng.choices(vocab, k=12))))
    # One text far beyond a slice, with lines of every length.
    rows.append((400, "\n".join(" ".join(rng.choices(vocab, k=rng.choice([1, 3, 8, 300]))) for _ in range(6000))))
    assert len(rows[-1][1]) > token_table.SLICE_BYTES
    check(spark, rows)


def test_all_small_sizes(spark):
    rows, n = [], 0
    for one in range(1, 11):
        for two in range(1, 11):
            for shared in range(1, min(one, two) + 1):
                a = [f"q{n}x{k}" for k in range(one + 4)]
                more = [f"q{n}y{k}" for k in range(two - shared)]
                b = a[-(shared + 4) :] + more if n % 2 else more + a[: shared + 4]
                rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
                n += 1
    out = {r.doc_id: r.n_removed for r in check(spark, [*rows, (10**6, "a b c d e f g"), (10**6 + 1, "a b c d e f g h"), (10**6 + 2, "0 a b c d e f g")])}
    assert out[10**6 + 1] == out[10**6 + 2] == 1


def test_shortened_hashes_only_propose(spark, monkeypatch):
    # With one byte for each token nearly all lines look alike; words decide.
    real = token_table.token_table
    monkeypatch.setattr(line_dedup, "token_table", lambda *a, **k: real(*a, **{**k, "width": 1}))
    test_near_lines(spark)
