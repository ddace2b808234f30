import random
import re
import time

from sensorloom.llm import licenses
from sensorloom.session import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_hundreds_of_rules():
    assert len(licenses.rules()) > 250
    assert len({r.label for r in licenses.rules()}) > 100


def test_base_counts(spark, sf_dir):
    rng = random.Random(2)
    words = "gnu general public license apache mit cc by the MIT License, GNU-General é 2.0".split()
    rows = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 400])))) for k in range(60)]
    rows += [(None, None), (100, "mit license mit license mit"), (101, "gnu general public license " * 5000), (101, "gnu general public license " * 5000)]
    rows += [(r.doc_id + 1000, r.text) for r in table(spark, sf_dir, "documents").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as base", "3 as found", "4 as id")
    got = licenses.digest(licenses.scan_licenses(docs)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    for r in got:
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def labels(text):
    return [r.label for _, _, r in licenses.scan(text.encode())[2]]


def test_rules_and_suppression():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("GNU General Public License as published by the Free Software Foundation, either version 2, or (at your option) any later version") == ["gpl-2.0-or-later"]
    assert labels("GNU Lesser General Public License v2.1 and GPL-3.0-only") == ["lgpl-2.1", "gpl-3.0-only"]
    assert labels("CC BY-NC-SA 4.0; cc-by") == ["cc-by-nc-sa-4.0", "cc-by-any"]
    assert labels("the mitigation of bsds") == []
    kept = licenses.scan(b"x MIT License y")[2]
    assert [(a, b) for a, b, _ in kept] == [(1, 3)]


def test_labels_against_all_rules(spark, sf_dir):
    """Every rule on every text without keyword gate, and suppression by its definition."""
    rng = random.Random(6)
    parts = ["MIT License", "the mit license", "licensed under the MIT", "GNU General Public License v3.0 or later", "gpl 3.0 only", "Apache License, Version 2.0", "apache license", "cc by-sa 4.0", "CC BY", "all rights reserved", "public domain", "bsd 3 clause", "free software", "x", "and", "Copyright (c) 2020"]
    rows = [(k, " ".join(rng.choices(parts, k=rng.choice([1, 4, 12])))) for k in range(80)]
    rows += [(r.doc_id + 1000, r.text) for r in table(spark, sf_dir, "documents").collect()]
    want = []
    for i, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        joined = " " + " ".join(words) + " "
        met = [(-r.priority, -(m.end() - m.start()), m.start(), k, m.end(), r) for k, r in enumerate(licenses.rules()) if r.keyword in joined for m in re.finditer(rb"(?<![^ ])(?:%s)(?![^ ])" % r.pattern.encode(), joined.encode())]
        kept = []
        for _, _, a, _, b, r in sorted(met, key=lambda x: x[:5]):
            if not any(x <= a and b <= y for x, y, _ in kept):
                kept.append((a, b, r))
        labels = {x for x in brute(text)[4].split(",") if x} | {r.label for *_, r in kept}
        want.append((i, ",".join(sorted(labels)), max([r.confidence for *_, r in kept] + [0.5 * bool(brute(text)[1])])))
    got = licenses.digest(licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.labels, r.score) for r in got) == sorted(want)


def test_a_long_text_of_repeats():
    began = time.process_time()
    n, base, found = licenses.scan(b"mit license, gpl 3.0 only; " * 200_000)
    assert (n, len(base), len(found)) == (1_200_000, 200_000, 600_000)
    assert found[-1][:2] == (1_199_996, 1_200_000)
    assert time.process_time() - began < 20
