"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; rules are patterns over the words
joined by single blanks. Each rule has a keyword; only rules whose keyword occurs in a text are tried. Each match is an
interval of words with the rule's label, priority and confidence. Rules are ordered: more specific ones have a higher
priority. A match that lies inside an interval of a kept match of higher priority, or of the same priority and earlier
place or greater length, is suppressed; matches that only overlap are both kept.

The base phrases are counted apart from that at every place where their words stand consecutively, and their labels
stay. A null text is empty and an empty text has no words; null ids pass; each row is judged by itself, so repeated rows
repeat. There is no shuffle; a long text costs its own length in its own task.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.text import alnum_words, byte_values

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


_LIC = "licen[cs]e"
_VER = r"(?:(?: as published by the free software foundation)?(?: either)? version| v| ver)?"


def _gnu() -> Iterator[Rule]:
    """GNU licences: name, short name and identifier, for each version, with and without what may follow it."""
    families = {
        "gpl": (r"gnu general public " + _LIC, ("1 0", "2 0", "3 0")),
        "lgpl": (r"gnu (?:lesser|library) general public " + _LIC, ("2 0", "2 1", "3 0")),
        "agpl": (r"gnu affero general public " + _LIC, ("1 0", "3 0")),
        "gfdl": (r"gnu free documentation " + _LIC, ("1 1", "1 2", "1 3")),
    }
    for short, (name, versions) in families.items():
        for version in versions:
            major, minor = version.split()
            number = rf"{major}(?: {minor})?" if minor == "0" else rf"{major} {minor}"
            label = f"{short}-{major}.{minor}"
            yield Rule(f"{label}-or-later", "public" if short != "gfdl" else "documentation", rf"{name}{_VER} ?{number} or(?: at your option)?(?: any)? later", 90, 1.0)
            yield Rule(f"{label}-or-later", short, rf"{short} ?v?{number} (?:or later|plus)", 85, 1.0)
            yield Rule(f"{label}-only", short, rf"{short} {number} only", 85, 1.0)
            yield Rule(label, "public" if short != "gfdl" else "documentation", rf"{name}{_VER} ?{number}", 80, 0.95)
            yield Rule(label, short, rf"{short} ?v?(?:ersion )?{number}", 75, 0.9)
        yield Rule(f"{short}-any", "public" if short != "gfdl" else "documentation", name, 40, 0.8)
        yield Rule(f"{short}-mention", short, rf"(?:under|license|licence|licensed)(?: the)?(?: gnu)? {short}", 30, 0.6)


def _creative_commons() -> Iterator[Rule]:
    """Creative Commons: every combination of terms, each version, by name, short name and address."""
    parts = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?(?: works)?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
    for short, name in parts.items():
        dashed = short.replace(" ", "-")
        depth = short.count(" ")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            label = f"cc-{dashed}-{version.replace(' ', '.')}"
            yield Rule(label, "cc", rf"cc {short} {version}", 80 + depth, 1.0)
            yield Rule(label, "creative", rf"creative ?commons {name} {version}(?: international| unported| generic)?(?: public)?(?: {_LIC})?", 80 + depth, 1.0)
            yield Rule(label, "creativecommons", rf"creativecommons org licenses {short} {version}", 80 + depth, 1.0)
        yield Rule(f"cc-{dashed}-any", "cc", rf"cc {short}", 40 + depth, 0.8)
        yield Rule(f"cc-{dashed}-any", "creative", rf"creative ?commons {name}", 40 + depth, 0.8)
    yield Rule("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", 80, 0.95)
    yield Rule("cc0-1.0", "publicdomain", r"creativecommons org publicdomain zero 1 0", 85, 1.0)
    yield Rule("cc-any", "creative", r"creative ?commons", 10, 0.4)


def _versioned() -> Iterator[Rule]:
    """Named licences with numbered versions: name, keyword, short name, versions."""
    named = (
        ("apache", "apache", rf"apache(?: software)? {_LIC}", "apache", ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", rf"mozilla public {_LIC}", "mpl", ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", rf"eclipse public {_LIC}", "epl", ("1 0", "2 0")),
        ("cddl", "distribution", rf"common development and distribution {_LIC}", "cddl", ("1 0", "1 1")),
        ("cpl", "common", rf"common public {_LIC}", "cpl", ("1 0",)),
        ("eupl", "european", rf"european union public {_LIC}", "eupl", ("1 0", "1 1", "1 2")),
        ("osl", "open", rf"open software {_LIC}", "osl", ("1 0", "2 0", "2 1", "3 0")),
        ("afl", "academic", rf"academic free {_LIC}", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
        ("artistic", "artistic", rf"artistic {_LIC}", "artistic", ("1 0", "2 0")),
        ("bsl", "boost", rf"boost software {_LIC}", "bsl", ("1 0",)),
        ("ofl", "sil", rf"sil open font {_LIC}", "ofl", ("1 0", "1 1")),
        ("lppl", "latex", rf"latex project public {_LIC}", "lppl", ("1 0", "1 1", "1 2", "1 3")),
        ("php", "php", rf"php {_LIC}", "php", ("3 0", "3 01")),
        ("python", "python", rf"python(?: software foundation)? {_LIC}", "psf", ("2 0",)),
        ("zpl", "zope", rf"zope public {_LIC}", "zpl", ("1 1", "2 0", "2 1")),
        ("qpl", "q public", rf"q public {_LIC}", "qpl", ("1 0",)),
        ("apsl", "apple", rf"apple public source {_LIC}", "apsl", ("1 0", "1 1", "1 2", "2 0")),
        ("ibm-pl", "ibm", rf"ibm public {_LIC}", "ipl", ("1 0",)),
        ("npl", "netscape", rf"netscape public {_LIC}", "npl", ("1 0", "1 1")),
        ("sspl", "server side", rf"server side public {_LIC}", "sspl", ("1",)),
        ("busl", "business", rf"business source {_LIC}", "busl", ("1 1",)),
        ("elastic", "elastic", rf"elastic {_LIC}", "elastic", ("2 0",)),
        ("odbl", "database", rf"open database {_LIC}", "odbl", ("1 0",)),
        ("odc-by", "commons", rf"open data commons attribution {_LIC}", "odc by", ("1 0",)),
        ("cecill", "cecill", rf"cecill(?: free software)?(?: {_LIC})?(?: agreement)?", "cecill", ("1 0", "2 0", "2 1")),
        ("ms-pl", "microsoft", rf"microsoft public {_LIC}", "ms pl", ()),
        ("ms-rl", "microsoft", rf"microsoft reciprocal {_LIC}", "ms rl", ()),
        ("rpl", "reciprocal", rf"reciprocal public {_LIC}", "rpl", ("1 1", "1 5")),
        ("spl", "sun", rf"sun public {_LIC}", "spl", ("1 0",)),
        ("openssl", "openssl", rf"openssl {_LIC}", "openssl", ()),
    )
    for label, keyword, name, short, versions in named:
        for version in versions:
            number = version if not version.endswith(" 0") else rf"{version[:-2]}(?: 0)?"
            own = f"{label}-{version.replace(' ', '.')}"
            yield Rule(own, keyword, rf"{name}(?: version| v)? ?{number}", 80, 0.95)
            yield Rule(own, short.split()[0], rf"{short} ?v?{version}", 75, 0.9)
        yield Rule(f"{label}-any", keyword, name, 40, 0.8)


#: Signatures written one by one: label, keyword, pattern, priority, confidence.
_SINGLE = (
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy of this software", 95, 1.0),
    ("mit", "without restriction", r"to deal in the software without restriction including without limitation the rights", 90, 1.0),
    ("mit-any", "mit", rf"(?:the )?mit {_LIC}", 60, 0.9),
    ("mit-any", "expat", rf"expat {_LIC}", 60, 0.9),
    ("mit-any", "mit", rf"(?:licensed|released|distributed) under(?: the)?(?: terms of)?(?: the)? mit", 55, 0.85),
    ("x11", "x11", rf"x11 {_LIC}", 60, 0.9),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 95, 1.0),
    ("isc-any", "isc", rf"isc {_LIC}", 60, 0.9),
    ("bsd-any", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 70, 0.9),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software without specific prior written permission", 90, 1.0),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display", 92, 1.0),
    ("bsd-2-clause", "bsd", r"bsd 2 clause|2 clause bsd|simplified bsd|freebsd licen[cs]e", 80, 0.95),
    ("bsd-3-clause", "bsd", r"bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd", 80, 0.95),
    ("bsd-4-clause", "bsd", r"bsd 4 clause|4 clause bsd|original bsd", 80, 0.95),
    ("0bsd", "0bsd", r"0bsd", 80, 0.95),
    ("bsd-any", "bsd", rf"bsd(?: style)? {_LIC}", 40, 0.8),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such", 90, 1.0),
    ("zlib", "zlib", rf"zlib(?: libpng)? {_LIC}", 60, 0.9),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 95, 1.0),
    ("unlicense", "unlicense", r"(?:the )?unlicense", 60, 0.85),
    ("wtfpl", "wtfpl", r"wtfpl", 60, 0.9),
    ("wtfpl", "what the", r"do what the f\w* you want to public licen[cs]e", 90, 1.0),
    ("beerware", "beer", r"beer ?ware licen[cs]e", 60, 0.9),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 60, 0.85),
    ("public-domain", "public domain", r"public domain", 20, 0.5),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 90, 1.0),
    ("apache-2.0", "apache", r"www apache org licenses license 2 0", 90, 1.0),
    ("gpl-any", "free software", r"this program is free software you can redistribute it and or modify", 70, 0.9),
    ("lgpl-any", "free software", r"this library is free software you can redistribute it and or modify", 72, 0.9),
    ("no-warranty", "warranty", r"without (?:even )?(?:the implied warranty|warranty of any kind|warranties or conditions of any kind)", 20, 0.4),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved", 15, 0.3),
    ("copyright-notice", "copyright", r"copyright(?: c)? (?:19|20)\d\d", 15, 0.3),
    ("proprietary", "proprietary", r"proprietary and confidential|proprietary licen[cs]e", 50, 0.7),
    ("spdx-tag", "spdx", r"spdx license identifier(?: [a-z0-9]+){1,4}", 30, 0.8),
    ("icu", "icu", rf"icu {_LIC}", 50, 0.8),
    ("vim", "vim", rf"vim {_LIC}", 50, 0.8),
    ("ruby", "ruby", rf"ruby {_LIC}", 50, 0.8),
    ("curl", "curl", rf"curl {_LIC}", 50, 0.8),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", 60, 0.9),
    ("upl-1.0", "universal", r"universal permissive licen[cs]e(?: version| v)?(?: 1 0)?", 60, 0.9),
    ("hpnd", "historical", r"historical permission notice and disclaimer", 60, 0.9),
    ("ecl-2.0", "educational", r"educational community licen[cs]e(?: version)?(?: 2 0)?", 60, 0.9),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e", 60, 0.9),
    ("ogl-uk", "open government", r"open government licen[cs]e", 60, 0.9),
)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first; among equals the order written here."""
    own = [*_gnu(), *_creative_commons(), *_versioned(), *(Rule(*r) for r in _SINGLE)]
    return tuple(sorted(own, key=lambda r: -r.priority))


@functools.cache
def _compiled() -> tuple[tuple[str, tuple[tuple[int, Rule, re.Pattern], ...]], ...]:
    by: dict[str, list] = {}
    for k, rule in enumerate(rules()):
        by.setdefault(rule.keyword, []).append((k, rule, re.compile(rf"(?<![^ ])(?:{rule.pattern})(?![^ ])".encode())))
    return tuple((k, tuple(v)) for k, v in by.items())


@functools.cache
def _gate() -> re.Pattern:
    """Keywords of the rules, longest first, as one pattern: most texts hold none and are done after one search."""
    return re.compile("|".join(sorted((re.escape(k) for k, _ in _compiled()), key=len, reverse=True)).encode())


def _maximal(found: np.ndarray) -> np.ndarray:
    """Which of the rows (priority, rule, begin, end) stay: those inside no other of higher priority, nor of the same
    priority that is longer or, if equal, comes first. Being inside is transitive, so only what stays has to be asked."""
    order = np.lexsort((found[:, 1], -found[:, 3], found[:, 2], -found[:, 0]))
    stays: list[np.ndarray] = []
    begins, reach = np.empty(0, np.int64), np.empty(0, np.int64)
    for own in np.split(order, np.flatnonzero(np.diff(found[order, 0])) + 1):
        begin, end = found[own, 2], found[own, 3]
        # The furthest end of earlier ones that begin here or before; within a priority rows are sorted by begin, longest first.
        before = np.r_[np.int64(-1), reach][np.searchsorted(begins, begin, "right")]
        inside = np.maximum(before, np.r_[np.int64(-1), np.maximum.accumulate(end)[:-1]]) >= end
        stays.append(own[~inside])
        kept = np.concatenate(stays)
        kept = kept[np.argsort(found[kept, 2], kind="stable")]
        begins, reach = found[kept, 2], np.maximum.accumulate(found[kept, 3])
    return np.concatenate(stays)


def detections(text: bytes) -> list[tuple[int, int, Rule]]:
    """Kept matches (first and last byte in the joined words, rule), in order of place."""
    found = []
    for keyword, own in _compiled():
        if keyword.encode() in text:
            for k, rule, pattern in own:
                found += [(rule.priority, k, *m.span()) for m in pattern.finditer(text)]
    if not found:
        return []
    rows = np.array(found, np.int64)
    rows = rows[_maximal(rows)]
    rows = rows[np.lexsort((rows[:, 1], rows[:, 3], rows[:, 2]))]
    return [(a, b, rules()[k]) for _, k, a, b in rows.tolist()]


def base_places(text: bytes) -> list[tuple[int, str]]:
    """(first byte, label) of every base phrase; ``text`` has a blank at both ends."""
    out = []
    for phrase, label in BASE.items():
        sign, at = f" {phrase} ".encode(), -1
        while (at := text.find(sign, at + 1)) >= 0:
            out.append((at + 1, label))
    return sorted(out)


def scan(text: bytes) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, Rule]]]:
    """Number of words; base places (word, label); detections (first word, one past the last, rule)."""
    words = alnum_words(text)
    joined = b" " + b" ".join(words) + b" "
    base = base_places(joined)
    found = detections(joined) if _gate().search(joined) else []
    if not base and not found:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    word = lambda at: (np.searchsorted(blanks, np.array(at, np.int64)) - 1).tolist()
    firsts, lasts = word([a for a, _, _ in found]), word([b for _, b, _ in found])
    placed = list(zip(word([a for a, _ in base]), (label for _, label in base), strict=True))
    return len(words), placed, [(a, b + 1, rule) for a, b, (_, _, rule) in zip(firsts, lasts, found, strict=True)]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, base (array of word, label), found (array of first, last, label, priority, confidence).

    Words count from 0, ``last`` is one past the last word.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, base array<struct<word:bigint,label:string>>, found array<struct<first:bigint,last:bigint,label:string,priority:int,confidence:double>>"
    base_type = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("confidence", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [scan(t) for t in byte_values(batch["text"])]
            base = [[{"word": w, "label": x} for w, x in g[1]] for g in got]
            found = [[{"first": a, "last": b, "label": r.label, "priority": r.priority, "confidence": r.confidence} for a, b, r in g[2]] for g in got]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([g[0] for g in got], pa.int64()), pa.array(base, base_type), pa.array(found, found_type)], ["id", "n_words", "base", "found"])

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of ``scan_licenses``; score: the highest confidence, at least 0.5 with a base phrase."""
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    base = F.size("base").cast("bigint")
    return found.select(
        id_col,
        "n_words",
        base.alias("n_base"),
        F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "found.label")).alias("labels"),
        F.greatest(F.coalesce(F.array_max("found.confidence"), F.lit(0.0)), F.when(base > 0, 0.5).otherwise(0.0)).alias("score"),
    )
