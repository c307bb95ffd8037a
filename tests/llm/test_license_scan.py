"""Licence scans against a plain scan of word windows and a recursive-descent reader."""

import re

import pytest

from trovelight.llm import license_scan
from trovelight.llm.queries import op13_license_scan

SCHEMA = "doc_id long, text string, lang string, labels string, score double"


def brute_phrases(words, table):
    found = []
    for phrase, label in table.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
    return found


def read(tokens):
    """Recursive descent: or of ands of (with-)terms; None if malformed."""
    pos = 0

    def term():
        nonlocal pos
        if pos < len(tokens) and tokens[pos] == "(":
            pos += 1
            got = disjunction()
            if got is None or pos >= len(tokens) or tokens[pos] != ")":
                return None
            pos += 1
            return got
        if pos < len(tokens) and tokens[pos] not in ("(", ")", "and", "or", "with"):
            ids = {tokens[pos]}
            pos += 1
            if pos < len(tokens) and tokens[pos] == "with":
                if pos + 1 >= len(tokens) or tokens[pos + 1] in ("(", ")", "and", "or", "with"):
                    return None
                pos += 2
            return ids, 1
        return None

    def conjunction():
        nonlocal pos
        got = term()
        while got is not None and pos < len(tokens) and tokens[pos] == "and":
            pos += 1
            right = term()
            got = None if right is None else (got[0] | right[0], got[1] * right[1])
        return got

    def disjunction():
        nonlocal pos
        got = conjunction()
        while got is not None and pos < len(tokens) and tokens[pos] == "or":
            pos += 1
            right = conjunction()
            got = None if right is None else (got[0] | right[0], got[1] + right[1])
        return got

    got = disjunction()
    return got if pos == len(tokens) else None


def brute(text):
    lowered = (text or "").translate(license_scan.LOWER)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    base = brute_phrases(words, license_scan.PHRASES)
    notices = brute_phrases(words, license_scan.NOTICES)
    labels = {label for _, label in base + notices}
    valid = 0
    for tag in license_scan.TAGS:
        for m in re.finditer(re.escape(tag), lowered):
            line = re.split("[\n\r]", lowered[m.end():], maxsplit=1)[0]
            got = read(re.findall(r"\(|\)|[a-z0-9][a-z0-9.+:-]*", line))
            if got is not None:
                valid += 1
                labels |= {license_scan.family(i) for i in got[0]}
    places = [i for i, _ in base]
    return (len(words), len(base), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)),
            1.0 - 0.5 ** (len(base) + len(notices) + valid))


TEXTS = [
    "The MIT License (MIT)\nPermission is hereby granted, free of charge, to any person",
    "Licensed under the Apache License, Version 2.0; see APACHE-LICENSE too.",
    "GNU LESSER General Public License v3, also the GNU Affero General Public License",
    "// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) OR MIT AND Apache-2.0\nint x;",
    "SPDX-License-Identifier: MIT OR (BSD-3-Clause\nbroken", "/** @license MPL-2.0 */", "@license with or and",
    "mit license mit license mit", "MIT\tlicense", "nothing here", "", None, "Ünïcode mitlicense mit_license",
    "général public license général", "x" * 200_000, ("word " * 30_000) + "apache license",
]


@pytest.mark.parametrize("text", TEXTS)
def test_scan_equals_brute_force(text):
    got = license_scan.scan_text(text, license_scan._automata())
    assert got[:7] == brute(text)


def test_shunting_yard_binds_with_and_or():
    assert license_scan.evaluate("a or b and c".split()) == (frozenset("abc"), 2)
    assert license_scan.evaluate("( a or b ) and ( c or d )".split()) == (frozenset("abcd"), 4)
    assert license_scan.evaluate("a with e and b".split()) == (frozenset("ab"), 1)
    for bad in ("a or", "( a", "a )", "a with ( b or c )", "", "and"):
        assert license_scan.evaluate(bad.split()) is None


def test_rows_and_awkward_ones(spark):
    rows = [(i, t, "en", "clash", 0.5) for i, t in enumerate(TEXTS)] + [(None, "mit license", None, None, None)] * 2
    got = license_scan.scan_licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_row = sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r)[1:8]) for r in got)
    want = sorted((i if i is not None else -1, brute(t)) for i, t, *_ in rows)
    assert by_row == want


def test_empty_table(spark):
    assert license_scan.scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_on_smallest_tables(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = op13_license_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    assert all(tuple(r)[1:8] == brute(docs[r["doc_id"]]) for r in got)
