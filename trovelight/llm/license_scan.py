"""Licence scans: phrases and identifier tags found by Aho-Corasick, expressions by shunting-yard.

Text: A-Z lower-cased (null: empty); words are runs of characters outside ASCII punctuation,
blanks and controls (``WORD``), numbered from 0.

* Phrases (``PHRASES`` base, ``NOTICES`` added): one automaton over the words joined by
  single blanks, each phrase padded by blanks, so a match is a run of whole consecutive
  words; every place counts, overlapping ones too.
* Identifier tags (``TAGS``): a second automaton over the lower-cased text finds each tag;
  the rest of its line is read as a licence expression: ids, ``and``, ``or``, ``with``,
  parentheses. A shunting-yard pass (``with`` binds tighter than ``and``, ``and`` tighter
  than ``or``) turns it into postfix, which is evaluated to the ids it names and its number
  of alternatives (``or`` adds, ``and`` multiplies). A malformed expression names nothing.
* ``labels``: base labels, notice labels and the families of the ids of valid expressions.
* ``score``: 1 - 2^-e, e = base places + notice places + valid expressions: 0 without
  evidence, towards 1 with more.

Defined cases: null or empty text gives 0 words and places, null first/last word and empty
label lists; a null doc_id is carried; repeated rows give repeated rows; very long texts are
scanned whole in time linear in their length.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import common

# Fixed values (the contract): base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice phrases this operator adds, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "eclipse public license": "epl",
    "creative commons": "cc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}

TAGS = ("spdx-license-identifier:", "@license ")

# Families of licence ids by prefix, longest prefix first.
FAMILIES = (("lgpl", "lgpl"), ("agpl", "agpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"),
            ("mpl", "mpl"), ("isc", "isc"), ("epl", "epl"), ("cc", "cc"), ("unlicense", "unlicense"))

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = regex.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, expressions string")


def family(license_id: str) -> str:
    for prefix, name in FAMILIES:
        if license_id.startswith(prefix):
            return name
    return license_id


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix tokens to postfix; None if parentheses do not balance."""
    out, stack = [], []
    for token in tokens:
        if token in PRECEDENCE:
            while stack and stack[-1] in PRECEDENCE and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            out.append(token)
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(tokens: list[str]) -> tuple[frozenset[str], int] | None:
    """Ids named (an exception after ``with`` is not an id) and the number of alternatives."""
    order = postfix(tokens)
    if not order:
        return None
    stack: list[tuple[frozenset[str], int, bool]] = []  # ids, alternatives, is a bare operand
    for token in order:
        if token not in PRECEDENCE:
            stack.append((frozenset([token]), 1, True))
            continue
        if len(stack) < 2:
            return None
        (right, b, bare), (left, a, _) = stack.pop(), stack.pop()
        if token == "with":
            if not bare:
                return None
            stack.append((left, a, False))
        else:
            stack.append((left | right, a + b if token == "or" else a * b, False))
    return (stack[0][0], stack[0][1]) if len(stack) == 1 else None


def expression_at(text: str, end: int) -> list[str]:
    """Tokens of the expression that follows a tag, up to the end of its line."""
    stop = len(text)
    for mark in "\n\r":
        found = text.find(mark, end)
        if found != -1:
            stop = min(stop, found)
    return TOKEN.findall(text, end, stop)


def _automata():
    import ahocorasick

    phrases = ahocorasick.Automaton()
    for table, kind in ((PHRASES, "base"), (NOTICES, "notice")):
        for phrase, label in table.items():
            key = f" {phrase} "
            old = phrases.get(key, ())
            phrases.add_word(key, old + ((kind, label, len(key)),))
    phrases.make_automaton()
    tags = ahocorasick.Automaton()
    for tag in TAGS:
        tags.add_word(tag, tag)
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None, automata) -> tuple:
    """``n_words, n_base, first_word, last_word, base_labels, labels, score, expressions``."""
    phrases, tags = automata
    lowered = (text or "").translate(LOWER)
    words = WORD.findall(lowered)
    joined = " " + " ".join(words) + " "
    starts = [0] * len(words)  # offset of each word in ``joined``
    at = 1
    for i, w in enumerate(words):
        starts[i], at = at, at + len(w) + 1
    base, base_labels, labels, notices = [], set(), set(), 0
    if words:
        for end, found in phrases.iter(joined):
            for kind, label, size in found:
                first = bisect.bisect_left(starts, end - size + 2)  # the word after the leading blank
                if kind == "base":
                    base.append(first)
                    base_labels.add(label)
                else:
                    notices += 1
                labels.add(label)
    valid, shown = 0, []
    for end, _tag in tags.iter(lowered):
        result = evaluate(expression_at(lowered, end + 1))
        if result is not None:
            ids, alternatives = result
            valid += 1
            labels.update(family(i) for i in ids)
            shown.append(f"{'|'.join(sorted(ids))}#{alternatives}")
    evidence = len(base) + notices + valid
    return (len(words), len(base), min(base) if base else None, max(base) if base else None,
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - 0.5 ** evidence, ";".join(shown))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): the columns of ``SCHEMA``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def start():
        automata = _automata()

        def work(batch: pa.RecordBatch):
            found = [scan_text(t, automata) for t in batch.column("text").to_pylist()]
            return [batch.column("doc_id")] + [list(c) for c in zip(*found)] if found else [batch.column("doc_id")] + [[]] * 8

        return work

    return common.map_batches(rows, start, SCHEMA)
