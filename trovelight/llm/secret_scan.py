"""Secret scans: keyword automaton, anchored patterns near its hits, checksum validation.

One Aho-Corasick pass over the ASCII-folded text finds the places where a secret can start;
only there an anchored pattern is tried. Runs of hex digits and of decimal digits have no
keyword, so the text is also mapped to character classes, in which a long run *is* a keyword.
Candidates of kinds that carry a checksum count only if it holds.

Spans are code points, end exclusive. Kinds:

* ``assign``, ``access``, ``hex``: by pattern and length alone;
* ``card``: 13 to 19 digits with a valid Luhn sum, not inside a longer run of digits;
* ``iban``: country, check digits and 11 to 30 further characters, valid modulo 97;
* ``github``: a GitHub token whose last six characters are the base-62 CRC-32 of the rest.

Null and empty texts have no spans. A document with several kinds at one place keeps all.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
from pyspark.sql import Column, DataFrame, functions as F

from . import common

KINDS = ("assign", "access", "hex", "card", "iban", "github")
BASE = KINDS[:3]
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
DIGITS = re.compile(rb"[0-9]+")
IBAN = re.compile(rb"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
GITHUB = re.compile(rb"gh[pousr]_[0-9A-Za-z]{36}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

ASSIGN_MIN, ACCESS_MIN, HEX_MIN, CARD_MIN, CARD_MAX = 6, 20, 24, 13, 19
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
}

_WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_AS_HEX = bytes(72 if chr(b) in "0123456789abcdef" else 46 for b in range(256))
_AS_DIGIT = bytes(68 if chr(b) in "0123456789" else 46 for b in range(256))
_AS_SHAPE = bytes(68 if chr(b) in "0123456789" else 65 if chr(b) in BASE62[10:36] else 46 for b in range(256))


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(text: bytes) -> bool:
    return int("".join(str(int(chr(b), 36)) for b in text[4:] + text[:4])) % 97 == 1


def github_valid(token: bytes) -> bool:
    n, tail = zlib.crc32(token[4:-6]), ""
    while n:
        n, d = divmod(n, 62)
        tail = BASE62[d] + tail
    return tail.rjust(6, "0").encode() == token[-6:]


def _automaton():
    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def _runs(text: bytes, classes: bytes, keyword: bytes, pattern: re.Pattern):
    """Maximal runs of one character class that are at least ``keyword`` long."""
    shape = text.translate(classes)
    at = shape.find(keyword)
    while at >= 0:
        match = pattern.match(text, at)
        yield match
        at = shape.find(keyword, match.end())


def _alone(text: bytes, start: int, end: int) -> bool:
    return (start == 0 or text[start - 1] not in _WORD) and (end == len(text) or text[end] not in _WORD)


def scan_text(text: str, automaton) -> list[tuple[str, int, int]]:
    """All spans of one text by start, then by kind as listed."""
    raw = text.encode("ascii", "replace")  # one byte per code point; no pattern holds "?"
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in automaton.iter(raw.lower().decode("ascii")):
        hits.setdefault(kind, []).append(last - length + 1)
    found = []
    for kind, pattern, keep in (
        ("assign", ASSIGN, lambda m: m.end(2) - m.start(2) >= ASSIGN_MIN),
        ("access", ACCESS, lambda m: m.end() - m.start() >= ACCESS_MIN),
        ("github", GITHUB, lambda m: _alone(raw, *m.span()) and github_valid(m.group())),
    ):
        free = 0
        for at in sorted(hits.get(kind, ())):
            if at >= free and (match := pattern.match(raw, at)):
                free = match.end()
                if keep(match):
                    found.append((kind, *match.span()))
    found += [("hex", *m.span()) for m in _runs(raw, _AS_HEX, b"H" * HEX_MIN, HEX)]
    for m in _runs(raw, _AS_DIGIT, b"D" * CARD_MIN, DIGITS):
        if m.end() - m.start() <= CARD_MAX and _alone(raw, *m.span()) and luhn(m.group()):
            found.append(("card", *m.span()))
    shape, at, free = raw.translate(_AS_SHAPE), -1, 0
    while (at := shape.find(b"AADD", at + 1)) >= 0:
        match = IBAN.match(raw, at) if at >= free else None
        if match and _alone(raw, *match.span()) and iban_valid(match.group()):
            found.append(("iban", *match.span()))
            free = match.end()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: its key and ``spans``, the secrets of its whole text."""

    def start():
        automaton = _automaton()

        def work(batch):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, automaton)]
                     for t in common.texts(batch)]
            return [batch.column(0), spans]

        return work

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return common.map_batches(rows, start, f"`{key}` {common.kind(docs, key)}, spans {SPANS}")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select(
        key, *(count(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``n_chars`` follows the text.

    Spans that overlap are replaced together. Every document stays; one without secrets
    keeps its text, and null stays null.
    """

    def start():
        automaton = _automaton()

        def clean(text: str | None) -> str | None:
            spans = scan_text(text, automaton) if text else []
            if not spans:
                return text
            parts, at = [], 0
            for _, a, b in spans:
                if a >= at:
                    parts += [text[at:a], mark]
                at = max(at, b)
            return "".join(parts) + text[at:]

        def work(batch):
            place = batch.schema.get_field_index("text")
            return [[clean(t) for t in c.to_pylist()] if i == place else c for i, c in enumerate(batch.columns)]

        return work

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cleaned = common.map_batches(docs, start, ddl)
    if "n_chars" in docs.columns:
        counted = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return cleaned
