"""Toxicity by noisy-channel deobfuscation.

1. A character language model (letter trigrams within words) is counted over all texts.
2. A token that may hide a word (leetspeak, separators between letters, letters repeated more
   than twice, or a run of single characters) becomes a lattice: what each character may stand
   for, or that it is only a separator or a repetition, at the channel's cost; a word may end
   at a separator, or anywhere in a run. Viterbi decoding under the language model restores
   the likeliest words. Signs at a token's end may be letters, too. Tokens over
   ``LONGEST_PLAIN`` characters and plain words before signs keep their raw words besides.
3. The restored text is scored: how often words begin with the markers learned from labelled
   texts, relative to its length, through a logistic regression.

Markers and regression are fitted on at most ``SAMPLE`` labelled rows, chosen by hash of their
key; the language model and the scores cover every row and whole texts.

Null and empty texts are scored like any text without markers. Labelled keys without a
document, and documents without a label, teach nothing. Of labels that disagree on a key any
toxic one counts. Without both kinds of labelled rows the score is the share of toxic ones
(0 if there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .vectors import matrix

SAMPLE = 20_000
MARKERS = 256
FIT_TASKS = 8  # that the sample is fitted in
LEAST_TOXIC = 5  # toxic sample texts a marker begins words of
LEAST_LIFT, LEAST_GAIN = 4.0, 20.0  # a marker's share of toxic texts over that of others; log-likelihood gained
PREFIXES = range(4, 9)
CACHE = 300_000

#: Letters of the language model; code 0 is everything else.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}
A = len(LETTERS) + 1

#: What a character may stand for besides itself. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
SEPARATORS = frozenset(".-_ *~'’/\\,:;·•")
#: Channel costs, as negative log-probabilities.
AS_LEET, AS_SEPARATOR, AS_REPEAT, KEPT_REPEAT, AS_NOISE, AS_BREAK = 1.0, 0.3, 0.7, 1.5, 9.0, 1.0
LONGEST_PLAIN = 24  # longer tokens may as well be numbers, addresses and keys: their raw words count, too
RUN = 3  # single characters in a row that may spell a word

_EDGES = ".,!?;:%&#\"'()[]{}<>*|$~-_`…«»“”"
_INNER = re.compile(r"[^\W\d_].*[\d@$!|+(€£*.\-_~'’/\\,:;·•].*[^\W\d_]|[\d@$!|+(€£*].*[^\W\d_].*[^\W\d_]"
                    r"|[^\W\d_].*[^\W\d_].*[\d@$!|+(€£]|[^\W\d_].*[@$!|+(€£]{2}|([^\W\d_])\1\1", re.S)
_WORDS = re.compile(r"[^\W\d_]+")
_THRICE = re.compile(r"(.)\1\1")


def _code_table() -> np.ndarray:
    table = np.zeros(0x180, np.int64)
    for c, i in CODES.items():
        table[ord(c)] = i
    return table


def trigram_counts(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Counts of letter trigrams; what comes before a word is code 0, twice."""
    total = np.zeros(A ** 3, np.int64)
    size, part = 0, []
    for i, text in enumerate(texts):
        part.append(text)
        size += len(text)
        if size > 1_000_000 or i == len(texts) - 1:
            raw = np.frombuffer(f"\n\n{'\n\n'.join(part).lower()}\n".encode("utf-32-le", "replace"), np.uint32)
            code = table[np.where(raw < len(table), raw, 0)]
            a, b, c = code[:-2], code[1:-1], code[2:]
            inside = (b > 0) | (c > 0)
            index = (np.where(b > 0, a, 0) * A + b) * A + c
            total += np.bincount(index[inside], minlength=A ** 3)
            size, part = 0, []
    return total


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log-probabilities (A, A, A) of a letter, or of the word's end, after two others."""

    def start():
        table = _code_table()

        def work(batch):
            counts = trigram_counts(common.texts(batch), table)
            seen = np.flatnonzero(counts)
            return [seen, counts[seen]]

        return work

    rows = common.map_batches(docs.select(F.col(text).alias("text")), start, "trigram int, n bigint")
    total = np.zeros(A ** 3)
    for row in rows.groupBy("trigram").agg(F.sum("n").alias("n")).toLocalIterator():  # A ** 3 rows at most
        total[row["trigram"]] = row["n"]
    three = total.reshape(A, A, A)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    base = (one + 1) / (one.sum() + A)
    pair = (two + 10 * base) / (two.sum(axis=1, keepdims=True) + 10)
    return np.log((three + 5 * pair[None]) / (three.sum(axis=2, keepdims=True) + 5))


def hides_word(token: str) -> bool:
    """Whether a lower-cased token, stripped at its edges, may be a disguised word."""
    return bool(_INNER.search(token))


def spelled(letters: tuple | None) -> str:
    """The letters of a path, which is linked from its end."""
    found = []
    while letters is not None:
        letters, letter = letters
        found.append(letter)
    return "".join(reversed(found))


def restore(token: str, logs: np.ndarray, breaks: str = "", signs: int = 0) -> str:
    """The likeliest word behind a token: Viterbi over its lattice. States are the last two codes.

    Where ``breaks`` is "separators" a word may end at a separator, where it is "anywhere" before
    any character; words are then joined by blanks. The last ``signs`` characters may be mere
    punctuation, other than those that stand for money.
    """
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    before, body = "", len(token) - signs
    for place, char in enumerate(token):
        if breaks and place and (breaks == "anywhere" or char in SEPARATORS):
            ended = min(((cost + AS_BREAK - logs[a, b, 0], word) for (a, b), (cost, word) in states.items() if b),
                        key=lambda x: x[0], default=None)
            if ended and states.get((0, 0), (math.inf,))[0] > ended[0]:
                states[0, 0] = (ended[0], (ended[1], " "))
        options = [(o, AS_LEET) for o in LEET.get(char, "")]
        drop = None
        if char in CODES:
            again = char == before
            options.append((char, KEPT_REPEAT if again else 0.0))
            drop = AS_REPEAT if again else None
        elif char in SEPARATORS or (place >= body and char not in "$€£@"):
            drop = AS_SEPARATOR
        else:
            drop = AS_NOISE
        reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, word) in states.items():
            if drop is not None and (old := reached.get((a, b), (math.inf,)))[0] > cost + drop:
                reached[a, b] = (cost + drop, word)
            for letter, price in options:
                c = CODES[letter]
                value = cost + price - logs[a, b, c]
                if reached.get((b, c), (math.inf,))[0] > value:
                    reached[b, c] = (value, (word, letter))
        states, before = reached, char
    best = min(((cost - logs[a, b, 0], word) for (a, b), (cost, word) in states.items()),
               key=lambda x: x[0], default=(0, None))
    return spelled(best[1])


class Restorer:
    """Tokens to words, each distinct token worked out once."""

    def __init__(self, logs: np.ndarray):
        self.logs = logs
        self.known: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        if (words := self.known.get(token)) is None:
            words = self.words(token)
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[token] = words
        return words

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a token, worked out anew."""
        core = token.strip(_EDGES)
        if core.isalpha() and not _THRICE.search(core):
            # letters alone hide nothing, unless a sign beside them may be a letter
            begin = token.index(core)
            end = begin + len(core)
            if token[begin - 1:begin] not in LEET and token[end:end + 1] not in LEET:
                return (core,)
        lead = token[:len(token) - len(token.lstrip(_EDGES))]
        if core and lead[-1:] in LEET and lead[-2:-1] != lead[-1:]:
            core = lead[-1:] + core  # one leading sign may be a letter in disguise
        # signs at the end may be letters; the word before them is kept if it says something plain
        rest = token[len(token.rstrip(_EDGES)):]
        tail = rest[:next((i for i, c in enumerate(rest) if c not in LEET), len(rest))]
        hides = bool(core) and hides_word(core)
        plain = () if hides else tuple(_WORDS.findall(token))
        whole = core + tail if core else core
        words = plain
        if whole and (hides_word(whole) if tail else hides):
            found = restore(whole, self.logs, "separators", len(tail)).split()
            if len(token) > LONGEST_PLAIN:
                plain = tuple(_WORDS.findall(token))
            words = (*found, *(w for w in dict.fromkeys(plain) if w not in found))
        return words

    def runs(self, tokens: list[str]) -> list[str]:
        """Words spelled by runs of single characters."""
        found, run = [], []
        for token in [*tokens, "  "]:
            if len(token) == 1 and (token in CODES or token in LEET):
                run.append(token)
                continue
            if len(run) >= RUN:
                one = restore("".join(run), self.logs)
                several = restore("".join(run), self.logs, "anywhere").split()
                found += [w for w in several if w != one] + [one]
            run = []
        return found

    def text(self, text: str) -> list[str]:
        """The words of a text, restored."""
        tokens = text.lower().split()
        words = [w for t in tokens for w in self.token(t)]
        return words + self.runs(tokens)


def features(word: str) -> list[str]:
    """Beginnings of a word, and the whole word with a mark."""
    return [word[:n] for n in PREFIXES if n < len(word)] + [word + "."] * (len(word) > 2)


def restored(docs: DataFrame, logs: np.ndarray, text: str = "text", into: str = "restored") -> DataFrame:
    """``docs`` with the words of the restored text, joined by blanks."""
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def start():
        restorer = Restorer(shared.value)
        return lambda batch: [*batch.columns[:-1],
                              [" ".join(restorer.text(t)) for t in common.texts(batch, "__text")]]

    keep = [c for c in docs.columns if c != into]
    ddl = ", ".join(f"`{c}` {common.kind(docs, c)}" for c in keep)
    return common.map_batches(docs.select(*keep, F.col(text).alias("__text")), start, f"{ddl}, `{into}` string")


def choose_markers(sample: DataFrame, count: int = MARKERS) -> list[str]:
    """Beginnings that tell toxic sample texts (``restored``, ``toxic``) best.

    One that begins or continues another is taken only if it is in more toxic texts than that.

    Two passes: what enough toxic texts have, then how many other texts have it too.
    """

    def texts_with(rows: DataFrame, among: set[str] | None) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(among)

        def start():
            known: dict[str, list[str]] = {}

            def work(batch):
                n, wanted = Counter(), shared.value
                for words in common.texts(batch, "restored"):
                    found = set()
                    for w in set(words.split()):
                        if (f := known.get(w)) is None:
                            f = known[w] = [x for x in features(w) if wanted is None or x in wanted]
                        found.update(f)
                    n.update(found)
                return [list(n.keys()), list(n.values())]

            return work

        return common.map_batches(rows.select("restored"), start, "feature string, n bigint").groupBy(
            "feature").agg(F.sum("n").alias("n"))

    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return []
    often = texts_with(sample.where("toxic = 1"), None).where(F.col("n") >= LEAST_TOXIC)
    often = often.orderBy(F.desc("n"), "feature").limit(100 * count)
    hits = {r["feature"]: r["n"] for r in often.collect()}
    misses = {r["feature"]: r["n"] for r in texts_with(sample.where("toxic = 0"), set(hits)).collect()}
    lift = {f: (n + 0.5) / toxic * clean / (misses.get(f, 0) + 0.5) for f, n in hits.items()}
    gain = {f: n * math.log(lift[f]) for f, n in hits.items() if lift[f] >= LEAST_LIFT}
    chosen: list[str] = []
    for f in sorted(gain, key=lambda f: (-round(gain[f], 6), -len(f), f)):
        word = f.rstrip(".")
        same = (c for c in chosen if word.startswith(c.rstrip(".")) or c.startswith(word))
        if gain[f] >= LEAST_GAIN and all(hits[f] > 1.1 * hits[c] for c in same):
            chosen.append(f)
            if len(chosen) == count:
                break
    return chosen


class Scorer:
    """Feature rows of texts: per marker the log of its count, then length and rates."""

    def __init__(self, markers: list[str], logs: np.ndarray):
        self.restorer = Restorer(logs)
        self.number = {m: i for i, m in enumerate(markers)}
        self.heads = {m[:PREFIXES[0]] for m in markers}
        self.place: dict[str, int] = {}
        self.marks: dict[int, list[int]] = {}  # of the places that have any
        self.counts = np.zeros((1 << 16, 3), np.int64)  # per place: words, marks or none, a single character

    def marks_of(self, word: str) -> list[int]:
        if (word + ".")[:PREFIXES[0]] not in self.heads:
            return []
        return [self.number[f] for f in features(word) if f in self.number]

    def learn(self, token: str) -> None:
        words = self.restorer.words(token)
        place = self.place[token] = len(self.place)
        if place == len(self.counts):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        marks = [m for w in words for m in self.marks_of(w)]
        if marks:
            self.marks[place] = marks
        self.counts[place] = len(words), bool(marks), len(token) == 1

    def rows(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.number) + 3))
        for row, text in zip(out, texts):
            tokens = text.lower().split()
            for t in set(tokens).difference(self.place):
                self.learn(t)
            at = np.fromiter(map(self.place.__getitem__, tokens), np.int64, len(tokens))
            found = self.counts[at]
            n = int(found[:, 0].sum())
            for i in at[found[:, 1] > 0].tolist():
                for m in self.marks[i]:
                    row[m] += 1
            single = found[:, 2] > 0
            if (single[:-2] & single[1:-1] & single[2:]).any():  # RUN of them
                for w in self.restorer.runs(tokens):
                    n += 1
                    for m in self.marks_of(w):
                        row[m] += 1
            hits = row[:-3].sum()
            row[-3:] = math.log1p(n) / 10, math.log1p(hits), min(100 * hits / max(n, 1), 10.0)
            if len(self.place) > CACHE:
                self.place.clear()
                self.marks.clear()
        out[:, :-3] = np.log1p(out[:, :-3])
        return out


def fit_logistic(rows: DataFrame, width: int, penalty: float = 0.3, rounds: int = 25) -> np.ndarray:
    """Weights of a logistic regression with a squared penalty, the intercept last (Newton's method).

    ``rows`` has ``x`` (``width`` numbers) and ``y``. Each round sums slope and curvature in the
    tasks; the driver solves one system of ``width + 1`` unknowns.
    """
    n = width + 1
    weights, ridge = np.zeros(n), np.full(n, penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(weights)

        def sums(batches):
            slope, curve = np.zeros(n), np.zeros((n, n))
            for batch in batches:
                x = np.hstack([matrix(batch.column("x")), np.ones((batch.num_rows, 1))])
                p = 1 / (1 + np.exp(-np.clip(x @ shared.value, -35, 35)))
                slope += x.T @ (p - batch.column("y").to_numpy())
                curve += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
            yield [(slope.tobytes(), curve.tobytes())]

        slope, curve = ridge * weights, np.diag(ridge)
        for part in common.map_arrow(rows, sums, "slope binary, curve binary").toLocalIterator():  # one per task
            slope = slope + np.frombuffer(part["slope"])
            curve = curve + np.frombuffer(part["curve"]).reshape(n, n)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def score(docs: DataFrame, labels: DataFrame, train: Column, key: str = "doc_id", sample_rows: int = SAMPLE,
          least: float = 0.7) -> DataFrame:
    """Per row of ``docs``: its key, ``held_out``, ``score`` and ``predicted`` (score >= ``least``).

    ``labels`` has the key and ``toxic``; only rows where ``train`` (on the key) holds teach.
    """
    spark = docs.sparkSession
    logs = language_model(docs)
    taught = labels.where(train & F.col("toxic").isNotNull()).groupBy(key).agg(F.max("toxic").alias("toxic"))
    taught = taught.orderBy(F.xxhash64(F.lit(10), key), key).limit(sample_rows)
    sample = docs.select(key, "text").join(F.broadcast(taught), key).dropDuplicates([key])
    sample = common.stored(restored(sample, logs).select("restored", "toxic"), "toxic-sample")
    markers = choose_markers(sample)

    def rows_of(frame: DataFrame, finish, columns: list[str], schema: str) -> DataFrame:
        shared = spark.sparkContext.broadcast((markers, logs))

        def start():
            scorer = Scorer(*shared.value)
            return lambda batch: [*(batch.column(c) for c in columns), finish(scorer.rows(common.texts(batch)))]

        return common.map_batches(frame, start, schema)

    shares = sample.agg(F.avg("toxic")).first()[0] or 0.0
    if markers:
        learned = rows_of(sample.select(F.col("restored").alias("text"), F.col("toxic").cast("double").alias("y")),
                          lambda x: list(x), ["y"], "y double, x array<double>")
        learned = common.stored(learned.repartition(FIT_TASKS), "toxic-features")
        weights = fit_logistic(learned, len(markers) + 3)
    else:
        weights = np.array([0.0] * 3 + [math.log(max(shares, 1e-9) / max(1 - shares, 1e-9))])

    def finish(x: np.ndarray):
        return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -35, 35)))

    asked = docs.select(F.col(key), F.coalesce(~train, F.lit(False)).alias("held_out"), "text")
    scored = rows_of(asked, finish, [key, "held_out"],
                     f"`{key}` {common.kind(docs, key)}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= least).cast("int"))
