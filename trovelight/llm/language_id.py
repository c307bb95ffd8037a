"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities for the pieces of one fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces of the product of their
probabilities, computed by a forward algorithm; a text's is the product over its words.
Words are lower-cased runs of letters; what stands between them says nothing of a language.

Fitting counts every word of every labelled text once per language (a Spark aggregation),
then takes expected piece counts over all segmentations (forward and backward, one pass over
the distinct words per round). What reaches the driver is one number per language and piece.

Both passes walk the vocabulary's trie for a whole batch of words of one length at a time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from . import common
from .token_count import MARK, pieces

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
SMOOTHING = 200.0
CACHE = 160_000  # tokens of two generations
SLICE = 8_192  # words of one length that are walked together
CHARACTERS = 1 << 20  # of texts that are split into tokens at a time


@dataclass
class Trie:
    """The vocabulary as transition arrays; node 0 is dead, node 1 the root.

    ``step`` has a column for each character that some piece of several characters holds, and
    column 0 for all others. Those are walked from the root only, to nodes of their own if
    they are pieces, else to the last node: the piece ``other``, number 1.
    """

    chars: dict[str, int] = field(default_factory=dict)
    step: np.ndarray | None = None
    piece: np.ndarray | None = None  # number of the piece that ends at a node, 0: none
    depth: int = 1
    size: int = 2
    table: np.ndarray | None = None  # character numbers by code point; the last one is of all beyond

    @classmethod
    def of(cls, vocabulary: list[str]) -> Trie:
        """Keeps the pieces that lower-cased words of letters can hold."""
        kept = [p for p in vocabulary if p == p.lower() and LETTERS.fullmatch(p.removeprefix(MARK) or "a")]
        long = [p for p in kept if len(p) > 1]
        core = sorted({c for p in long for c in p})
        alone = sorted({c for p in kept for c in p}.difference(core))
        paths: dict[str, int] = {"": 1}
        for p in (*core, *long):
            for i in range(1, len(p) + 1):
                paths.setdefault(p[:i], len(paths) + 1)
        nodes = len(paths) + 1
        trie = cls({c: i + 1 for i, c in enumerate(core)})
        trie.chars |= {c: -(nodes + i) for i, c in enumerate(alone)}  # the negated node
        trie.step = np.zeros((nodes, len(core) + 1), np.uint16 if nodes < 1 << 16 else np.int32)
        for path, node in paths.items():
            if path:
                trie.step[paths[path[:-1]], trie.chars[path[-1]]] = node
        trie.piece = np.zeros(nodes + len(alone) + 1, np.int32)
        trie.piece[-1] = 1
        # a character that is no piece by itself is the piece ``other`` where it stands alone
        trie.piece[[paths[c] for c in core]] = 1
        for number, p in enumerate(kept):
            trie.piece[paths[p] if p in paths else -trie.chars[p]] = number + 2
        trie.depth, trie.size = max(map(len, kept), default=1), len(kept) + 2
        trie.table = np.full(max(map(ord, trie.chars), default=0) + 2, -(len(trie.piece) - 1), np.int32)
        trie.table[[ord(c) for c in trie.chars]] = list(trie.chars.values())
        return trie

    def codes(self, words: list[str]) -> np.ndarray:
        """Character numbers of words of one length, a row each."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
        return self.table[np.minimum(points, len(self.table) - 1)]

    def walk(self, codes: np.ndarray, start: int):
        """Yields (end, pieces) for the pieces that open at ``start`` in any of the words."""
        column = np.maximum(codes, 0)
        node = self.step[1, column[:, start]].astype(np.int32)
        first = codes[:, start]
        yield start + 1, self.piece[np.where(first < 0, -first, node)]
        for end in range(start + 1, min(codes.shape[1], start + self.depth)):
            node = self.step[node, column[:, end]]
            if not node.any():
                return
            yield end + 1, self.piece[node]


def by_length(words: list[str]):
    """Index arrays of words of one length, ``SLICE`` at most in each."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        for at in range(0, len(group), SLICE):
            yield group[at:at + SLICE]


def log_likelihoods(trie: Trie, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """Log of the sum over segmentations, a row per word and a column per language.

    ``probs`` has a row per piece; row 0 is zero. Values are rescaled on the way, so words of
    any length keep their precision.
    """
    out = np.zeros((len(words), probs.shape[1]))
    for group in by_length(words):
        codes = trie.codes([MARK + words[i] for i in group])
        n = codes.shape[1]
        reach = min(n, trie.depth) + 1
        alpha = np.zeros((reach, len(group), probs.shape[1]))  # a ring: place i is at i % reach
        alpha[0], scale = 1.0, np.zeros((len(group), probs.shape[1]))
        for i in range(n):
            here = alpha[i % reach]
            if i % 8 == 7:
                top = alpha.max(axis=0)
                top[top == 0] = 1.0
                alpha /= top
                scale += np.log(top)
            for end, found in trie.walk(codes, i):
                alpha[end % reach] += here * probs[found]
            here[:] = 0.0
        out[group] = np.log(np.maximum(alpha[n % reach], 1e-300)) + scale
    return out


def expected_counts(trie: Trie, probs: np.ndarray, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece in ``words``, each word counted ``weights`` times."""
    total = np.zeros(trie.size)
    for group in by_length(words):
        codes = trie.codes([MARK + words[i] for i in group])
        n = codes.shape[1]
        links = [(i, end, found) for i in range(n) for end, found in trie.walk(codes, i)]
        alpha, beta = np.zeros((n + 1, len(group))), np.zeros((n + 1, len(group)))
        alpha[0] = beta[n] = 1.0
        # a word is divided by its own mean step, which cancels in the posterior
        for i, end, found in links:
            alpha[end] += alpha[i] * probs[found] * _STEP ** (end - i)
        for i, end, found in reversed(links):
            beta[i] += beta[end] * probs[found] * _STEP ** (end - i)
        share = weights[group] / np.maximum(alpha[n], 1e-300)
        for i, end, found in links:
            use = alpha[i] * probs[found] * _STEP ** (end - i) * beta[end] * share
            total += np.bincount(found, use, trie.size)
    total[0] = 0.0
    return total


_STEP = 20.0  # keeps products of piece probabilities near 1 for words of usual lengths
LONGEST = 64  # longer runs of letters are fitted in parts of this length


@dataclass
class Model:
    """Languages in order and the logarithm-free piece probabilities, a column for each."""

    languages: list[str]
    trie: Trie
    probs: np.ndarray


def fit(docs: DataFrame, label: str = "lang", text: str = "text", model: str | None = None,
        rounds: int = 1) -> Model:
    """Piece probabilities per value of ``label``, from all rows whose label is not null.

    The first round weighs all pieces alike, which favours segmentations of few pieces;
    each further round weighs them by the language's own probabilities.
    """
    spark = docs.sparkSession
    trie = Trie.of(pieces(model))
    word = F.explode(F.split(F.lower(F.col(text)), "[^\\p{L}]+"))
    words = docs.where(F.col(label).isNotNull()).select(F.col(label).alias("lang"), word.alias("word"))
    counts = words.where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    if rounds > 1:
        counts = common.stored(counts, "language-words")
    probs: dict[str, np.ndarray] = {}
    languages: list[str] = []
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vars(trie), dict(probs)))  # plain values only

        def start(shared=shared):
            trie, probs = Trie(**shared.value[0]), shared.value[1]
            flat = np.full(trie.size, 1.0 / trie.size)
            flat[0] = 0.0

            def work(batch):
                langs = np.array(batch.column(0).to_pylist(), object)
                n = np.asarray(batch.column(2).to_pylist(), float)
                total: dict[str, np.ndarray] = {}
                parts, owner = [], []

                def count():
                    own = np.array(owner, np.int64)
                    for lang in sorted(set(langs[own])):
                        mine = np.flatnonzero(langs[own] == lang)
                        uses = expected_counts(trie, probs.get(lang, flat), [parts[i] for i in mine], n[own[mine]])
                        total[lang] = total.get(lang, 0.0) + uses
                    parts.clear()
                    owner.clear()

                for i, w in enumerate(batch.column(1).to_pylist()):
                    for at in range(0, len(w), LONGEST):
                        parts.append(w[at:at + LONGEST])
                        owner.append(i)
                    if len(parts) >= 2 * SLICE:  # long words have many parts
                        count()
                count()
                out: list[list] = [[], [], []]
                for lang, uses in sorted(total.items()):
                    used = np.flatnonzero(uses)
                    out[0] += [lang] * len(used)
                    out[1] += used.tolist()
                    out[2] += uses[used].tolist()
                return out

            return work

        # words are short rows, and those of one length are walked together: many at a time
        uses = common.map_batches(counts, start, "lang string, piece int, uses double", SLICE)
        # summed as whole millionths: a sum of integers is the same in any order of tasks
        uses = uses.groupBy("lang", "piece").agg(F.sum(F.round(F.col("uses") * 1e6).cast("long")).alias("uses"))
        found = uses.toPandas()  # languages x vocabulary numbers at most
        languages = sorted(found["lang"].unique())
        base = np.zeros(trie.size)
        raw = {}
        for lang in languages:
            mine = found[found["lang"] == lang]
            raw[lang] = np.zeros(trie.size)
            raw[lang][mine["piece"].to_numpy()] = mine["uses"].to_numpy(dtype=float) / 1e6
            base += raw[lang]
        base = (base + 0.1) / (base + 0.1)[1:].sum()
        for lang in languages:
            probs[lang] = (raw[lang] + SMOOTHING * base) / (raw[lang].sum() + SMOOTHING)
            probs[lang][0] = 0.0
    table = np.stack([probs[x] for x in languages], axis=1) if languages else np.zeros((trie.size, 0))
    return Model(languages, trie, table)


def predict(docs: DataFrame, model: Model, text: str = "text", language: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``docs`` with the likeliest language of the whole text and its posterior probability.

    All languages are equally likely beforehand; ties go to the first by name. A text that is
    null or without a letter, and every text if no language was learned, gets ``und`` and 0.
    Columns named like the results are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, vars(model.trie), model.probs))
    keep = [c for c in docs.columns if c not in (language, score)]
    # texts are large: sent once where they are kept, too
    read = text if text in keep else "__text"
    rows = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias(read))

    def start():
        languages, trie, probs = shared.value
        model = Model(languages, Trie(**trie), probs)
        n = len(languages)
        known: dict[str, int] = {}
        values = np.zeros((1 << 14, n + 1))  # per token: log-likelihoods, and letters or not
        older, older_values = {}, values[:0]  # those before; tokens met again stay when rare ones go

        def add(tokens: list[str], own: np.ndarray) -> None:
            nonlocal values
            first, stop = len(known), len(known) + len(tokens)
            while stop > len(values):
                values = np.concatenate([values, np.zeros_like(values)])
            values[first:stop] = own
            known.update(zip(tokens, range(first, stop)))

        def learn(tokens: list[str]) -> None:
            met = [w for w in tokens if w in older]
            add(met, older_values[np.fromiter(map(older.__getitem__, met), np.int64, len(met))])
            tokens = [w for w in tokens if w not in older]
            number: dict[str, int] = {}
            owner, word = [], []
            for i, token in enumerate(tokens):
                for w in (token,) if token.isalpha() else LETTERS.findall(token):
                    owner.append(i)
                    word.append(number.setdefault(w, len(number)))
            owner, word = np.array(owner, np.int64), np.array(word, np.int64)
            logs = log_likelihoods(model.trie, model.probs, list(number))[word]
            own = np.empty((len(tokens), n + 1))
            for i in range(n):
                own[:, i] = np.bincount(owner, logs[:, i], len(tokens))
            own[:, n] = np.bincount(owner, minlength=len(tokens)) > 0
            add(tokens, own)

        def work(batch):
            nonlocal known, values, older, older_values
            langs, scores = [], []
            for some in common.runs(common.texts(batch, read), CHARACTERS):
                split = [t.lower().split() for t in some]
                new = list({w for words in split for w in words}.difference(known)) if n else []
                if new:
                    learn(new)
                for words in split:
                    total = values[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(axis=0) \
                        if words and n else np.zeros(n + 1)
                    if not total[n]:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(np.argmax(total[:n]))
                    langs.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(total[:n] - total[best]).sum()))
                if len(known) > CACHE // 2:
                    older, older_values, known, values = known, values, {}, np.zeros((1 << 14, n + 1))
            return [*batch.columns[:len(keep)], langs, scores]

        return work

    ddl = ", ".join(f"`{c}` {common.kind(docs, c)}" for c in keep)
    return common.map_batches(rows, start, f"{ddl}, `{language}` string, `{score}` double")


def identify(docs: DataFrame, train: Column, key: str = "doc_id") -> DataFrame:
    """Predicts every row of ``docs`` (its key and ``held_out``) by the rows where ``train`` holds.

    A row whose ``train`` is null teaches nothing and is not held out.
    """
    model = fit(docs.where(train))
    rows = docs.select(F.col(key), F.coalesce(~train, F.lit(False)).alias("held_out"), F.col("text"))
    return predict(rows, model).drop("text")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those no language can be told of: ``und``, or a posterior under ``least``.

    Learns from all labelled rows. Columns stay as they are.
    """
    found = predict(docs, fit(docs), language="__language", score="__score")
    told = (F.col("__language") != UNKNOWN) & (F.col("__score") >= least)
    return found.where(told).select(*docs.columns)
