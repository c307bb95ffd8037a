"""Best-fit packing by exact-complement hashing.

Documents become token pieces of at most ``capacity``; pieces share sequences so that as few
as possible are needed. Which piece goes where depends only on lengths, so the plan is made
on the histogram of lengths, which has ``capacity`` numbers however large the input is:

1. Take the longest length that is left. Look its gap up among the single, pair and triple
   sums of lengths that are still available; a hit fills the sequence exactly.
2. Without a hit, put in the longest length that fits (best fit) and look up again.
3. Use the pattern as often as the counts allow, then go on.

Each use of a pattern exhausts a length, so there are at most ``capacity`` patterns. Pieces
are then numbered within their length and looked up in the plan. Numbering counts within
(length, hash range) and adds the counts of the ranges before, so that a length that a third
of all pieces share is not one task's work.

Null texts count as empty; an empty text is one piece, its closing token. Rows that share a
key are packed each by itself; pieces alike in key, number, length and checksum are exchangeable.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from . import common

CAPACITY = 2_048
CLOSE = 0
CACHE = 400_000  # parts of two generations
SLICE = 1 << 16  # parts whose tokens are gathered at a time
CHARACTERS = 1 << 19  # of texts that are cut into parts at a time
RANGE_ROWS = 4_096
VOCABULARY = "word_bpe_49k.json"


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's content; read where the job is started, sent to the tasks."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        return f.read()


class Numbers(dict):
    """Numbers strings as they come."""

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        return number


class Tokens:
    """The tokens of numbered parts: of part ``n``, ``sizes[n]`` from place ``begins[n]`` on."""

    def __init__(self):
        self.begins = self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.begins = np.concatenate([self.begins, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The tokens of the parts ``numbers``, one after the other."""
        sizes = self.sizes[numbers]
        at = np.repeat(self.begins[numbers] - np.cumsum(sizes) + sizes, sizes)
        return self.ids[at + np.arange(len(at))]


class Encoder:
    """Token ids of texts, as little-endian 32-bit bytes, equal to the tokenizer's own.

    This tokenizer drops white space, and no token crosses the parts its own pattern cuts.
    Normalised texts are cut into parts and each part is encoded once; new parts are encoded
    many at a time, told apart by the tokens that end a word. Texts of Western letters are
    normalised and cut by built-in means that agree with the tokenizer's there, others by the
    tokenizer's normaliser and pattern. Texts where the cut could differ (special tokens,
    separator controls) are encoded whole.

    Known parts have numbers and their tokens lie in one array, from which a text's are gathered.
    They are kept in two generations, so that those met again stay when rare ones go.
    """

    WHOLE = re.compile("<\\||[\x1c-\x1f]")
    #: Characters that normalisation does no more to than to lower-case them.
    WESTERN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
    #: The tokenizer's pattern over those, lower-cased.
    PARTS = re.compile("[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u017f]+"
                       "|'(?:s|t|re|ve|m|ll|d)"
                       "|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
                       "|[^\\sa-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u017f]+")
    BYTES = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, content: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        config = json.loads(content)
        self.tokenizer = Tokenizer.from_str(content)
        pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern)
        rules = [n["type"] for n in config["normalizer"]["normalizers"]]
        self.western = pattern == self.PATTERN and rules == ["NFC", "Replace", "Lowercase"]
        end = config["model"]["end_of_word_suffix"]
        words = config["model"]["vocab"]
        self.closes = np.zeros(max(words.values()) + 1, bool)
        self.closes[[i for w, i in words.items() if w.endswith(end)]] = True
        self.bare = Tokenizer(self.tokenizer.model)
        self.by_pattern = self.tokenizer.pre_tokenizer
        # parts that are cut already need no second cut, only an end at the blanks between them
        self.western = self.western and config["pre_tokenizer"]["pretokenizers"][1:] == self.BYTES
        self.by_blanks = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.numbers, self.older_numbers = Numbers(), Numbers()
        self.tokens, self.older_tokens = Tokens(), Tokens()

    def learn(self, parts: list[str]) -> None:
        """Makes ``parts``, which have been numbered, known."""
        old = np.fromiter(map(self.older_numbers.get, parts, itertools.repeat(-1)), np.int64, len(parts))
        sizes, tokens = [], []
        for at in range(0, len(parts), 10_000):
            some, kept = parts[at:at + 10_000], old[at:at + 10_000]
            fresh = [p for p, k in zip(some, (kept < 0).tolist()) if k]
            joined = " ".join(fresh)
            self.bare.pre_tokenizer = self.by_blanks if self.western and self.WESTERN.fullmatch(joined) else self.by_pattern
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(fresh):
                raise ValueError("this tokenizer does not mark the ends of words")
            size = np.empty(len(some), np.int64)
            size[kept < 0] = np.diff(ends, prepend=0)
            size[kept >= 0] = self.older_tokens.sizes[kept[kept >= 0]]
            own = np.empty(size.sum(), "<u4")
            is_new = np.repeat(kept < 0, size)
            own[is_new] = ids
            own[~is_new] = self.older_tokens.of(kept[kept >= 0])
            sizes.append(size)
            tokens.append(own)
        if parts:
            self.tokens.add(np.concatenate(sizes), np.concatenate(tokens))

    def split(self, text: str) -> list[str] | None:
        if self.western and "<|" not in text and self.WESTERN.fullmatch(text):
            return self.PARTS.findall(text.lower())
        if self.WHOLE.search(text):
            return None
        return self.cut.findall(self.tokenizer.normalizer.normalize_str(text))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > CACHE // 2:
            self.numbers, self.older_numbers = Numbers(), self.numbers
            self.tokens, self.older_tokens = Tokens(), self.tokens
        split = [self.split(t) for t in texts]
        seen = len(self.numbers)
        number = self.numbers.__getitem__
        numbers = [None if parts is None else np.fromiter(map(number, parts), np.int32, len(parts)) for parts in split]
        self.learn(list(itertools.islice(self.numbers, seen, None)))
        out = []
        for text, own in zip(texts, numbers):
            if own is None:
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            else:
                out.append(b"".join([self.tokens.of(own[at:at + SLICE]).tobytes() for at in range(0, len(own), SLICE)]))
        return out


def encoder(content: str) -> Encoder:
    """One for each worker process; what it knows serves the next task of this operator, too."""
    return common.kept(__name__, content, lambda: Encoder(content))


def token_pieces(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, path: str | None = None,
                 with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32) of every document; ``ids`` too if asked for."""
    content = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    close = np.array([CLOSE], "<u4").tobytes()

    def start():
        own_encoder = encoder(content.value)

        def work(batch):
            own, piece, begin, length, crc, ids = [], [], [], [], [], []
            encoded = map(own_encoder.encode, common.runs(common.texts(batch), CHARACTERS))
            for i, raw in enumerate(itertools.chain.from_iterable(encoded)):
                raw += close
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    own.append(i)
                    piece.append(n)
                    begin.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").tolist())
            return [common.repeated(batch.column(0), own), piece, begin, length, crc, *([ids] if with_ids else [])]

        return work

    ddl = f"`{key}` {common.kind(docs, key)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = docs.select(F.col(key), F.col("text"))
    return common.map_batches(rows, start, ddl + ", ids array<bigint>" * with_ids)


@dataclass
class Plan:
    """By (length, rank of the first piece): first sequence, offset there, pieces per sequence."""

    at: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    uses: np.ndarray
    sequences: int


RANK_BITS = 44  # places of the rank in a plan's key; lengths stand above them


def _complement(left: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths with the sum ``gap``, long ones first."""
    if gap < len(left) and left[gap]:
        return [gap]
    a = np.arange(1, gap // 2 + 1)
    a = a[(gap - a < len(left))]
    hit = a[(left[a] > 0) & (left[gap - a] > 0)]
    hit = hit[(gap - hit != hit) | (left[hit] > 1)]
    if len(hit):
        return [gap - int(hit[0]), int(hit[0])]
    have = np.flatnonzero(left[:gap])
    for c in have[::-1].tolist():
        rest = gap - c
        b = have[(have < rest) & (have <= c)]
        b = b[left[rest - b] > 0]
        for x in b[rest - b <= b].tolist():
            need = [c, x, rest - x]
            if all(left[n] >= need.count(n) for n in need):
                return need
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Patterns for a histogram of lengths (``counts[n]`` pieces of length n)."""
    left = np.array(counts, np.int64)
    done = np.zeros(len(left), np.int64)
    at, sequence, offset, uses = [], [], [], []
    free = 0
    for longest in range(len(left) - 1, 0, -1):
        while left[longest]:
            spare = left.copy()
            pattern = [longest]
            spare[longest] -= 1
            gap = capacity - longest
            while gap:
                found = _complement(spare, gap)
                if not found:
                    fits = np.flatnonzero(spare[:gap + 1])
                    if not len(fits):
                        break
                    found = [int(fits[-1])]
                pattern += found
                gap -= sum(found)
                for n in found:
                    spare[n] -= 1
            needs = {n: pattern.count(n) for n in dict.fromkeys(pattern)}
            times = min(int(left[n]) // k for n, k in needs.items())
            place = 0
            for n, k in needs.items():
                at.append((n << RANK_BITS) + int(done[n]))
                sequence.append(free)
                offset.append(place)
                uses.append(k)
                place += n * k
                left[n] -= k * times
                done[n] += k * times
            free += times
    order = np.argsort(np.array(at, np.int64))
    pick = lambda x: np.array(x, np.int64)[order]
    return Plan(pick(at), pick(sequence), pick(offset), pick(uses), free)


def pack(docs: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Every piece of ``docs`` with its ``sequence_id`` and ``offset``, gapless from 0."""
    spark = docs.sparkSession
    pieces = common.stored(token_pieces(docs, key, capacity, path), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().toLocalIterator():  # ``capacity`` rows at most
        counts[row["length"]] = row["count"]
    made = plan(counts, capacity)
    shared = spark.sparkContext.broadcast((made.at, made.sequence, made.offset, made.uses))

    bits = max(0, (int(counts.sum()) // RANGE_ROWS).bit_length())
    pieces = pieces.withColumn("__order", F.xxhash64(key, "piece", "ids_crc32"))
    pieces = pieces.withColumn("__part", F.shiftrightunsigned("__order", 64 - bits) if bits else F.lit(0).cast("long"))
    before = Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = pieces.groupBy("length", "__part").agg(F.count("*").alias("n")).select(
        F.col("length").alias("__length"), F.col("__part").alias("__in"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    ranges = common.stored(ranges, "piece-ranges")
    within = Window.partitionBy("length", "__part").orderBy("__order", key, "piece")
    numbered = pieces.join(
        ranges, (F.col("length") == F.col("__length")) & (F.col("__part") == F.col("__in")),
    ).withColumn("rank", F.col("__before") + F.row_number().over(within) - 1)

    def start():
        at, sequence, offset, uses = shared.value

        def work(batch):
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            i = np.searchsorted(at, (length << RANK_BITS) + rank, "right") - 1
            turn = rank - (at[i] & ((1 << RANK_BITS) - 1))
            return [*batch.columns[:-1], sequence[i] + turn // uses[i], offset[i] + turn % uses[i] * length]

        return work

    ddl = f"`{key}` {common.kind(docs, key)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = numbered.select(key, "piece", "start", "length", "ids_crc32", "rank")
    return common.map_batches(rows, start, ddl + ", sequence_id bigint, offset bigint")
