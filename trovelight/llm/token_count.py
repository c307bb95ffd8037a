"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Where no child matches, the automaton follows
the failure link and adds the precomputed number of pieces this pops, so one pass over a
word's characters gives the length of its greedy longest-match segmentation; the pieces
themselves are never built.

The vocabulary is that of a public SentencePiece model: a piece that opens a word starts with
``MARK``, any other continues one. Words are runs without ASCII white space. A word that greedy
matching cannot cover whole is one unknown token, as word-piece tokenizers have it.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import common

MARK = "▁"
CACHE = 200_000


def pieces(model: str | None = None) -> list[str]:
    """Text pieces of a SentencePiece model file, without control, unknown and byte pieces."""
    import public_tokenizers
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=model or public_tokenizers.path("piece_bpe_32k.model"))
    ids = range(reader.get_piece_size())
    return [reader.id_to_piece(i) for i in ids
            if not (reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i))]


class Automaton:
    """Trie, failure links and popped-piece counts. Node 0 is the root; a link of -1 fails."""

    def __init__(self, vocabulary: Iterable[str]):
        self.children: list[dict[str, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            node = 0
            for char in piece:
                if (child := self.children[node].get(char)) is None:
                    child = len(self.children)
                    self.children[node][char] = child
                    self.children.append({})
                    final.append(False)
                node = child
            final[node] = node > 0
        self.link = [-1] * len(self.children)
        self.popped = [0] * len(self.children)
        order = deque([0])
        while order:
            node = order.popleft()
            for char, child in self.children[node].items():
                order.append(child)
                if final[child]:
                    self.link[child], self.popped[child] = 0, 1
                    continue
                back, popped = self.link[node], self.popped[node]
                while back >= 0 and char not in self.children[back]:
                    popped += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[child], self.popped[child] = self.children[back][char], popped

    def count(self, word: str) -> int:
        """Pieces of the greedy longest-match segmentation, 0 if there is none."""
        children, link, popped = self.children, self.link, self.popped
        node = total = 0
        for char in word:
            while (child := children[node].get(char)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 0
            node = child
        while node > 0:
            total += popped[node]
            node = link[node]
        return total if node == 0 else 0


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row of ``docs``: its key, ``n_words``, ``n_tokens`` and ``n_unknown`` of the whole text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces(model))

    def start():
        automaton, known = Automaton(vocabulary.value), {}

        def work(batch):
            n_words, n_tokens, n_unknown = [], [], []
            for one in common.texts(batch):
                words = one.encode("utf-8", "replace").split()  # splits at ASCII white space only
                for word in set(words).difference(known):
                    known[word] = automaton.count(MARK + word.decode())
                counts = list(map(known.__getitem__, words))
                missing = counts.count(0)
                n_words.append(len(words))
                n_tokens.append(sum(counts) + missing)
                n_unknown.append(missing)
                if len(known) > CACHE:
                    known.clear()
            return [batch.column(0), n_words, n_tokens, n_unknown]

        return work

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return common.map_batches(
        rows, start, f"`{key}` {common.kind(docs, key)}, n_words bigint, n_tokens bigint, n_unknown bigint")
