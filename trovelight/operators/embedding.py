"""Batch embedding: text column in, ``vector array<float>`` out, other columns kept."""

from __future__ import annotations

import hashlib
import logging
import re
from dataclasses import dataclass
from typing import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..settings import DEFAULTS

log = logging.getLogger(__name__)
Encode = Callable[[Sequence[str]], np.ndarray]
_PLACES = 500_000  # words a task remembers the place of


@dataclass(frozen=True)
class Encoder:
    """A named model; ``load`` returns a function from texts to a matrix of vectors.

    ``load`` runs in the worker, once per task, and must be picklable.
    """

    name: str
    load: Callable[[], Encode]

    def embed(self, rows: DataFrame, text: str = "code", batch: int = DEFAULTS.ENCODE_BATCH) -> DataFrame:
        load = self.load

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for series in texts:
                values = series.fillna("").tolist()
                parts = [np.asarray(model(values[i:i + batch]), dtype=np.float32)
                         for i in range(0, len(values), batch)]
                yield pd.Series([vector for part in parts for vector in part], index=series.index, dtype=object)

        return rows.withColumn("vector", encode(F.col(text)))


_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class HashingEncoder:
    """Feature hashing of lower-cased words, scaled to unit length. Needs no model files.

    A word's place is the number that the first eight hexadecimal digits of its MD5 spell,
    modulo ``dim``; a text without words has the zero vector. Words are runs of letters,
    digits and underscores. Computed in double precision on Arrow batches, kept as floats.
    """

    dim: int = 256

    @property
    def name(self) -> str:
        return f"md5-hashing-{self.dim}"

    def embed(self, rows: DataFrame, text: str = "code", batch: int = DEFAULTS.ENCODE_BATCH) -> DataFrame:
        dim = self.dim

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            places: dict[str, int] = {}
            for series in texts:
                vectors = []
                for value in series.fillna(""):
                    words = _WORD.findall(value)
                    for word in set(words).difference(places):
                        places[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                    counts = np.bincount([places[w] for w in words], minlength=dim).astype(float)
                    norm = np.sqrt((counts * counts).sum())
                    vectors.append((counts / norm if norm else counts).astype(np.float32))
                if len(places) > _PLACES:
                    places.clear()
                yield pd.Series(vectors, index=series.index, dtype=object)

        return rows.withColumn("vector", encode(F.lower(F.coalesce(F.col(text), F.lit("")))))


def first_available(encoders: Sequence[Encoder | HashingEncoder]) -> Encoder | HashingEncoder:
    """The first encoder that loads, decided once on the driver so all tasks agree."""
    failures = []
    for encoder in encoders:
        try:
            if isinstance(encoder, Encoder):
                encoder.load()
            return encoder
        except Exception as error:
            log.warning("encoder %s is not available: %s", encoder.name, error)
            failures.append(f"{encoder.name}: {error}")
    raise RuntimeError("no encoder could be loaded: " + "; ".join(failures))


def sentence_transformer(model: str) -> Encoder:
    """A sentence-transformers model, where that library and the weights are installed."""

    def load() -> Encode:
        from sentence_transformers import SentenceTransformer

        return SentenceTransformer(model).encode

    return Encoder(model, load)


def default_encoders() -> list[Encoder | HashingEncoder]:
    return [
        sentence_transformer(DEFAULTS.PRIMARY_EMBED_MODEL),
        sentence_transformer(DEFAULTS.FALLBACK_EMBED_MODEL),
        HashingEncoder(),
    ]


def embed_chunks(chunks: DataFrame, encoder: Encoder | HashingEncoder | None = None) -> DataFrame:
    """Chunks with the vector of their code."""
    return (encoder or HashingEncoder()).embed(chunks, "code")


def embed_prompts(prompts: DataFrame, encoder: Encoder | HashingEncoder | None = None) -> DataFrame:
    """Prompts with the vector of their query text."""
    return (encoder or HashingEncoder()).embed(prompts, "query")


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors that arrive as their own table, joined to their chunks by id."""
    return chunks.join(vectors.select("chunk_id", "vector"), "chunk_id")
