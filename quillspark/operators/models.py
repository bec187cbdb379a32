"""Places where models plug in, with defaults that need none."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import citations


class Embedder(Protocol):
    """Texts to vectors of one length."""

    dimension: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """Scores of (query, text) pairs."""

    def __call__(self, queries: list[str], texts: list[str]) -> list[float]: ...


class TextGenerator(Protocol):
    """A sentence for each (context, keywords, paper)."""

    def __call__(self, contexts: list[str], keywords: list[str], papers: list[str]) -> list[str]: ...


class HashedWords:
    """Counts of hashed words with signs, damped and of length one."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        out = np.sign(out) * np.log1p(np.abs(out))
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder | None = None) -> DataFrame:
    """(key, v array<double>) of every row, in Arrow batches."""
    model = embedder or HashedWords()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(model([t or "" for t in batch.column(1).to_pylist()]), np.float64).reshape(batch.num_rows, -1)
            offsets = pa.array(np.arange(batch.num_rows + 1) * v.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=[key, "v"])

    slim = df.select(F.col(key).alias(key), F.col(text).cast("string").alias(text))
    return slim.mapInArrow(run, f"`{key}` {dict(slim.dtypes)[key]}, v array<double>")


def pair_text(keywords: Column, before: Column) -> Column:
    """A citing context as pair models read it."""
    return F.concat(F.lit("keywords: "), keywords, F.lit(" text before citation: "), before)


def paper_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit(" abstract: "), F.coalesce(abstract, F.lit("")))


def citing_sentence(authors: Column, title: Column, year: Column) -> Column:
    """The default generated sentence: who showed what, by a template."""
    first = F.get(citations.people(authors), F.lit(0))
    who = F.when(F.size(citations.people(authors)) > 1, F.concat(F.regexp_extract(first, "^([^,]*)", 1), F.lit(" et al."))).otherwise(F.regexp_extract(F.coalesce(first, F.lit("")), "^([^,]*)", 1))
    when = F.when(F.trim(F.coalesce(year, F.lit(""))) != "", F.concat(F.lit(" ("), year, F.lit(")"))).otherwise("")
    return F.concat(who, when, F.lit(" studied "), F.coalesce(title, F.lit("")), F.lit("."))


def rouge_n(found: str, wanted: str, n: int = 1) -> float:
    """F1 of the runs of n words two texts share."""

    def grams(text: str) -> dict[tuple[str, ...], int]:
        w = text.lower().split()
        out: dict[tuple[str, ...], int] = {}
        for i in range(len(w) - n + 1):
            out[tuple(w[i : i + n])] = out.get(tuple(w[i : i + n]), 0) + 1
        return out

    a, b = grams(found), grams(wanted)
    both = sum(min(c, b.get(g, 0)) for g, c in a.items())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0
