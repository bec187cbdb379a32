"""Extractive summaries with a pluggable sentence scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SentenceScorer = Callable[[list[str]], list[float]]


class _Bags:
    """Weighted words of sentences as (row, word, weight) triples, so that work is in proportion to the words."""

    def __init__(self, sentences: list[str]):
        at: dict[str, int] = {}
        row, word = [], []
        for i, s in enumerate(sentences):
            for w in s.lower().split():
                w = w.strip(".,;:!?()[]\"'")
                if len(w) > 2:
                    row.append(i)
                    word.append(at.setdefault(w, len(at)))
        self.n, self.width = len(sentences), max(len(at), 1)
        cell, count = np.unique(np.array(row, np.int64) * self.width + np.array(word, np.int64), return_counts=True)
        self.row, self.word = cell // self.width, cell % self.width
        df = np.bincount(self.word, minlength=self.width)
        self.weight = count * np.log(1 + self.n / np.maximum(df[self.word], 1))
        self.norm = np.sqrt(np.bincount(self.row, self.weight**2, self.n))

    def likeness(self, vector: np.ndarray) -> np.ndarray:
        """Cosines of all sentences with a vector over the words."""
        dot = np.bincount(self.row, self.weight * vector[self.word], self.n)
        length = self.norm * np.sqrt((vector**2).sum())
        return np.round(np.divide(dot, length, out=np.zeros(self.n), where=length > 0), 12)

    def centre(self) -> np.ndarray:
        return np.bincount(self.word, self.weight, self.width)

    def one(self, i: int) -> np.ndarray:
        mine = self.row == i
        return np.bincount(self.word[mine], self.weight[mine], self.width)


def centrality(sentences: list[str]) -> list[float]:
    """Closeness to the document's centre."""
    bags = _Bags(sentences)
    return bags.likeness(bags.centre()).tolist()


def _grams(s: str, n: int) -> set[tuple[str, ...]]:
    w = s.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def extract(sentences: list[str], most: int = 7, scorer: SentenceScorer | None = None, least: float = 0.0, block: int = 0, redundancy: float = 0.5, stop: Callable[[list[int]], float] | None = None, stop_above: float = 0.7) -> list[int]:
    """Positions of the chosen sentences in the order of the text.

    The best sentence by score less its likeness to those chosen is taken until ``most``;
    scores below ``least``, or a ``stop`` of the chosen positions above ``stop_above``, end the
    choice; ``block`` > 0 skips sentences that share a run of that many words with a chosen one.
    """
    if not sentences:
        return []
    scores = np.asarray((scorer or centrality)(sentences), float)
    bags = _Bags(sentences)
    chosen: list[int] = []
    used: set[tuple[str, ...]] = set()
    open_, worst = np.ones(len(sentences), bool), np.zeros(len(sentences))
    while open_.any() and len(chosen) < most:
        best = int(np.where(open_, scores - redundancy * worst, -np.inf).argmax())
        open_[best] = False
        if scores[best] < least or stop is not None and stop(chosen) > stop_above:
            break
        if block:
            grams = _grams(sentences[best], block)
            if grams & used:
                continue
            used |= grams
        chosen.append(best)
        worst = np.maximum(worst, bags.likeness(bags.one(best)))
    return sorted(chosen)


def above(sentences: list[str], scorer: SentenceScorer, least: float = 0.4) -> list[int]:
    """Positions of the sentences that score ``least`` at least, as classifiers of sentences choose them."""
    return [i for i, score in enumerate(scorer(sentences)) if score >= least] if sentences else []


def summarise(df: DataFrame, key: str, sentences: str, most: int = 7, scorer: SentenceScorer | None = None, block: int = 0) -> DataFrame:
    """(key, summary array<string>, sentence_position array<int>) of rows with an array of sentences; no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, places = [], []
            for group in frame[sentences]:
                group = [] if group is None else [s or "" for s in group]
                at = extract(group, most, scorer, block=block)
                out.append([group[i] for i in at])
                places.append(at)
            yield pd.DataFrame({key: frame[key], "summary": out, "sentence_position": places})

    return df.select(key, sentences).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, summary array<string>, sentence_position array<int>")
