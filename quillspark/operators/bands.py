"""Pairs of titles that meet in a band, judged where they meet.

Of many titles each two of a field meet in some band, so that the pairs are far more than
those wanted.  Blocks of one side meet blocks of the other in one task, which looks the
bands up in sorted arrays and gives only the pairs that are kept; no pair is moved before.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.session import Cut

BLOCK_ROWS = 50_000  # most rows of a side in a task, on average
TASK_PAIRS = 500_000_000  # pairs of rows a task meets, on average
SLICE_BYTES = 400_000_000  # moved at a time, by estimate
LONG = 256  # letters beyond which a title is compared by itself
FREQUENT = 0.6  # share of all letters that the most frequent ones make up, which are compared as bags first
BAG_WORDS = 3  # of 64 bits for the bag of a title's letters
BATCH_PAIRS = 16_000  # pairs whose titles are compared at once


class _Bands:
    """The rows of the known side by band."""

    def __init__(self, bands: list[list[int]]):
        self.n, row = len(bands), np.array([b for b in bands if b], np.int64)
        at = np.array([i for i, b in enumerate(bands) if b], np.int64)
        self.sorted = []
        for j in range(row.shape[1] if len(row) else 0):
            order = np.argsort(row[:, j], kind="stable")
            self.sorted.append((row[order, j], at[order]))

    def places(self, bands: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each band of each asked row begin and end."""
        width = len(self.sorted)
        if not width or not bands:
            return (np.zeros((len(bands), width), np.int64),) * 2
        asked = np.array([b or [0] * width for b in bands], np.int64)
        ends = [np.stack([np.searchsorted(s, asked[:, j], side) for j, (s, _) in enumerate(self.sorted)], 1) for side in ("left", "right")]
        has = np.array([bool(b) for b in bands])
        ends[1][~has] = ends[0][~has]
        return ends[0], ends[1]

    def shared(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many bands each known row shares with an asked one."""
        parts = [at[a:b] for (_, at), a, b in zip(self.sorted, low.tolist(), high.tolist()) if b > a]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)


class _Strings:
    """Strings as codes of their letters by position, for longest common subsequences with many of them at once."""

    def __init__(self, n: int, row: np.ndarray, code: np.ndarray, letters: int):
        self.length = np.bincount(row, minlength=n)
        self.codes = np.zeros((int(self.length.max(initial=0)), n), np.uint16 if letters < 65536 else np.uint32)
        self.codes[np.arange(len(row)) - np.repeat(np.cumsum(self.length) - self.length, self.length), row] = code
        self.letters = letters

    def common(self, asked: list[list[int]], pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of the asked strings ``pairs`` (codes of letters) with the rows."""
        out = np.zeros(len(rows), np.int64)
        words = np.array([-(-len(a) // 64) for a in asked], np.int64)
        for w in range(1, int(words.max(initial=0)) + 1):
            of = np.nonzero(words[pairs] == w)[0]
            # the longest first: those that have ended are at the end
            of = of[np.argsort(-self.length[rows[of]], kind="stable")]
            if len(of):
                out[of] = self._of_words(asked, w, pairs[of], rows[of])
        return out

    def _of_words(self, asked: list[list[int]], words: int, pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The same by bit-parallel rows of so many words, for all pairs together."""
        used = np.unique(pairs)
        masks = np.zeros((words, len(used), self.letters), np.uint64)
        for slot, i in enumerate(used.tolist()):
            bits: dict[int, int] = {}
            for at, c in enumerate(asked[i]):
                bits[c] = bits.get(c, 0) | 1 << at
            for k in range(words):
                masks[k, slot, list(bits)] = [b >> 64 * k & 2**64 - 1 for b in bits.values()]
        flat = masks.reshape(words, -1)
        first = np.searchsorted(used, pairs) * self.letters
        going = len(rows) - np.searchsorted(self.length[rows][::-1], np.arange(int(self.length[rows[0]])), "right")
        row = np.full((words, len(rows)), ~np.uint64(0))
        at, hit, added, carry = np.empty(len(rows), np.int64), *(np.empty(len(rows), np.uint64) for _ in range(3))
        for column, n in zip(self.codes, going.tolist()):
            i, h, a = at[:n], hit[:n], added[:n]
            np.add(first[:n], column.take(rows[:n]), out=i)
            for k in range(words):
                r = row[k, :n]
                flat[k].take(i, out=h, mode="clip")
                np.bitwise_and(r, h, out=h)
                np.add(r, h, out=a)
                np.subtract(r, h, out=r)
                if words > 1:
                    over = a < h
                    if k:
                        np.add(a, carry[:n], out=a)
                        over |= a < carry[:n]
                    carry[:n] = over
                np.bitwise_or(r, a, out=r)
        return 64 * words - np.bitwise_count(row).sum(0, dtype=np.int64)


class _Titles:
    """The titles of the known side as letters by position and as bags of letters.

    A common subsequence has at most as many letters as the bags have in common, and is
    made of one of the rarer letters and one of the frequent letters.
    """

    def __init__(self, titles: list[str]):
        self.titles, n = titles, len(titles)
        self.length = np.fromiter(map(len, titles), np.int64, n)
        self.lengths = np.arange(int(self.length.max(initial=0)) + 1)
        short = np.where(self.length <= LONG, self.length, 0)
        flat = np.frombuffer("".join(t if len(t) <= LONG else "" for t in titles).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, code, often = np.unique(flat, return_inverse=True, return_counts=True)
        row, letters = np.repeat(np.arange(n), short), len(self.alphabet)
        self.code = {int(x): i for i, x in enumerate(self.alphabet)}
        self.whole = _Strings(n, row, code, letters)
        order = np.argsort(-often, kind="stable")
        self.frequent = np.zeros(letters, bool)
        self.frequent[order[np.cumsum(often[order]) <= FREQUENT * len(flat)]] = True
        rare = ~self.frequent[code]
        self.rare = _Strings(n, row[rare], code[rare], letters)
        # bits of bags: the k-th of a letter in a title has a bit if many titles have so many; the others are counted
        nth, most = self._nth(row * letters + code), np.zeros(letters, np.int64)
        kinds, times = np.unique(code * (LONG + 1) + nth, return_counts=True)
        best = kinds[np.argsort(-times, kind="stable")[: 64 * BAG_WORDS]]
        np.maximum.at(most, best // (LONG + 1), best % (LONG + 1) + 1)
        # frequent letters first, so that words of the bag hold the one or the other
        order = np.argsort(~self.frequent, kind="stable")
        sizes = np.where(self.frequent[order], most[order], 0)
        self.half = -(-int(sizes.sum()) // 64)
        start = np.cumsum(most[order]) - most[order] + np.where(self.frequent[order], 0, 64 * self.half - int(sizes.sum()))
        self.start, self.most = np.empty(letters, np.int64), most
        self.start[order] = start
        self.words = -(-int((self.start + most).max(initial=0)) // 64)
        self.bags = np.zeros((self.words, n), np.uint64)
        self.over = np.zeros((2, n), np.int64)
        self.start_of, self.most_of, self.kind_of = self.start.tolist(), most.tolist(), (~self.frequent).astype(int).tolist()
        in_bag = nth < most[code]
        bit = self.start[code] + nth
        for w in range(self.words):
            of = in_bag & (bit >> 6 == w)
            np.bitwise_or.at(self.bags[w], row[of], np.uint64(1) << (bit[of] & 63).astype(np.uint64))
        for kind in (0, 1):
            self.over[kind] = np.bincount(row[~in_bag & (self.frequent[code] == (kind == 0))], minlength=n)

    @staticmethod
    def _nth(keys: np.ndarray) -> np.ndarray:
        """How many equal keys stand before each."""
        order = np.argsort(keys, kind="stable")
        sorted_ = keys[order]
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.zeros(0, np.int64)
        nth = np.empty(len(keys), np.int64)
        nth[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.r_[first, len(keys)]))
        return nth

    def asked(self, title: str) -> list[int]:
        """The codes of the letters of an asked title that any title of this side has."""
        return [self.code[x] for x in map(ord, title) if x in self.code]

    def near(self, title: str, codes: list[int], rows: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows those whose ratio with a title may be above ``least`` by their bags, how many letters both must have in common, and how many of the frequent ones they have at most."""
        # as the ratio is computed, so that none is left out by rounding; too many for those of another length
        needs = np.floor(least * (self.lengths + len(title)) / 200.0).astype(np.int64)
        needs[np.minimum(self.lengths, len(title)) < needs] = 2**40
        need = needs[self.length[rows]]
        fits = np.flatnonzero(need < 2**40)
        rows, need = rows[fits], need[fits]
        if len(title) > LONG:
            return rows, 0 * need, 0 * need
        seen: dict[int, int] = {}
        bag, over = 0, [0, 0]
        for c in codes:
            k = seen.get(c, 0)
            seen[c] = k + 1
            if k < self.most_of[c]:
                bag |= 1 << self.start_of[c] + k
            else:
                over[self.kind_of[c]] += 1
        both = [np.minimum(self.over[kind].take(rows), over[kind]) if over[kind] else np.zeros(len(rows), np.int64) for kind in (0, 1)]
        for w in range(self.words):
            own = np.uint64(bag >> 64 * w & 2**64 - 1)
            if own:
                both[w >= self.half] += np.bitwise_count(self.bags[w].take(rows) & own)
        stay = np.flatnonzero((both[0] + both[1] >= need) | (self.length[rows] > LONG))
        return rows[stay], need[stay], both[0][stay]

    def likely(self, codes: list[list[int]], pairs: np.ndarray, rows: np.ndarray, need: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Which of the pairs of an asked title and a row left by ``near`` may be alike by their rarer letters."""
        rare = [[c for c in cs if not self.frequent[c]] if len(cs) <= LONG else [] for cs in codes]
        return (frequent + self.rare.common(rare, pairs, rows) >= need) | (self.length[rows] > LONG)

    def ratio(self, titles: list[str], codes: list[list[int]], pairs: np.ndarray, rows: np.ndarray) -> np.ndarray:
        size = np.fromiter(map(len, titles), np.int64, len(titles))[pairs]
        short = (self.length[rows] <= LONG) & (size <= LONG)
        common = np.zeros(len(rows), np.int64)
        common[short] = self.whole.common(codes, pairs[short], rows[short])
        for i in np.flatnonzero(~short):
            common[i] = T._common_subsequence(titles[pairs[i]], self.titles[rows[i]])
        total = self.length[rows] + size
        return np.where(total > 0, 200.0 * common / np.maximum(total, 1), 100.0)


class _Words:
    """The rows of the known side by word."""

    def __init__(self, words: list[list[int]]):
        row = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        flat = np.array([w for ws in words for w in ws], np.int64)
        order = np.argsort(flat, kind="stable")
        self.n, self.sorted, self.at = len(words), flat[order], row[order]

    def hits(self, words: list[int]) -> np.ndarray:
        """How many of some words each row holds."""
        asked = np.array(words, np.int64)
        ends = zip(np.searchsorted(self.sorted, asked).tolist(), np.searchsorted(self.sorted, asked, "right").tolist())
        parts = [self.at[a:b] for a, b in ends if b > a]
        return np.bincount(np.concatenate(parts), minlength=self.n) if parts else np.zeros(self.n, np.int64)


def _places(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that a shuffle by its hash brings there."""
    tried = 20 * n + 200
    rows = spark.range(tried).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    found = {r.p: r.id for r in rows}
    return [found.get(p, tried + p) for p in range(n)]


def _meet(asked: DataFrame, known: DataFrame, judge, schema: str, width: int) -> DataFrame:
    """What ``judge`` gives of the tables of a block of each side, for all blocks of both; the sides are written, and so is the result."""
    spark = asked.sparkSession
    cut = Cut(spark)
    asked, known = cut(asked), cut(known)
    na, nk = asked.count(), known.count()
    tasks = max(12, na * nk / TASK_PAIRS)
    rows = max(1, math.ceil(na / BLOCK_ROWS), round(math.sqrt(tasks * na / max(nk, 1))))
    columns = max(1, math.ceil(nk / BLOCK_ROWS), math.ceil(tasks / rows))
    slices = min(columns, max(1, math.ceil((na * columns + nk * rows) * width / SLICE_BYTES)))
    parts = []
    for s in range(slices):
        mine = range(s, columns, slices)
        a = asked.withColumns({"_x": F.pmod(F.xxhash64("_a"), F.lit(rows)), "_y": F.explode(F.array(*[F.lit(y).cast("long") for y in mine]))})
        k = known.withColumn("_y", F.pmod(F.xxhash64("_k"), F.lit(columns))).filter(F.pmod("_y", F.lit(slices)) == s).withColumn("_x", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))))
        # one task to a pair of blocks: small ones are not put together, large ones not either
        n = len(mine) * rows
        places = _places(spark, n)
        of = F.get(F.array(*[F.lit(z) for z in places]), (F.col("_x") + F.floor(F.col("_y") / slices) * rows).cast("int"))
        a, k = (df.withColumn("_z", of).drop("_x", "_y").repartition(n, "_z") for df in (a, k))
        parts.append(cut(a.groupBy("_z").cogroup(k.groupBy("_z")).applyInArrow(judge, schema)))
    cut.release(asked, known)
    return functools.reduce(DataFrame.unionByName, parts)


def _table(columns: list[tuple[str, pa.Array]]) -> pa.Table:
    return pa.table(dict(columns))


def _types(asked: DataFrame, known: DataFrame, a: str, k: str) -> str:
    return f"_a {dict(asked.dtypes)[a]}, _k {dict(known.dtypes)[k]}"


def _banded(df: DataFrame, bands) -> DataFrame:
    """The rows with bands, by ``bands`` of the column ``_title`` or, if it can, by its ``add`` in batches."""
    add = getattr(bands, "add", lambda df, title, name: df.withColumn(name, bands(title)))
    rest = [c for c in df.columns if c != "_title"]
    return add(df.select("_title", *rest), F.col("_title"), "_bands").filter(F.size("_bands") > 0).select(*rest, "_bands")


def alike(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, a: Column, b: Column, bands, least: float) -> DataFrame:
    """(asked_id, known_id, shared, ratio) of rows whose titles ``a`` and ``b`` meet in a band and have a ratio in lower case above ``least``; shared is the number of common bands."""
    # the new names are none that a title is read from: within lambdas they would hide it
    sides = [_banded(df.select(F.col(key).alias(name), F.lower(title).alias("_t"), title.alias("_title")), bands) for df, key, name, title in ((asked, asked_id, "_a", a), (known, known_id, "_k", b))]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        at, titles = _Bands(right["_bands"].to_pylist()), _Titles(right["_t"].to_pylist())
        low, high = at.places(left["_bands"].to_pylist())
        asked, codes = left["_t"].to_pylist(), {}
        # of pairs: asked, row, shared bands, letters needed, frequent ones in common
        waiting, likely, out, pairs = [], [], [], 0

        def settle(parts: list[tuple], whole: bool) -> None:
            i, rows, shared, *bounds = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 5
            for s in range(0, len(i), BATCH_PAIRS):
                b = slice(s, s + BATCH_PAIRS)
                of, at = np.unique(i[b], return_inverse=True)
                if whole:
                    ratio = titles.ratio([asked[x] for x in of], [codes[x] for x in of.tolist()], at, rows[b])
                    keep = ratio > least
                    out.append((i[b][keep], rows[b][keep], shared[b][keep], ratio[keep]))
                else:
                    keep = titles.likely([codes[x] for x in of.tolist()], at, rows[b], *(x[b] for x in bounds))
                    likely.append((i[b][keep], rows[b][keep], shared[b][keep]))
            parts.clear()

        for n, title in enumerate(asked):
            shared = at.shared(low[n], high[n])
            codes[n] = titles.asked(title)
            rows, *bounds = titles.near(title, codes[n], np.flatnonzero(shared > 0), least)
            waiting.append((np.full(len(rows), n), rows, shared[rows], *bounds))
            pairs += len(rows)
            if pairs >= BATCH_PAIRS or n + 1 == len(asked):
                settle(waiting, False)
                pairs = 0
            if sum(len(x[0]) for x in likely) >= BATCH_PAIRS or n + 1 == len(asked):
                settle(likely, True)
                codes.clear()
        i, rows, shared, ratio = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4
        return _table([("_a", left["_a"].take(pa.array(i))), ("_k", right["_k"].take(pa.array(rows))), ("shared", pa.array(shared, pa.int64())), ("ratio", pa.array(ratio, pa.float64()))])

    met = _meet(*sides, judge, _types(asked, known, asked_id, known_id) + ", shared long, ratio double", 400)
    return met.select(F.col("_a").alias(asked_id), F.col("_k").alias(known_id), "shared", "ratio")


def most_words(asked: DataFrame, known: DataFrame, asked_id: str, known_id: str, a: Column, b: Column, text: Column, bands, n: int) -> DataFrame:
    """(asked_id, known_id, score) of rows whose titles ``a`` and ``b`` meet in a band; for each asked one all of its ``n`` best by the share of the title's words that ``text`` holds, and perhaps others."""
    words = lambda c: F.transform(T.unigrams(T.index_words(c)), lambda w: F.xxhash64(w))
    sides = [_banded(df.select(F.col(key).alias(name), words(held).alias("_words"), title.alias("_title")), bands) for df, key, name, title, held in ((asked, asked_id, "_a", a, a), (known, known_id, "_k", b, text))]

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("_k")
        at, held = _Bands(right["_bands"].to_pylist()), _Words(right["_words"].to_pylist())
        low, high = at.places(left["_bands"].to_pylist())
        out: list[tuple] = []
        for i, asks in enumerate(left["_words"].to_pylist()):
            rows = np.nonzero(at.shared(low[i], high[i]))[0]
            hits = held.hits(asks)[rows]
            if len(rows) > n:
                best = np.argpartition(hits * at.n - rows, len(rows) - n)[-n:]
                rows, hits = rows[best], hits[best]
            out.append((np.full(len(rows), i), rows, hits / max(1, len(asks))))
        i, rows, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return _table([("_a", left["_a"].take(pa.array(i, pa.int64()))), ("_k", right["_k"].take(pa.array(rows, pa.int64()))), ("score", pa.array(score, pa.float64()))])

    met = _meet(*sides, judge, _types(asked, known, asked_id, known_id) + ", score double", 900)
    return met.select(F.col("_a").alias(asked_id), F.col("_k").alias(known_id), "score")
