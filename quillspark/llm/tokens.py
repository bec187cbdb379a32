"""Encoding with a public byte-level BPE tokenizer.

The pieces of the tokenizer's split pattern are looked up in a lexicon: a minimal acyclic
transducer whose states share suffixes and whose path counts give each word its ordinal,
which points to the word's ids.  It is compiled once on the driver from the tokenizer's
whole vocabulary, stored as one file, distributed by Spark and memory-mapped by every
worker.  Words outside of it are merged exactly by rank; no text is read for it.

Lookups are vectorised: the distinct pieces of a block of texts step through the
transducer together, one byte position at a time.

Defined results: a null or empty text has an empty list; text that looks like a special
token is plain text; extra columns are not read; a repeated key keeps all of its rows.
"""

from __future__ import annotations

import atexit
import base64
import heapq
import json
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import delete, shared_dir

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the split pattern of the tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split in the faster standard module; it differs only on characters that ``pieces`` tests for.
FAST = re.compile(r"""'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
BLOCK_CHARS = 1_500_000


_BEYOND = re.compile(r"[^\x00-\x7f]+")


@lru_cache(1)
def _splitters() -> tuple[frozenset[str], object]:
    """Characters on which the two patterns differ: numbers that are no digits; and the exact pattern."""
    import unicodedata

    import regex

    return frozenset(chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")), regex.compile(PATTERN)


def pieces(text: str) -> list[str]:
    rare, exact = _splitters()
    # the separators that only one of the two takes for white space
    odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    if odd or not text.isascii() and not rare.isdisjoint("".join(_BEYOND.findall(text))):
        return exact.findall(text)
    return FAST.findall(text)


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Ids of one piece: repeatedly join the leftmost pair of least rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    part = [word[i : i + 1] for i in range(n)]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if part[i] != a or j >= n or part[j] != b or not a:
            continue
        part[i], part[j] = a + b, b""
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n and (r := ranks.get(part[x] + part[y])) is not None:
                heapq.heappush(heap, (r, x, part[x], part[y]))
    out, i = [], 0
    while i < n:
        out.append(ranks[part[i]])
        i = right[i]
    return out


@lru_cache(4)
def _merger(path: str) -> Callable[[str], list[int]]:
    """The exact merge of a word."""
    ranks = load_ranks(path)
    return lambda word: merge(ranks, word.encode())


# ------------------------------------------------------------------ the transducer


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """A minimal acyclic transducer of the words, built from their sorted bytes."""
    ordered = sorted((w.encode(), ids) for w, ids in words.items() if w)
    finals: list[bool] = [False]
    edges: list[dict[int, int]] = [{}]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (state, byte, child) of the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, byte, child = path.pop()
            key = (finals[child], tuple(edges[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                edges[state][byte] = same

    last = b""
    for word, _ in ordered:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            finals.append(False)
            edges.append({})
            edges[state][byte] = len(edges) - 1
            path.append((state, byte, len(edges) - 1))
            state = len(edges) - 1
        finals[state] = True
        last = word
    settle(0)
    # number the states that are left and count the words to the right of each
    order, seen, stack = [], set(), [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            order.append(state)
        elif state not in seen:
            seen.add(state)
            stack.append((state, True))
            stack += [(t, False) for t in edges[state].values() if t not in seen]
    number = {s: i for i, s in enumerate(reversed(order))}
    count: dict[int, int] = {}
    key, target, skip = [], [], []
    for s in order:
        total = int(finals[s])
        for byte, t in edges[s].items():
            key.append(number[s] << 8 | byte)
            target.append(number[t])
            skip.append(total)
            total += count[t]
        count[s] = total
    by = np.argsort(np.array(key, np.int64)) if key else np.zeros(0, np.int64)
    final = np.zeros(len(order), np.uint8)
    for s in order:
        final[number[s]] = finals[s]
    start = np.concatenate([[0], np.cumsum([len(ids) for _, ids in ordered])]).astype(np.int32)
    arrays = {
        "key": np.array(key, np.int64)[by],
        "target": np.array(target, np.int32)[by],
        "skip": np.array(skip, np.int32)[by],
        "final": final,
        "start": start,
        "ids": np.array([i for _, ids in ordered for i in ids], np.int32),
    }
    at, spec, blobs = 0, [], []
    for name, array in arrays.items():
        raw = array.tobytes() + b"\0" * (-array.nbytes % 8)
        spec.append([name, array.dtype.str, len(array), at])
        blobs.append(raw)
        at += len(raw)
    head = json.dumps(spec).encode()
    head += b" " * (-(len(head) + 8) % 8)
    return len(head).to_bytes(8, "little") + head + b"".join(blobs)


class Lexicon:
    """A memory-mapped transducer."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(raw[:8].tobytes(), "little")
        for name, kind, length, at in json.loads(raw[8 : 8 + size].tobytes()):
            begin = 8 + size + at
            setattr(self, name, raw[begin : begin + length * np.dtype(kind).itemsize].view(kind))

    def find(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ordinals of words given as slices of a byte array, -1 for those not held."""
        n = len(start)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.key):
            return out
        alive, state, total = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
        at = 0
        while len(alive):
            done = length[alive] == at
            if done.any():
                ended = alive[done]
                ok = self.final[state[done]] == 1
                out[ended[ok]] = total[done][ok]
                alive, state, total = alive[~done], state[~done], total[~done]
                if not len(alive):
                    break
            wanted = state << 8 | data[start[alive] + at]
            k = np.searchsorted(self.key, wanted)
            k[k == len(self.key)] = 0
            hit = self.key[k] == wanted
            alive, k = alive[hit], k[hit]
            state, total = self.target[k].astype(np.int64), total[hit] + self.skip[k]
            at += 1
        return out


class Slots(dict):
    """Numbers words as they are first met and holds those not looked up yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        slot = self[word] = len(self)
        self.new.append(word)
        return slot


class Encoder:
    """Encodes blocks of texts in one worker; each distinct piece is looked up once until the memo is full."""

    MEMO = 200_000

    def __init__(self, lexicon: Lexicon, ranks_path: str):
        self.lexicon, self.unseen = lexicon, _merger(ranks_path)
        self._reset()

    def _reset(self) -> None:
        self.slots = Slots()
        self.starts, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.array(self.lexicon.ids)

    def _resolve(self) -> None:
        """Finds the new pieces in the transducer, all at once, and merges those it lacks."""
        words, self.slots.new = self.slots.new, []
        raw = [w.encode() for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        found = self.lexicon.find(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length)
        known = found >= 0
        starts, counts = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[known] = self.lexicon.start[found[known]]
        counts[known] = self.lexicon.start[found[known] + 1] - starts[known]
        extra: list[int] = []
        for i in np.nonzero(~known)[0].tolist():
            ids = self.unseen(words[i])
            starts[i], counts[i] = len(self.pool) + len(extra), len(ids)
            extra += ids
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.pool = np.concatenate([self.pool, np.array(extra, np.int32)])

    def block(self, texts: list[str | None], with_ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array (none if not wanted), and the number of ids of each text."""
        flat: list[str] = []
        marks = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            if text:
                flat += pieces(text)
            marks[i + 1] = len(flat)
        if not flat:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.slots) > self.MEMO:
            self._reset()
        index = np.fromiter(map(self.slots.__getitem__, flat), np.int64, len(flat))
        if self.slots.new:
            self._resolve()
        each = self.counts[index]
        ends = np.cumsum(each)
        sizes = np.diff(np.concatenate([[0], ends])[marks])
        if not with_ids:
            return np.zeros(0, np.int32), sizes
        at = np.arange(ends[-1]) + np.repeat(self.starts[index] - ends + each, each)
        return self.pool[at], sizes


def text_blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text or "")
        if size > BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


@lru_cache(4)
def vocabulary_lexicon(path: str) -> bytes:
    """The transducer of all words of a vocabulary that can be a piece; the same whatever the texts are."""
    words = {}
    for raw, rank in load_ranks(path).items():
        try:
            word = raw.decode()
        except UnicodeDecodeError:  # a part of a character
            continue
        if pieces(word) == [word]:
            words[word] = [rank]
    return compile_lexicon(words)


def build_lexicon(spark: SparkSession, ranks: str = DEFAULT_RANKS) -> str:
    """Compiles the tokenizer's vocabulary; returns the file's name among the files Spark distributes."""
    raw = vocabulary_lexicon(ranks)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    uri = f"{shared_dir(spark)}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(uri)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(raw))
    finally:
        stream.close()
    spark.sparkContext.addFile(uri)
    # the file is with the session's files now; its place in the shared folder is cleared when the interpreter ends
    atexit.register(delete, spark, uri)
    return name


def encode(df: DataFrame, key: str, text: str, ranks: str = DEFAULT_RANKS, lexicon: str | None = None) -> DataFrame:
    """(key, ids array<int>) for every row; no shuffle."""
    name = lexicon or build_lexicon(df.sparkSession, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Lexicon(SparkFiles.get(name)), ranks)
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(1).to_pylist()):
                ids, counts = encoder.block(block)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=["k", "ids"])
                at += len(block)

    slim = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    return slim.mapInArrow(run, f"k {dict(df.dtypes)[key]}, ids array<int>").withColumnRenamed("k", key)


def counter(name: str, ranks: str = DEFAULT_RANKS) -> Callable[[], Callable[[list[str | None]], np.ndarray]]:
    """For workers: makes a function that counts the tokens of each of a list of texts."""

    def make() -> Callable[[list[str | None]], np.ndarray]:
        encoder = Encoder(Lexicon(SparkFiles.get(name)), ranks)

        def count(texts: list[str | None]) -> np.ndarray:
            parts = [encoder.block(block, False)[1] for block in text_blocks(texts)]
            return np.concatenate(parts) if parts else np.zeros(0, np.int64)

        return count

    return make


def count_tokens(df: DataFrame, text: str, out: str = "tokens", ranks: str = DEFAULT_RANKS, lexicon: str | None = None) -> DataFrame:
    """The rows of ``df`` without the text and with its number of tokens."""
    name = lexicon or build_lexicon(df.sparkSession, ranks)
    rest = [c for c in df.columns if c != text]
    make = counter(name, ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(count(batch.column(0).to_pylist()), pa.int64())], names=[*rest, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*rest).dtypes)
    return df.select(F.col(text).cast("string").alias(text), *rest).mapInArrow(run, f"{schema}, `{out}` long" if rest else f"`{out}` long")
