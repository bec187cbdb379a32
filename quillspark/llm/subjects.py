"""Subject areas of documents from distributed latent Dirichlet topics.

One pass turns each text's prose into hashed word counts.  The vocabulary leaves out words
too rare to matter and words that many documents of their language share whatever their subject.  Topics are
fitted on all documents by variational inference with Dirichlet expectations: in each round
each partition infers its documents' topic proportions against the broadcast topics and
returns expected counts, which are summed in the cluster, until the topics stay as they are.
Topics start from the word counts of two thirds of the labelled documents, which also
stay as prior counts; a few topics are free.  Each topic's top terms are then inspected: the
subject that these terms mostly belong to in the subjects' descriptions and in the other third
of the labelled documents, if any, names the topic.  A document gets each subject whose
topics hold at least a share of its subject matter; the share is chosen on the labelled
documents.

Bounds: the vocabulary (at most ``VOCABULARY`` words) and the topics are the only data on
the driver and in broadcasts; both are independent of the number of documents.

Defined results: null, blank and empty texts, and texts without prose or without a word of
the vocabulary, have no subject; repeated texts get the same subjects; a repeated doc_id
keeps the subjects of its longest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import Slots, text_blocks
from quillspark.session import Cut

VOCABULARY = 30_000
FREE_TOPICS = 6
STEPS = 6
STAYS, MOST_ROUNDS = 0.04, 60  # topics stay if no more than this part of all words moves to another word of a topic or another topic
ALPHA, ETA = 0.05, 0.02
COMMON = 0.3
BLOCK = 192
MEMO = 300_000
TOP_TERMS = 100
MOST_SUBJECTS = 1_000  # topics are as many, so more raise an error
LEAST_DF = (3, 20)  # documents a word must be in: one in 5,000 within these bounds
FEW_LABELS = 24  # a subject with fewer labelled documents of a language keeps none of them back

_HEADS = "references|bibliography|literature cited|literatur|literaturverzeichnis|références|bibliographie|referencias|bibliografía|список литературы|литература|参考文献|المراجع|संदर्भ|เอกสารอ้างอิง"
_REFERENCES = re.compile(rf"(?:^[ \t]*(?:#+[ \t]*|\\(?:section|subsection)\*?\{{)?(?:{_HEADS})\}}?:?[ \t]*$|\\begin\{{thebibliography\}}).*?(?=^[ \t]*(?:#+[ \t]|\\(?:sub)*section\b|\\appendix\b)|\\end\{{thebibliography\}}|\Z)", re.I | re.M | re.S)
_HEAD_WORDS = (*_HEADS.split("|"), "thebibliography")
_NOISE = re.compile(r"^[ \t]*(?:#+[ \t].*|\[\d+\][ \t].*|\\(?:sub)*section\*?\{[^}]*\}[ \t]*)$|\\[a-zA-Z]+(?:\[[^\]]*\])?(?:\{[^{}]*\})?|</?[a-zA-Z][^<>]*>|https?://\S+", re.M)
_BROKEN = re.compile(r"(?<=\w)[-‐­]\r?\n\s*(?=\w)")
_WORD = re.compile(r"[^\W\d_][^\s\d!-/:-@\[-`{-¿ -⁯、-〟！-／：-＠［-｀｛-･؛؟،।॥]+")
_UNSPACED = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")


def _prose(text: str) -> str:
    """The prose of a text in lower case; the cheap tests only spare patterns that cannot match."""
    if "-\n" in text or "-\r" in text or "\u2010" in text or "\xad" in text:
        text = _BROKEN.sub("", text)
    low = text.lower()
    if any(head in low for head in _HEAD_WORDS):
        text = _REFERENCES.sub(" ", text)
        low = text.lower()
    if "\\" in text or "<" in text or "#" in text or "[" in text or "://" in text:
        low = _NOISE.sub(" ", text).lower()
    return low


def _terms(word: str) -> list[str]:
    """The terms of a run of letters: itself, or in scripts without blanks its pairs of characters."""
    if word.isascii() or not _UNSPACED.match(word):
        return [word] if len(word) > 2 else []
    return [word[i : i + 2] for i in range(len(word) - 1)]


def words(text: str) -> list[str]:
    """Terms of the prose of a text."""
    return [term for word in _WORD.findall(_prose(text)) for term in _terms(word)]


_BAG = "doc_id long, lang string, h array<int>, c array<int>, terms array<string>, tokens long"


def _bags(keep: list[str], counter) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and rows without a doc_id that give the words behind the hashes."""

    heads = ["doc_id", "lang", "h", "c", "terms", "tokens", *keep]
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count_tokens = counter() if counter else None
        slots, starts, sizes, pool = Slots(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            begin = 0
            for texts in text_blocks(batch.column(2).to_pylist()):
                n = len(texts)
                part = batch.slice(begin, n)
                begin += n
                # every run of letters gets a number; a number stands for the hashes of the run's terms
                flat: list[str] = []
                marks = np.zeros(n + 1, np.int64)
                for i, text in enumerate(texts):
                    if text:
                        flat += _WORD.findall(_prose(text))
                    marks[i + 1] = len(flat)
                index = np.fromiter(map(slots.__getitem__, flat), np.int64, len(flat))
                fresh: dict[str, int] = {}
                if slots.new:
                    added = [[fresh.setdefault(t, zlib.crc32(t.encode())) for t in _terms(word)] for word in slots.new]
                    slots.new = []
                    size = np.fromiter(map(len, added), np.int64, len(added))
                    starts = np.concatenate([starts, len(pool) + np.cumsum(size) - size])
                    sizes = np.concatenate([sizes, size])
                    pool = np.concatenate([pool, np.array([h for hs in added for h in hs], np.uint64)])
                each = sizes[index]
                ends = np.cumsum(each)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - ends + each, each)
                doc = np.repeat(np.repeat(np.arange(n, dtype=np.uint64), np.diff(marks)), each)
                key, count = np.unique(doc << np.uint64(32) | pool[at], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32)), pa.int32())
                h = ((key & np.uint64(0xFFFFFFFF)).astype(np.int64) - 2**31).astype(np.int32)
                langs = pa.array([(x or "").lower()[:2] for x in part.column(1).to_pylist()], pa.string())
                tokens = pa.array(count_tokens(texts), pa.int64()) if count_tokens else pa.nulls(n, pa.int64())
                columns = [part.column(0), langs, pa.ListArray.from_arrays(offsets, pa.array(h)), pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int32))), pa.nulls(n, pa.list_(pa.string())), tokens]
                yield pa.RecordBatch.from_arrays([*columns, *part.columns[3:]], names=heads)
                if fresh:
                    rest = [pa.nulls(1, c.type) for c in part.columns[3:]]
                    named = pa.array([[x - 2**31 for x in fresh.values()]], lists)
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), named, pa.nulls(1, lists), pa.array([list(fresh)], pa.list_(pa.string())), pa.nulls(1, pa.int64()), *rest], names=heads)
                if len(slots) > MEMO:
                    slots, starts, sizes, pool = Slots(), starts[:0], sizes[:0], pool[:0]

    return run


def _held(vocabulary_b, keep: list[str]):
    """Of the words of (doc_id, h, c, ...) those of the vocabulary, by their place in it, with the weight of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_b.value
        for batch in batches:
            h, c = batch.column(1), batch.column(2)
            offsets = np.asarray(h.offsets, np.int64)
            values = np.asarray(h.values)[offsets[0] : offsets[-1]]
            counts = np.asarray(c.values)[c.offsets[0].as_py() : c.offsets[-1].as_py()]
            at = np.searchsorted(vocabulary, values)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == values
            before = np.concatenate([[0], np.cumsum(hit)])[offsets - offsets[0]]
            ends = pa.array(before, pa.int32())
            # repeated mentions tell less and less
            weight = np.sqrt(counts[hit]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(at[hit].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(weight)), *batch.columns[3:]], names=["doc_id", "w", "c", *keep])

    return run


def _csr(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, weight) of a batch (doc_id, w, c), in row order."""
    w, c = batch.column(1), batch.column(2)
    offsets = np.asarray(w.offsets, np.int64)
    word = np.asarray(w.values)[offsets[0] : offsets[-1]]
    weight = np.asarray(c.values)[c.offsets[0].as_py() : c.offsets[-1].as_py()]
    return np.repeat(np.arange(batch.num_rows), np.diff(offsets)), word, weight


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp of the digamma function: three steps of its recurrence, then its asymptotic series."""
    y = x + 3
    z = 1 / (y * y)
    return np.exp(np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - 1 / x - 1 / (x + 1) - 1 / (x + 2))


def expectation(counts: np.ndarray) -> np.ndarray:
    """exp of the expected logarithms of topics with Dirichlet parameters ``counts`` (V, K)."""
    return (exp_digamma(counts) / exp_digamma(counts.sum(0))).astype(np.float32)


def infer(row: np.ndarray, word: np.ndarray, count: np.ndarray, n: int, topics: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Dirichlet parameters of each document's topics (n, K), 0 for one without words, and expected counts of each entry; ``topics`` is (V, K) of ``expectation``.

    Documents go in blocks whose arrays stay in the processor's cache.
    """
    k = topics.shape[1]
    theta, share = np.zeros((n, k), np.float32), np.empty((len(row), k), np.float32)
    edges = np.searchsorted(row, np.arange(0, n + BLOCK, BLOCK))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if begin == end:
            continue
        own = row[begin:end]
        first = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1])
        place = np.repeat(np.arange(len(first)), np.diff(np.append(first, end - begin)))
        phi, amount = topics[word[begin:end]], count[begin:end]
        weight = ALPHA + np.repeat(np.add.reduceat(amount, first)[:, None] / k, k, 1)
        for _ in range(steps):
            part = exp_digamma(weight).astype(np.float32)
            at = part[place]
            scale = (amount / np.maximum(np.einsum("ij,ij->i", phi, at), 1e-30))[:, None]
            weight = part * np.add.reduceat(phi * scale, first, axis=0) + ALPHA
        share[begin:end] = phi * at * scale
        theta[own[first]] = weight
    return theta, share


def _expected(topics_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = topics_b.value
        total = np.zeros(topics.shape, np.float64)
        for batch in batches:
            if not batch.num_rows:
                continue
            row, word, count = _csr(batch)
            _, share = infer(row, word, count, batch.num_rows, topics)
            for k in range(topics.shape[1]):
                total[:, k] += np.bincount(word, share[:, k], len(topics))
        for begin in range(0, len(topics), 2048):
            yield pa.RecordBatch.from_arrays([pa.array([begin // 2048], pa.int32()), pa.array([total[begin : begin + 2048].astype(np.float32).tobytes()], pa.binary())], names=["part", "counts"])

    return run


def _sum_parts(table: pa.Table) -> pa.Table:
    parts = table["counts"].to_pylist()
    total = np.zeros(len(parts[0]) // 4, np.float64)
    for p in parts:
        total += np.frombuffer(p, np.float32)
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def _shares(topics_b, owner: np.ndarray, n_subjects: int, keep: list[str]):
    """Each document's share of every subject among its subject matter, and the amount of that matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = topics_b.value
        for batch in batches:
            if not batch.num_rows:
                continue
            row, word, count = _csr(batch)
            theta, _ = infer(row, word, count, batch.num_rows, topics, STEPS * 2)
            theta = np.maximum(theta - ALPHA, 0)
            by = np.zeros((batch.num_rows, n_subjects), np.float32)
            for k, s in enumerate(owner):
                if s >= 0:
                    by[:, s] += theta[:, k]
            matter = by.sum(1)
            by /= np.maximum(matter, 1e-9)[:, None]
            offsets = pa.array(np.arange(batch.num_rows + 1) * n_subjects, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matter), pa.ListArray.from_arrays(offsets, pa.array(by.ravel())), *batch.columns[3:]], names=["doc_id", "matter", "shares", *keep])

    return run


class SubjectModel:
    """Fitted topics with their subjects; ``topics`` are their word probabilities, ``expected`` what documents are inferred against."""

    def __init__(self, subjects, terms, topics, expected, owner, entries):
        self.subjects, self.terms, self.topics, self.expected, self.owner, self.entries = subjects, terms, topics, expected, owner, entries

    def top_terms(self, most: int = 10) -> list[tuple[str | None, list[str]]]:
        weight = _distinctive(self.topics)
        return [(self.subjects[s] if s >= 0 else None, [self.terms[w] for w in np.argsort(-weight[:, k])[:most]]) for k, s in enumerate(self.owner)]


def _distinctive(topics: np.ndarray) -> np.ndarray:
    """How much a word tells of a topic: its probability times the log of its lift."""
    mean = topics.mean(1, keepdims=True)
    return topics * np.log(np.maximum(topics, 1e-12) / np.maximum(mean, 1e-12))


def bags(documents: DataFrame, cut: Cut, keep: list[str] | None = None, counter=None) -> DataFrame:
    """The word counts of all documents, with the columns ``keep``; ``counter`` makes a function that counts the tokens of a list of texts."""
    keep = keep or []
    slim = documents.filter("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"), *keep)
    schema = ", ".join([_BAG, *(f"`{c}` {t}" for c, t in documents.select(*keep).dtypes)])
    return cut(slim.mapInArrow(_bags(keep, counter), schema))


def fit(table: DataFrame, labels: DataFrame, areas: DataFrame, cut: Cut, keep: list[str] | None = None, seed: int = 7) -> SubjectModel:
    """Topics of the bags of all documents; ``labels`` has doc_id and subject, ``areas`` subject and description.

    The model also holds the documents' entries (doc_id, w, c) with the columns ``keep`` of the bags.
    """
    spark = table.sparkSession
    listed = areas.filter("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).limit(MOST_SUBJECTS + 1).collect()
    if len(listed) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects")
    described = {r.subject: set(words(r.description or "")) for r in listed}
    subjects = sorted(described)
    docs = table.filter("doc_id is not null")
    # document frequency of each word in all and in the language that uses it most
    by_lang = docs.select("lang", F.explode("h").alias("h")).groupBy("h", "lang").agg(F.count("*").alias("df"))
    sizes = docs.filter("size(h) > 0").groupBy("lang").agg(F.count("*").alias("n"))
    least = min(max(LEAST_DF[0], docs.count() // 5_000), LEAST_DF[1])
    frequency = by_lang.join(sizes, "lang", "left")
    frequency = frequency.groupBy("h").agg(F.sum("df").alias("df"), F.max_by(F.col("df") / F.col("n"), "df").alias("ratio"))
    kept = frequency.filter(F.col("df") >= least).select("h", "df", F.coalesce("ratio", F.lit(0)).alias("ratio")).orderBy(F.desc("df"), "h").limit(VOCABULARY)
    found = sorted((r.h, r.ratio) for r in kept.select("h", "ratio").collect())
    vocabulary, ratio = np.array([h for h, _ in found], np.int32), np.array([r for _, r in found])
    at = {h: i for i, h in enumerate(vocabulary.tolist())}
    held = spark.createDataFrame([(h,) for h in at], "h int")
    # words of labelled documents; a document with two labels counts half for each
    clean = labels.select("doc_id", "subject").filter(F.col("subject").isin(subjects)).distinct()
    labelled = cut(clean.groupBy("doc_id").agg(F.collect_list("subject").alias("ss")).join(docs.select("doc_id", "lang", "h"), "doc_id"))
    # a third of the labelled documents names the topics, of subjects that have enough of them in a language
    each = labelled.select("doc_id", "lang", F.explode("ss").alias("subject"))
    enough = each.groupBy("subject", "lang").agg((F.count("*") >= FEW_LABELS).alias("enough"))
    spare = each.join(enough, ["subject", "lang"], "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("enough", F.lit(False))).alias("enough"))
    kept_back = (F.pmod(F.xxhash64(F.lit("name"), "doc_id"), F.lit(3)) == 0) & F.col("enough")
    weight = labelled.join(spare, "doc_id").select(F.explode("h").alias("h"), "ss", kept_back.alias("back")).join(F.broadcast(held), "h", "left_semi").select("h", "back", F.explode("ss").alias("subject"), (1 / F.size("ss")).alias("w"))
    seeds, naming = np.zeros((2, len(vocabulary), len(subjects)))
    for r in weight.groupBy("h", "subject", "back").agg(F.sum("w").alias("w")).collect():
        (naming if r.back else seeds)[at[r.h], subjects.index(r.subject)] += r.w
    # words that most documents of their language share are left out, unless labelled documents tie them to one subject
    share = (seeds.sum(0) + 1) / (seeds.sum() + len(subjects))
    tied = ((seeds + share) / (seeds.sum(1, keepdims=True) + 1) >= 0.5 + 0.5 * share).any(1) & (seeds.sum(1) >= 5) if subjects else np.zeros(0, bool)
    use = (ratio <= COMMON) | tied if subjects else ratio <= COMMON
    vocabulary, seeds, naming = vocabulary[use], seeds[use], naming[use]
    at = {h: i for i, h in enumerate(vocabulary.tolist())}
    keep = keep or []
    schema = ", ".join(["doc_id long, w array<int>, c array<float>", *(f"`{c}` {t}" for c, t in table.select(*keep).dtypes)])
    k = len(subjects) + FREE_TOPICS
    if not len(vocabulary) or not subjects:
        empty = docs.select("doc_id", F.array().cast("array<int>").alias("w"), F.array().cast("array<float>").alias("c"), *keep)
        flat = np.full((max(len(vocabulary), 1), k), ETA, np.float32)
        return SubjectModel(subjects, [], flat, flat, np.full(k, -1), empty)
    entries = cut(docs.select("doc_id", "h", "c", *keep).mapInArrow(_held(spark.sparkContext.broadcast(vocabulary), keep), schema))
    held = spark.createDataFrame([(h,) for h in at], "h int")
    names = table.filter("doc_id is null").select(F.explode(F.arrays_zip("h", "terms")).alias("x")).select("x.h", F.col("x.terms").alias("term"))
    terms = [""] * len(vocabulary)
    for r in names.join(F.broadcast(held), "h", "left_semi").groupBy("h").agg(F.min("term").alias("term")).collect():
        terms[at[r.h]] = r.term
    for s, subject in enumerate(subjects):
        for word in described[subject]:
            if (i := at.get(zlib.crc32(word.encode()) - 2**31)) is not None:
                naming[i, s] += 3
    # a word says much of a subject if its labelled documents agree; the rest of its weight is noise
    agree = (seeds + 0.1) / (seeds + 0.1).sum(1, keepdims=True)
    prior = seeds * np.maximum(agree - 0.15, 0) ** 2
    rng = np.random.default_rng(seed)
    topics = np.full((len(vocabulary), k), ETA)
    topics[:, : len(subjects)] += prior
    # free topics begin with the words that no subject claims
    topics[:, len(subjects) :] += rng.gamma(1.0, 0.3, (len(vocabulary), FREE_TOPICS)) * (seeds.sum(1, keepdims=True) + 1) * (1 - agree.max(1, keepdims=True)) ** 2
    # alike in weight, as nothing is known of how much each topic will hold
    counts = topics / topics.sum(0) * 1e4 + ETA
    for _ in range(MOST_ROUNDS):
        topics_b = spark.sparkContext.broadcast(expectation(counts))
        parts = entries.select("doc_id", "w", "c").mapInArrow(_expected(topics_b), "part int, counts binary").groupBy("part").applyInArrow(_sum_parts, "part int, counts binary").collect()
        before = counts / counts.sum()
        counts = np.concatenate([np.frombuffer(p.counts, np.float32).reshape(-1, k) for p in sorted(parts, key=lambda p: p.part)]).astype(np.float64)
        counts += ETA
        counts[:, : len(subjects)] += prior * 5
        topics_b.unpersist()
        moved = np.abs(counts / counts.sum() - before).sum() / 2
        if moved <= STAYS:
            break
    else:
        raise RuntimeError(f"topics still move after {MOST_ROUNDS} rounds")
    topics = (counts / counts.sum(0)).astype(np.float32)
    # inspect the top terms of each topic
    weight = _distinctive(topics)
    if not naming.any():  # too few labelled documents to keep some back
        naming = seeds
    said = (naming + 0.1) / (naming + 0.1).sum(1, keepdims=True)
    owner = np.full(k, -1)
    for t in range(k):
        top = np.argsort(-weight[:, t])[:TOP_TERMS]
        # terms that no such document holds cannot vote
        power = np.maximum(weight[top, t], 0) * (naming[top].sum(1) > 0)
        votes = (said[top] * power[:, None]).sum(0) / max(power.sum(), 1e-12)
        best = int(((votes - share) / (1 - share)).argmax())
        # a subject names a topic if it has clearly more of the top terms' weight than its share of the labels
        if votes[best] > share[best] + 0.25 * (1 - share[best]):
            owner[t] = best
    return SubjectModel(subjects, terms, topics, expectation(counts), owner, entries)


def shares(model: SubjectModel, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, matter, shares) of all documents, with the columns ``keep``."""
    keep = keep or []
    run = _shares(model.entries.sparkSession.sparkContext.broadcast(model.expected), model.owner, len(model.subjects), keep)
    schema = ", ".join(["doc_id long, matter float, shares array<float>", *(f"`{c}` {t}" for c, t in model.entries.select(*keep).dtypes)])
    return model.entries.select("doc_id", "w", "c", *keep).mapInArrow(run, schema)


def threshold(shared: DataFrame, labels: DataFrame, subjects: list[str], least: float = 0.15, most: float = 0.4) -> float:
    """The share from which labelled documents are labelled with a subject: the best F1 over steps of 0.01."""
    marked = labels.filter(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("ss"))
    names = F.array(*[F.lit(s) for s in subjects])
    pairs = marked.join(shared.filter("matter > 0"), "doc_id").select(F.explode(F.arrays_zip(names.alias("s"), F.col("shares").alias("v"))).alias("x"), "ss")
    bins = pairs.select(F.floor(F.col("x.v") * 100).cast("int").alias("bin"), F.array_contains("ss", F.col("x.s")).alias("yes")).groupBy("bin").agg(F.sum(F.col("yes").cast("long")).alias("yes"), F.count("*").alias("n")).collect()
    if not bins:
        return 0.25
    yes, n = np.zeros(101), np.zeros(101)
    for r in bins:
        yes[min(r.bin, 100)] += r.yes
        n[min(r.bin, 100)] += r.n
    hit, taken = np.cumsum(yes[::-1])[::-1], np.cumsum(n[::-1])[::-1]
    f1 = 2 * hit / np.maximum(taken + yes.sum(), 1)
    low, high = int(least * 100), int(most * 100)
    return (low + int(np.argmax(f1[low : high + 1]))) / 100


def assign(documents: DataFrame, labels: DataFrame, areas: DataFrame, matter: float = 2.0) -> tuple[DataFrame, SubjectModel, float]:
    """(doc_id, subject, share) of every subject a document deals with."""
    cut = Cut(documents.sparkSession)
    table = bags(documents, cut)
    model = fit(table, labels, areas, cut)
    if not len(model.subjects):
        return table.select("doc_id", F.lit("").alias("subject"), F.lit(0.0).cast("float").alias("share")).limit(0), model, 0.25
    shared = cut(shares(model))
    level = threshold(shared, labels, model.subjects)
    names = F.array(*[F.lit(s) for s in model.subjects])
    one = shared.groupBy("doc_id").agg(F.max_by("shares", "matter").alias("shares"), F.max("matter").alias("matter"))
    found = one.filter(F.col("matter") >= matter).select("doc_id", F.explode(F.arrays_zip(names.alias("subject"), F.col("shares").alias("share"))).alias("x"))
    return found.select("doc_id", "x.subject", "x.share").filter(F.col("share") >= level), model, level


def leading(documents: DataFrame, labels: DataFrame, areas: DataFrame, keep: list[str], counter=None) -> DataFrame:
    """(doc_id, topic, language, tokens, keep...): the subject with the greatest share of each document, '' where it has none."""
    cut, keep = Cut(documents.sparkSession), ["lang", "tokens", *keep]
    model = fit(bags(documents, cut, keep[2:], counter), labels, areas, cut, keep)
    names = F.array(*[F.lit(s) for s in [*model.subjects, ""]])
    best = F.array_position("shares", F.array_max("shares")).cast("int")
    topic = F.when((F.col("matter") > 0) & (best > 0), F.get(names, best - 1)).otherwise("")
    return shares(model, keep).select("doc_id", topic.alias("topic"), F.col("lang").alias("language"), *keep[1:])
