"""Linking variant spellings of one person by merging and matching again.

A profile starts as one spelling at one institution.  Profiles meet under keys made of
their institution and family name, one of them in full and of the other only the head or
tail, so that an error in either leaves a common key; names in reversed order are keyed
both ways.  Profiles that agree in full are merged; their spellings, initials and
institutions are united, and the richer profile enters the blocking again.  A poorer
spelling, such as one with initials only, joins if all profiles it fits agree with one another.
The rounds end when nothing merges.

Merging can only happen within a neighbourhood, a connected component of the spellings
that match at all.  So neighbourhoods are found first, and the rounds of one of up to
``NEIGHBOURS`` spellings run in one task; larger ones go through the same rounds as
distributed joins, with the same result.

Which given names are short for which others is learned from the data: two given names
that are the only ones of a family at an institution, far more often than chance would have
it, name one person.

Spellings without an institution are merged with one another if they agree in full, and
join a person if the persons whose name agrees with them best are one person; if those are
several, they stay apart.

Defined results: rows with a null id are left out; a row without any name stays alone;
repeated rows fall into one profile.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import names
from quillspark.llm.graph import components
from quillspark.session import Cut

SPELLING = "pid long, inst string, form string"
PROFILE = "pid long, insts array<string>, forms array<string>"
RUN_BLOCK = 400
NEIGHBOURS = 400
MOST_ROUNDS = 1_000


def form(given: str | None, family: str | None) -> str:
    a, b = names.person(given, family)
    return " ".join(a) + "|" + " ".join(b)


@lru_cache(100_000)
def _parse(text: str) -> tuple[tuple[str, ...], tuple[str, ...], dict[str, frozenset[str]]]:
    """Given names, family names and, after a second bar, what short names stand for: "jo ann|doe|jo=josephine,joanna"."""
    a, b, *rest = text.split("|")
    longs = {k: frozenset(v.split(",")) for k, _, v in (e.partition("=") for e in rest[0].split(";"))} if rest else {}
    return tuple(a.split()), tuple(b.split()), longs


def _families(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    a, b = tuple(t for t in a if t not in names.PARTICLES) or a, tuple(t for t in b if t not in names.PARTICLES) or b
    if not a or not b:
        return False
    if a == b or names.near("".join(a), "".join(b)):
        return True
    if len(a) > len(b):
        a, b = b, a
    # a part of a double name may be missing or shortened to its initial
    return len(a) == len(b) == 2 and names.near(a[0], b[0]) and 1 in (len(a[1]), len(b[1])) and a[1][0] == b[1][0]


_NONE: frozenset[str] = frozenset()


def _givens(a: tuple[str, ...], b: tuple[str, ...], la: dict[str, frozenset[str]], lb: dict[str, frozenset[str]]) -> int:
    """3 the same names, 2 one lacks further names, 1 the first is an initial or a shortening, 0 different; -1 nothing to compare."""
    if not a or not b:
        return -1
    ja, jb = "".join(a), "".join(b)
    if len(ja) > 4 and names.near(ja, jb):
        return 3
    if len(a) > 1 and len(a[0]) > 1 and a[0] + a[1] == b[0]:
        a = (b[0], *a[2:])
    elif len(b) > 1 and len(b[0]) > 1 and b[0] + b[1] == a[0]:
        b = (a[0], *b[2:])
    first = names.same_given(a[0], b[0], la.get(a[0], _NONE), lb.get(b[0], _NONE))
    if not first:
        return 0
    level = 3 if first == 2 else 1
    for x, y in zip(a[1:], b[1:]):
        rest = names.same_given(x, y, la.get(x, _NONE), lb.get(y, _NONE))
        if not rest:
            return 0
        if rest == 1 and len(x) != len(y):
            level = min(level, 2)
    if len(a) != len(b):
        level = min(level, 2)
    return level


@lru_cache(200_000)
def compare_forms(x: str, y: str) -> int:
    """Level of agreement of two spellings; 0 for different people, -1 if the family names differ."""
    (ga, fa, la), (gb, fb, lb) = _parse(x), _parse(y)
    best = -1
    if _families(fa, fb):
        best = max(best, _givens(ga, gb, la, lb))
    if ga and gb and (_families(fa, gb) and _givens(ga, fb, la, lb) >= 1 or _families(ga, fb) and _givens(fa, gb, la, lb) >= 1):
        swapped = max(_givens(ga, fb, la, lb) if _families(fa, gb) else -1, _givens(fa, gb, la, lb) if _families(ga, fb) else -1)
        best = max(best, swapped)
    return best


def compare(a: list[str], b: list[str]) -> int:
    """Level of two profiles: the best of their spellings, unless full names contradict."""
    best, clash = -1, False
    for x in a:
        for y in b:
            level = compare_forms(x, y)
            best = max(best, level)
            clash = clash or level == 0
    return 0 if clash and best < 3 else best


def _institutions(a: list[str], b: list[str]) -> bool:
    return any(names.near(x, y) or len(x) > 7 < len(y) and names.apart(x, y) <= 2 for x in a for y in b)


def _orders(text: str) -> Iterator[tuple[str, tuple[str, ...]]]:
    """(family name, leading letters of the given name) of both orders of a spelling."""
    given, family, longs = _parse(text)
    family = tuple(t for t in family if t not in names.PARTICLES) or family
    for g, f in [(given, family), (family, given)] if given and family else [(given, family)]:
        if f:
            yield "".join(f), tuple({g[0][0], *(n[0] for n in longs.get(g[0], ()))} if g else ("",))


def keys(insts: list[str], forms: list[str]) -> set[str]:
    """Keys of a profile: an institution with the head or tail of the family name, or the other way; without an institution the family name and what remains of it if a letter is left out."""
    out = set()
    for text in forms:
        for whole, leads in _orders(text):
            out.update(f"a{inst}/{whole[:4]}" for inst in insts if inst)
            out.update(f"b{inst}/{whole[-4:]}" for inst in insts if inst)
            for lead in leads:
                for inst in insts:
                    if inst:
                        out.update((f"c{whole}/{inst[:4]}/{lead}", f"d{whole}/{inst[-4:]}/{lead}"))
                    else:
                        bare = names.plain(whole)
                        out.update(f"e{w}/{lead}" for w in {whole, bare, *(bare[:i] + bare[i + 1 :] for i in range(len(bare)) if len(bare) > 3)})
    return out


def _normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, given, family, place = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([names.institution(p) for p in place], pa.string()), pa.array([form(g, f) for g, f in zip(given, family)], pa.string())], names=["id", "inst", "form"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pids, places, forms, *_ = (c.to_pylist() for c in batch.columns)
        key, row = [], []
        for i, (p, f) in enumerate(zip(places, forms)):
            for k in keys(p, f):
                key.append(k)
                row.append(i)
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), *[c.take(take) for c in batch.columns]], names=["key", *batch.schema.names])


def _groups(batches: Iterator[pa.RecordBatch], heads: int) -> Iterator[list[tuple]]:
    """The rows of each group, which lie together; the first ``heads`` columns name the group."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:heads] != last:
                if rows:
                    yield rows
                last, rows = row[:heads], []
            rows.append(row[heads:])
    if rows:
        yield rows


def level_of(ia: list[str], fa: list[str], ib: list[str], fb: list[str]) -> int:
    """Level of two profiles with their institutions; those without one need a first name in full."""
    if not _institutions(ia, ib):
        return 0
    level = compare(fa, fb)
    return level if level >= 2 or ia != [""] else 0


def _matches(anywhere: bool):
    """Edges of the profiles of each (key, block); ``anywhere`` whatever their institutions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            found = []
            for i, (pa_, ia, fa, na, sa) in enumerate(rows):
                for pb, ib, fb, nb, sb in rows[i + 1 :]:
                    if pa_ == pb or sa == sb and sa != 2 or not (na or nb):
                        continue
                    if (level := compare(fa, fb) if anywhere else level_of(ia, fa, ib, fb)) > 0:
                        found.append((min(pa_, pb), max(pa_, pb), level))
            if found:
                yield _edges(found)

    return run


def _edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, level = zip(*set(found)) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(level, pa.int32())], names=["a", "b", "level"])


def _rank(forms: list[str]) -> int:
    """How much a profile tells of the given names: full names, then names, then letters."""
    best = 0
    for text in forms:
        given = _parse(text)[0]
        best = max(best, sum(len(g) > 1 for g in given) * 1_000_000 + len(given) * 10_000 + sum(map(len, given)))
    return best


def _settle(rows: list[tuple[int, list[str], list[str]]]) -> list[tuple[int, list[str], list[str], list[int]]]:
    """Profiles of one neighbourhood merged by the rounds of ``_rounds``, in memory; the last field has the profiles merged."""
    profiles = {pid: (insts, forms) for pid, insts, forms in rows}
    owner = {pid: pid for pid in profiles}
    while True:
        ids = sorted(profiles)
        edges = {}
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                if (level := level_of(*profiles[a], *profiles[b])) > 0:
                    edges[a, b] = level
        chosen = [e for e, level in edges.items() if level >= 3]
        if not chosen:
            rank = {p: _rank(profiles[p][1]) for p in ids}
            options: dict[int, list[int]] = {}
            for a, b in edges:
                poor, rich = (a, b) if rank[a] <= rank[b] else (b, a)
                options.setdefault(poor, []).append(rich)
            for poor, rich in options.items():
                if all(compare(profiles[x][1], profiles[y][1]) > 0 for i, x in enumerate(rich) for y in rich[:i]):
                    chosen += [(poor, r) for r in rich]
        if not chosen:
            olds: dict[int, list[int]] = {}
            for old, p in owner.items():
                olds.setdefault(p, []).append(old)
            return [(p, *profiles[p], olds[p]) for p in ids]
        root = {p: p for p in ids}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in chosen:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        merged: dict[int, tuple[list[str], list[str]]] = {}
        for p in ids:
            insts, forms = merged.setdefault(find(p), ([], []))
            insts += [x for x in profiles[p][0] if x not in insts]
            forms += [x for x in profiles[p][1] if x not in forms]
        profiles = merged
        owner = {s: find(p) for s, p in owner.items()}


MERGED = f"{PROFILE}, olds array<long>"


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, 1):
        pid, insts, forms, olds = zip(*_settle(rows))
        texts = pa.list_(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int64()), pa.array(insts, texts), pa.array(forms, texts), pa.array(olds, pa.list_(pa.int64()))], names=["pid", "insts", "forms", "olds"])


def _with_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_rank(f) for f in batch.column(1).to_pylist()], pa.int64())], names=["pid", "rank"])


def _edges_of(profiles: DataFrame, cut: Cut, anywhere: bool = False) -> DataFrame:
    """(a, b, level) of the profiles that match under a common key and one of which is ``fresh``; ``anywhere`` under their names alone."""
    insts = F.array(F.lit("")).alias("insts") if anywhere else F.col("insts")
    keyed = cut(profiles.select("pid", insts, "forms", "fresh").mapInArrow(_keyed, f"key string, {PROFILE}, fresh boolean"))
    size = keyed.groupBy("key").agg(F.count("*").alias("n"), F.max("fresh").alias("some")).filter("n > 1 and some").drop("some")
    live = keyed.join(size, "key")
    # a key of many profiles is compared block against block
    blocks = F.ceil(F.col("n") / RUN_BLOCK).cast("int")
    live = live.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("pid"), F.col("blocks")))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    live = live.select("key", (low * F.col("blocks") + high).alias("block"), "pid", "insts", "forms", "fresh", side.alias("side"))
    return live.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_matches(anywhere), "a long, b long, level int").groupBy("a", "b").agg(F.max("level").alias("level"))


def _merge(profiles: DataFrame, members: DataFrame, edges: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    roots = cut(components(edges, cut))
    root = F.coalesce("root", "pid")
    moved = profiles.join(roots.withColumnRenamed("id", "pid"), "pid", "left").withColumn("pid", root)
    merged = moved.groupBy("pid").agg(F.array_distinct(F.flatten(F.collect_list("insts"))).alias("insts"), F.array_distinct(F.flatten(F.collect_list("forms"))).alias("forms"))
    placed = members.join(roots.withColumnRenamed("id", "pid"), "pid", "left").select("old", root.alias("pid"))
    return cut(merged), cut(placed)


def _joinable(edges: DataFrame, profiles: DataFrame, cut: Cut) -> DataFrame:
    """Edges of a poorer profile whose richer neighbours all agree with one another."""
    rank = profiles.select("pid", "forms").mapInArrow(_with_rank, "pid long, rank long")
    ranked = edges.join(rank.select(F.col("pid").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("pid").alias("b"), F.col("rank").alias("rb")), "b")
    a_poor = F.col("ra") <= F.col("rb")
    weak = cut(ranked.select(F.when(a_poor, F.col("a")).otherwise(F.col("b")).alias("poor"), F.when(a_poor, F.col("b")).otherwise(F.col("a")).alias("rich")))
    count = weak.groupBy("poor").agg(F.count("*").alias("n"))
    agree = edges.select("a", "b").unionByName(_edges_of(profiles, cut, anywhere=True).select("a", "b")).distinct()
    # the links among the options of a profile are counted, never gathered
    first, second = weak.select("poor", F.col("rich").alias("a")), weak.select("poor", F.col("rich").alias("b"))
    linked = first.join(agree, "a").join(second, ["poor", "b"]).groupBy("poor").agg(F.count("*").alias("links"))
    fits = count.join(linked, "poor", "left").filter(F.coalesce("links", F.lit(0)) == F.col("n") * (F.col("n") - 1) / 2)
    return weak.join(fits.select("poor"), "poor", "left_semi").select(F.col("poor").alias("a"), F.col("rich").alias("b"))


def _rounds(profiles: DataFrame, cut: Cut) -> DataFrame:
    """Profiles with those merged into them, by merging and matching again until nothing merges, each round as joins."""
    members = profiles.select(F.col("pid").alias("old"), "pid")
    for _ in range(MOST_ROUNDS):
        all_fresh = profiles.withColumn("fresh", F.lit(True))
        edges = cut(_edges_of(all_fresh, cut))
        # full agreement goes first: what it merges may settle the poorer spellings
        chosen = cut(edges.filter("level >= 3").select("a", "b"))
        if chosen.isEmpty():
            chosen = cut(_joinable(edges, all_fresh, cut))
            if chosen.isEmpty():
                return profiles.join(members.groupBy("pid").agg(F.collect_list("old").alias("olds")), "pid").select("pid", "insts", "forms", "olds")
        old = profiles, members, edges, chosen
        profiles, members = _merge(profiles, members, chosen, cut)
        cut.release(*old)
    raise RuntimeError(f"profiles still merge after {MOST_ROUNDS} rounds")


def _plain(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "oe", "o"), "ae", "a"), "ue", "u")


def short_names(first: DataFrame) -> DataFrame:
    """(short, long) of given names that stand for one person.

    The evidence are the families of an institution with just two given names.  A pair of
    names is kept if the rarer of them falls to the other in a fifth of its cases at least
    and the number of cases is beyond chance (Chernoff's bound, for as many pairs as there are).
    """
    given = F.split("form", r"\|")
    words = F.filter(F.split(given[1], " "), lambda w: ~w.isin(*sorted(names.PARTICLES)))
    seen = first.filter("inst <> ''").select("inst", _plain(F.array_join(words, "")).alias("family"), _plain(F.element_at(F.split(given[0], " "), 1)).alias("lead")).filter("length(lead) > 1 and family <> ''").distinct()
    cells = seen.groupBy("inst", "family").agg(F.count("*").alias("n"), F.min("lead").alias("a"), F.max("lead").alias("b")).filter("n = 2")
    pairs = cells.groupBy("a", "b").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("name"), "n"), F.struct(F.col("b").alias("name"), "n"))).alias("e")
    each = pairs.select(ends).groupBy("e.name").agg(F.sum("e.n").alias("c"))
    whole = pairs.agg(F.sum("n").alias("cells"), F.count("*").alias("pairs"))
    counted = pairs.filter("n >= 3").join(each.select(F.col("name").alias("a"), F.col("c").alias("ca")), "a").join(each.select(F.col("name").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(whole))
    chance = F.col("ca") * F.col("cb") / (2 * F.col("cells"))
    beyond = F.col("n") * F.log(F.col("n") / chance) - F.col("n") + chance >= F.log(F.col("pairs")) + 3
    kept = counted.filter((F.col("n") >= 0.2 * F.least("ca", "cb")) & (F.col("n") > chance) & beyond & (F.levenshtein("a", "b") > 1))
    a_short = (F.col("ca") < F.col("cb")) | (F.col("ca") == F.col("cb")) & (F.length("a") <= F.length("b"))
    return kept.select(F.when(a_short, F.col("a")).otherwise(F.col("b")).alias("short"), F.when(a_short, F.col("b")).otherwise(F.col("a")).alias("long"))


def _shorts(first: DataFrame, cut: Cut) -> DataFrame:
    """(token, longs) of the words of spellings that are a short name, or a typing error of one of four letters and more."""
    table = cut(short_names(first))
    longs = table.groupBy("short").agg(F.array_join(F.array_sort(F.collect_set("long")), ",").alias("longs"))
    words = first.select(F.explode(F.split(F.regexp_replace("form", r"\|", " "), " ")).alias("token")).distinct()
    plained = words.select("token", _plain(F.col("token")).alias("short"))
    known = cut(plained.join(longs, "short").select("token", "longs"))
    without = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1)))))
    typed = plained.join(known, "token", "left_anti").filter(F.length("short").between(4, 8)).select("token", F.col("short").alias("t"), F.explode(without(F.col("short"))).alias("part"))
    whole = longs.filter("length(short) > 3").select("short", "longs", F.explode(without(F.col("short"))).alias("part"))
    letters = lambda c: F.array_sort(F.split(c, ""))
    near = (F.substring("t", 1, 1) == F.substring("short", 1, 1)) & ((F.levenshtein("t", "short") == 1) | (letters(F.col("t")) == letters(F.col("short"))))
    # a full name of its own that happens to be near a short one is left alone
    own = table.select(F.col("long").alias("t")).distinct()
    slips = typed.join(whole, "part").filter(near).join(own, "t", "left_anti").groupBy("token").agg(F.min_by("longs", "short").alias("longs"))
    return known.unionByName(slips)


def _with_longs(first: DataFrame, cut: Cut) -> DataFrame:
    """Spellings with what their short names stand for after a second bar."""
    shorts = cut(_shorts(first, cut))
    if shorts.isEmpty():
        return first
    words = first.select("pid", F.explode(F.array_distinct(F.split(F.regexp_replace("form", r"\|", " "), " "))).alias("token"))
    known = words.join(shorts, "token").groupBy("pid").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "token", "longs"))), ";").alias("longs"))
    return cut(first.join(known, "pid", "left").select("pid", "inst", F.concat_ws("|", "form", "longs").alias("form")))


def resolve(rows: DataFrame) -> DataFrame:
    """(id, person) for rows of (id long, given, family, place); person is the least id of the spellings linked."""
    cut = Cut(rows.sparkSession)
    normal = cut(rows.filter("id is not null").select("id", "given", "family", "place").mapInArrow(_normal, "id long, inst string, form string"))
    named = normal.filter("form <> '|'")
    spellings = cut(named.groupBy("inst", "form").agg(F.min("id").alias("pid")))
    # rows of one spelling are never gathered: each keeps the number of its spelling
    spelled = cut(named.join(spellings, ["inst", "form"]).select("id", "pid"))
    first = _with_longs(spellings, cut)
    members = _persons(first, cut)
    placed = _without_place(first, members, cut)
    known = spelled.withColumnRenamed("pid", "spelling").join(placed, "spelling").select("id", "pid")
    rest = normal.filter("form = '|'").select("id", F.col("id").alias("pid"))
    everyone = cut(known.unionByName(rest))
    least = everyone.groupBy("pid").agg(F.min("id").alias("person"))
    return cut.only(everyone.join(least, "pid").select("id", "person").distinct())[0]


def _neighbourhoods(profiles: DataFrame, edges: DataFrame, cut: Cut) -> DataFrame:
    """Profiles after the merges within each connected component of the edges, with those merged into them."""
    roots = components(edges, cut).withColumnRenamed("id", "pid")
    large = cut(roots.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > NEIGHBOURS).select("root"))
    near = profiles.join(roots, "pid").select("root", "pid", "insts", "forms")
    if large.isEmpty():
        return near.repartition("root").sortWithinPartitions("root", "pid").mapInArrow(_settled, MERGED)
    small = near.join(large, "root", "left_anti").repartition("root").sortWithinPartitions("root", "pid").mapInArrow(_settled, MERGED)
    return small.unionByName(_rounds(cut(near.join(large, "root", "left_semi").select("pid", "insts", "forms")), cut))


def _persons(first: DataFrame, cut: Cut) -> DataFrame:
    """(spelling, pid) of all spellings, those without an institution apart from the others."""
    profiles = first.select("pid", F.array("inst").alias("insts"), F.array("form").alias("forms"), F.lit(True).alias("fresh"))
    members = first.select(F.col("pid").alias("spelling"), "pid")
    for _ in range(MOST_ROUNDS):
        # only what the last round merged can match anew
        edges = cut(_edges_of(profiles, cut))
        if edges.isEmpty():
            return members
        merged = cut(_neighbourhoods(profiles, edges, cut))
        if merged.filter("size(olds) > 1").isEmpty():
            return members
        moved = merged.select(F.explode("olds").alias("old"), F.col("pid").alias("new"))
        rest = profiles.join(moved, F.col("pid") == F.col("old"), "left_anti").select("pid", "insts", "forms", F.lit(False).alias("fresh"))
        profiles = cut(merged.select("pid", "insts", "forms", (F.size("olds") > 1).alias("fresh")).unionByName(rest))
        members = cut(members.join(moved, F.col("pid") == F.col("old"), "left").select("spelling", F.coalesce("new", "pid").alias("pid")))
    raise RuntimeError(f"profiles still merge after {MOST_ROUNDS} rounds")


def _near_matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns))
        yield _edges([(a, b, level) for a, fa, b, fb in rows if (level := compare_forms(fa, fb)) > 0])


def _named(df: DataFrame) -> DataFrame:
    """With the family name and the first given name of each spelling, in both orders, where both are known."""
    split = F.split("form", r"\|")
    join, lead = lambda c: F.regexp_replace(c, " ", ""), lambda c: F.element_at(F.split(c, " "), 1)
    order = lambda turn, f, g: F.struct(F.lit(turn).alias("turn"), join(split[f]).alias("family"), lead(split[g]).alias("lead"))
    both = df.withColumn("_o", F.explode(F.array(order(0, 1, 0), order(1, 0, 1))))
    return both.withColumns({c: F.col("_o")[c] for c in ("turn", "family", "lead")}).drop("_o").filter("family <> '' and lead <> ''")


def _least_person(df: DataFrame, *by: Column | str) -> DataFrame:
    return df.groupBy(*by).agg(F.min("person").alias("low"), F.max("person").alias("high"))


def _without_place(first: DataFrame, members: DataFrame, cut: Cut) -> DataFrame:
    """(spelling, pid) of all spellings, with those without an institution put to their persons."""
    whole = members.join(first.select(F.col("pid").alias("spelling"), "inst", "form"), "spelling")
    loose, placed = cut(whole.filter("inst = ''").select("spelling", "pid", "form")), whole.filter("inst <> ''")
    settled = placed.select("spelling", "pid")
    if loose.isEmpty():
        return settled
    # a name is one row here whatever the number of its people: what counts is whether there are two
    people = cut(_least_person(placed.select("form", F.col("pid").alias("person")), "form"))
    ends = F.explode(F.array_distinct(F.array("low", "high"))).alias("person")
    known = _named(people.select("form", ends)).filter("turn = 0")
    full = _least_person(known.filter("length(lead) > 1"), "family", "lead")
    initial = _least_person(known, "family", F.substring("lead", 1, 1).alias("lead"))
    exact = _named(loose).join(full.unionByName(initial), ["family", "lead"]).groupBy("spelling").agg(F.min(F.struct("turn", "low", "high")).alias("m")).select("spelling", "m.low", "m.high")
    exact = cut(exact)
    # names that are not known as they are: the known ones near them, by the same comparison
    rest = loose.join(exact, "spelling", "left_anti")
    keyed = lambda df, ident: df.select(ident, F.array(F.lit("")).alias("insts"), F.array("form").alias("forms")).mapInArrow(_keyed, f"key string, {PROFILE}")
    asked = keyed(rest, F.col("spelling").alias("pid")).select("key", F.col("pid").alias("a"), F.col("forms")[0].alias("fa"))
    names_ = keyed(people, F.xxhash64("form").alias("pid")).select("key", F.col("pid").alias("b"), F.col("forms")[0].alias("fb"))
    met = asked.join(names_, "key").select("a", "fa", "b", "fb").distinct()
    near = met.mapInArrow(_near_matches, "a long, b long, level int").join(people.select(F.xxhash64("form").alias("b"), ends), "b")
    fits = _least_person(near.withColumnRenamed("a", "spelling"), "spelling", "level").groupBy("spelling").agg(F.max(F.struct("level", "low", "high")).alias("m")).select("spelling", "m.low", "m.high")
    # spellings that agree in full go together unless their persons are several
    found = exact.unionByName(fits)
    group = loose.join(found, "spelling", "left").groupBy("pid").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    open_ = (F.col("low") < F.col("high")).alias("open_")
    ends_ = loose.join(group.select("pid", "low", open_), "pid").select("spelling", F.when(F.col("low").isNull(), F.col("pid")).when(F.col("open_"), F.col("spelling")).otherwise(F.col("low")).alias("pid"))
    return settled.unionByName(ends_)


def pairs(resolved: DataFrame) -> DataFrame:
    """All pairs (a < b) of spellings of one person."""
    left, right = resolved.select(F.col("id").alias("a"), "person"), resolved.select(F.col("id").alias("b"), "person")
    return left.join(right, "person").filter("a < b").select("a", "b")
