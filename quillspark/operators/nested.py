"""Flat tables of deeply nested JSON text.

``infer`` reads every row once and merges what it sees into one schema: for each field
path the kinds of values that occur.  ``node_lists`` compiles the schema into one JVM
expression that explodes each array level with its ordinal, so that a document is parsed
once; ``child_table`` gives the rows of one level with their own key, the key of their
parent and their ordinal.

Defined results: a null, empty or invalid document has no nodes; a null element is no
node but keeps its position; an object where a list is expected is a list of one; a list
or object written as JSON text counts as what it holds; a bare string is a node only in
the fields named in ``bare``; nodes without children count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_PATHS = 100_000  # a schema of more field paths is none, its keys are data: an error is raised


@dataclass
class Node:
    """A field that holds lists of objects: its scalar columns and its child levels."""

    name: str
    columns: dict[str, set[str]] = field(default_factory=dict)
    children: dict[str, Node] = field(default_factory=dict)


def _unwrap(value):
    """A list or object written as JSON text, as what it holds."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return inner if isinstance(inner, (list, dict)) else value
    return value


def _walk(value: dict, path: str, seen: set[tuple[str, str]]) -> None:
    for key, raw in value.items():
        at = f"{path}\0{key}"
        if isinstance(raw, str) and raw.lstrip()[:1] in ("[", "{"):
            # text such as "[5]" is a marker: only text that holds objects is unwrapped
            inner = _unwrap(raw)
            objects = isinstance(inner, dict) or isinstance(inner, list) and any(isinstance(x, dict) for x in inner)
            raw = inner if objects else raw
        if isinstance(raw, (list, dict)):
            items = raw if isinstance(raw, list) else [raw]
            objects = [x for x in map(_unwrap, items) if isinstance(x, dict)]
            seen.add((at, "list" if objects or not items else "scalars" if any(x is not None for x in items) else "null"))
            for item in objects:
                _walk(item, at, seen)
        else:
            seen.add((at, "null" if raw is None else type(raw).__name__))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple[str, str]] = set()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            try:
                value = json.loads(text or "")
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict):
                _walk(value, "", seen)
    path, kind = zip(*sorted(seen)) if seen else ((), ())
    yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(kind, pa.string())], names=["path", "kind"])


def infer(df: DataFrame, column: str) -> Node:
    """The merged schema of all rows; its size is that of the schema, not of the data."""
    root = Node("")
    found = df.select(F.col(column).alias("t")).mapInArrow(_paths, "path string, kind string").distinct().limit(MOST_PATHS + 1).collect()
    if len(found) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} field paths in {column}: object keys hold data")
    for row in sorted(found, key=lambda r: (r.path, r.kind)):
        *parents, name = row.path.split("\0")[1:]
        node = root
        for parent in parents:
            node = node.children.setdefault(parent, Node(parent))
        if row.kind == "list":
            node.children.setdefault(name, Node(name))
        else:
            node.columns.setdefault(name, set()).add(row.kind)
    return root


def _field(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _object(v: Column) -> Column:
    """The variant if it holds an object, else null; a struct without fields fits any object and copies nothing."""
    return F.when(F.try_variant_get(v, "$", "struct<>").isNotNull(), v)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def elements(v: Column, bare: bool) -> Column:
    """array<variant> of a list-valued field; null where an element is no node."""

    def of(x: Column) -> Column:
        inner = F.try_parse_json(_text(x))
        whole = F.coalesce(_array(x), F.when(_object(x).isNotNull(), F.array(x)))
        unwrapped = F.coalesce(_array(inner), F.when(_object(inner).isNotNull(), F.array(inner)))
        return F.coalesce(whole, unwrapped, F.when(_text(x).isNotNull(), F.array(x)) if bare else F.lit(None))

    def node(x: Column) -> Column:
        inner = F.try_parse_json(_text(x))
        known = F.coalesce(_object(x), _object(inner))
        if bare:
            known = F.coalesce(known, F.when(_array(x).isNull() & _text(x).isNotNull(), x))
        return known

    return F.transform(of(v), node)


def document(text: Column | str) -> Column:
    """The object a text holds as a whole, else null; text after the object makes it invalid, as does a repeated key."""
    text = F.col(text) if isinstance(text, str) else text
    pair = _array(F.try_parse_json(F.concat(F.lit("["), text, F.lit(",0]"))))
    whole = F.when(F.size(pair) == 2, F.get(pair, F.lit(0)))
    return F.coalesce(_object(whole), _object(F.try_parse_json(_text(whole))))


def _child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, _field(name), "variant")


def node_lists(schema: Node, v: Column, bare: frozenset[str] = frozenset(), prefix: Column | None = None, trail: str = "") -> Column:
    """array<struct<level, path>> of all nodes below a variant; level is the trail of field names, path the ordinals joined by dots."""

    def below(child: Node, level: str):
        def nodes(x: Column, i: Column) -> Column:
            path = F.concat_ws(".", prefix, i.cast("string")) if prefix is not None else i.cast("string")
            own = F.array(F.struct(F.lit(level).alias("level"), path.alias("path")))
            if child.children:
                own = F.concat(own, node_lists(child, x, bare, path, level))
            return F.when(x.isNotNull(), own)

        return nodes

    parts = []
    for name, child in schema.children.items():
        lists = F.transform(elements(_child(v, name), name in bare), below(child, f"{trail}/{name}" if trail else name))
        parts.append(F.coalesce(F.flatten(F.filter(lists, lambda a: a.isNotNull())), F.array().cast("array<struct<level:string,path:string>>")))
    return F.concat(*parts) if parts else F.array().cast("array<struct<level:string,path:string>>")


def newest(df: DataFrame, key: str, version: str, column: str, values: Column) -> DataFrame:
    """(key, values) of the newest row of each key; only the key and the values are shuffled, not the documents."""
    order = F.struct(F.col(version), F.xxhash64(column))
    return df.select(key, order.alias("o"), values.alias("v")).groupBy(key).agg(F.max_by("v", "o").alias("v"))


def child_table(df: DataFrame, key: str, column: str, schema: Node, levels: list[str], bare: frozenset[str] = frozenset()) -> DataFrame:
    """Rows of one level: node_key, parent_key, ordinal and the level's scalar fields as text.

    ``levels`` are the field names from the root down, such as ["Fullbody_Parsed", "section_text"].
    Scalar names that clash with the key columns get the level's name in front.
    """
    rows = df.select(F.col(key), document(column).alias("v"), F.lit(None).cast("string").alias("node_key"))
    node = schema
    for depth, name in enumerate(levels):
        node = node.children.get(name, Node(name))
        parent = F.concat_ws("/", F.col(key).cast("string"), F.lit(name)) if depth == 0 else F.col("node_key")
        rows = rows.select(key, F.col("node_key").alias("parent_key"), parent.alias("base"), F.posexplode(elements(_child(F.col("v"), name), name in bare)).alias("ordinal", "v")).filter("v is not null")
        rows = rows.withColumn("node_key", F.concat_ws("/" if depth == 0 else ".", "base", F.col("ordinal").cast("string")))
    taken = {key, "node_key", "parent_key", "ordinal"}
    values = []
    for c in sorted(set(node.columns) - set(node.children)):
        got = F.try_variant_get("v", _field(c), "string")
        if levels[-1] in bare:
            got = F.coalesce(got, F.when(_object(F.col("v")).isNull(), _text(F.col("v")))) if c.endswith("_text") else got
        values.append(got.alias(c if c not in taken else f"{levels[-1]}_{c}"))
    return rows.select(key, "node_key", "parent_key", "ordinal", *values)
