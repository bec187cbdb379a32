"""Projection by dotted paths, compiled to nested selects so that the scan prunes nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _tree(paths: list[str]) -> dict:
    root: dict = {}
    for path in paths:
        node = root
        for part in path.split("."):
            node = node.setdefault(part.lower(), {})
    return root


def _narrow(value: Column, kind: T.DataType, wanted: dict) -> Column:
    if not wanted:
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _narrow(x, kind.elementType, wanted))
    if isinstance(kind, T.StructType):
        kept = [(f, wanted[f.name.lower()]) for f in kind.fields if f.name.lower() in wanted]
        return F.when(value.isNotNull(), F.struct(*[_narrow(value[f.name], f.dataType, w).alias(f.name) for f, w in kept])) if kept else F.lit(None)
    return value


def project(df: DataFrame, projection: dict[str, int] | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the paths whose value is 1; no projection keeps all, an empty one only ``keep``; unknown paths are left out."""
    if projection is None:
        return df
    tree = _tree([p for p, v in projection.items() if v == 1])
    out = [F.col(c) for c in keep]
    for f in df.schema.fields:
        if f.name in keep or f.name.lower() not in tree:
            continue
        out.append(_narrow(F.col(f.name), f.dataType, tree[f.name.lower()]).alias(f.name))
    return df.select(*out)
