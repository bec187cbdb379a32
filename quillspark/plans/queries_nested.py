"""Queries on nested contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import nested
from quillspark.session import table

PARTS = {"Abstract_Parsed": "abstract", "Fullbody_Parsed": "fullbody"}
LEVELS = {1: "section", 2: "paragraph", 3: "sentence", 4: "span"}
CHAIN = ["section_text", "paragraph_text", "cite_spans"]
BARE = frozenset(["paragraph_text"])


def _chains(schema: nested.Node) -> nested.Node:
    """The part of the merged schema that holds sections, paragraphs, sentences and spans."""
    root = nested.Node("")
    for part in PARTS:
        source, target = schema.children.get(part), root
        for name in [part, *CHAIN]:
            if source is None:
                break
            target.children[name] = target = nested.Node(name, source.columns)
            source = source.children.get(CHAIN[([part, *CHAIN].index(name))]) if name != CHAIN[-1] else None
    return root


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "paper_store")
    schema = _chains(nested.infer(store, "parsed_content"))
    nodes = nested.node_lists(schema, nested.document("parsed_content"), BARE)
    rows = nested.newest(store, "id_int", "last_update_unixtime", "parsed_content", nodes).select("id_int", F.explode("v").alias("n"))
    names = F.split("n.level", "/")
    part = F.create_map(*[F.lit(x) for kv in PARTS.items() for x in kv])
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return rows.select("id_int", part[names[0]].alias("content_part"), level[F.size(names)].alias("node_level"), F.col("n.path").alias("node_path"))


def _newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = table(spark, sf_dir, "paper_store")
    return nested.newest(store, "id_int", "last_update_unixtime", "parsed_content", F.col("parsed_content")).withColumnRenamed("v", "parsed_content")


def _level(depth: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _newest_rows(spark, sf_dir)
        schema = nested.infer(table(spark, sf_dir, "paper_store"), "parsed_content")
        tables = [nested.child_table(rows, "id_int", "parsed_content", schema, [part, *CHAIN][:depth], BARE).withColumn("content_part", F.lit(name)) for part, name in PARTS.items()]
        return tables[0].unionByName(tables[1], allowMissingColumns=True)

    return query


QUERIES = {
    "p5_found": p5_found,
    "p5_sections": _level(1),
    "p5_paragraphs": _level(2),
    "p5_sentences": _level(3),
    "p5_spans": _level(4),
}


def _list_sql(v: str, bare: bool = False) -> str:
    """The elements of a JSON value where a list is expected."""
    inner = f"try_cast({v} ->> '$' AS JSON)"
    text = f"WHEN json_type({v}) = 'VARCHAR' THEN [{v}] " if bare else ""
    return (
        f"CASE WHEN json_type({v}) = 'ARRAY' THEN {v} -> '$[*]' WHEN json_type({v}) = 'OBJECT' THEN [{v}] "
        f"WHEN json_type({v}) = 'VARCHAR' AND json_type({inner}) = 'ARRAY' THEN {inner} -> '$[*]' WHEN json_type({v}) = 'VARCHAR' AND json_type({inner}) = 'OBJECT' THEN [{inner}] {text}ELSE [] END"
    )


def _level_sql(name: str, parent: str, field: str, kinds: str, bare: bool = False) -> str:
    step = f"SELECT id_int, content_part, node_path AS up, {_list_sql("v", bare)} AS l FROM (SELECT id_int, content_part, node_path, v -> '{field}' AS v FROM {parent})"
    rows = f"SELECT id_int, content_part, up, unnest(l) AS v, unnest(range(len(l))) AS i FROM ({step})"
    return f"{name} AS (SELECT id_int, content_part, CASE WHEN up = '' THEN '' ELSE up || '.' END || i AS node_path, v FROM ({rows}) WHERE json_type(v) IN ({kinds}))"


_FOUND = (
    """WITH newest AS (SELECT id_int, try_cast(arg_max(coalesce(parsed_content, ''), last_update_unixtime) AS JSON) AS d FROM paper_store GROUP BY id_int),
    top AS (SELECT id_int, 'abstract' AS content_part, '' AS node_path, json_object('f', d -> '$.Abstract_Parsed') AS v FROM newest WHERE json_type(d) = 'OBJECT'
            UNION ALL SELECT id_int, 'fullbody', '', json_object('f', d -> '$.Fullbody_Parsed') FROM newest WHERE json_type(d) = 'OBJECT'), """
    + ", ".join([_level_sql("section", "top", "$.f", "'OBJECT'"), _level_sql("paragraph", "section", "$.section_text", "'OBJECT'"), _level_sql("sentence", "paragraph", "$.paragraph_text", "'OBJECT', 'VARCHAR'", True), _level_sql("span", "(SELECT * FROM sentence WHERE json_type(v) = 'OBJECT')", "$.cite_spans", "'OBJECT'")])
    + " "
    + " UNION ALL ".join(f"SELECT id_int, content_part, '{name}' AS node_level, node_path FROM {name}" for name in ("section", "paragraph", "sentence", "span"))
)

_CTES = _FOUND[: _FOUND.rindex("SELECT id_int, content_part, 'section'")].rstrip()
_PREFIX = {"abstract": "Abstract_Parsed", "fullbody": "Fullbody_Parsed"}


def _table_sql(level: str, fields: list[str], bare: str | None = None) -> str:
    """The child table of one level: keys made of the document, the part and the ordinals, and the scalar fields as text."""
    part = "CASE content_part " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PREFIX.items()) + " END"
    key = f"CAST(id_int AS VARCHAR) || '/' || {part} || '/' || "
    value = lambda f: f"CASE WHEN json_type(v -> '$.{f}') IN ('ARRAY', 'OBJECT') THEN NULL ELSE v ->> '$.{f}' END"
    columns = [f"CASE WHEN json_type(v) = 'VARCHAR' THEN v ->> '$' ELSE {value(f)} END AS {f}" if f == bare else f"{value(f)} AS {f}" for f in fields]
    parent = f"CASE WHEN contains(node_path, '.') THEN {key} regexp_replace(node_path, '\\.[0-9]+$', '') END AS parent_key"
    ordinal = "CAST(regexp_extract(node_path, '[0-9]+$') AS INT) AS ordinal"
    return f"{_CTES} SELECT id_int, content_part, {key} node_path AS node_key, {parent}, {ordinal}, {', '.join(columns)} FROM {level}"


SQL: dict[str, str] = {
    "p5_found": _FOUND,
    "p5_sections": _table_sql("section", ["section_id", "section_title"]),
    "p5_paragraphs": _table_sql("paragraph", ["paragraph_id"]),
    "p5_sentences": _table_sql("sentence", ["sentence_id", "sentence_text"], "sentence_text"),
    "p5_spans": _table_sql("span", ["start", "\"end\"", "text", "ref_id"]),
}
