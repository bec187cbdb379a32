"""Queries on references without a target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import orphans
from quillspark.session import Cut, table

ON = ["collection", "number"]


def _number(text: str) -> F.Column:
    """A whole number written as text, else null."""
    exact = F.expr(f"try_cast(trim({text}) as decimal(38,6))")
    return F.when(exact == F.floor(exact), F.expr(f"try_cast(trim({text}) as decimal(38,6))").cast("long"))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    paper = table(spark, sf_dir, "paper")
    size = F.coalesce(F.when(F.col("reference").isNotNull(), F.size("reference")), F.lit(0))
    targets = paper.select("collection", F.col("id_int").alias("number"), F.col("ingested_at").alias("arrived"), size.alias("size"))
    removed = table(spark, sf_dir, "removal_log").select("collection", F.col("id_int").alias("number"))
    refs = F.transform("cite_spans", lambda s: s.ref_id)
    paragraph = orphans.earliest(table(spark, sf_dir, "paragraph"), "para_id", "ingested_at", [F.col("collection"), F.col("id_int").alias("number"), refs.alias("refs")])
    whole = paragraph.select(F.lit("paragraph").alias("link"), F.col("para_id").alias("key_id"), F.lit(-1).alias("pos"), F.col("ingested_at").alias("arrived"), *ON, "refs")
    # one resolution serves the paragraph and, as its spans point into the same paper, the spans
    placed = Cut(spark)(orphans.resolve(whole, targets, ON))
    span = [F.lit("cite_span").alias("link"), "key_id", "pos", "arrived"]
    spans = placed.drop("link", "pos").select("key_id", "arrived", "number", "known", "size", F.posexplode("refs").alias("pos", "entry")).select(*span, "number", "known", "size", "entry")
    pointers = (
        paper.select("id_int", "ingested_at", F.posexplode("reference").alias("pos", "r"))
        .filter("trim(r.paperid.id_value) <> ''")
        .select(F.lit("reference").alias("link"), F.col("id_int").alias("key_id"), "pos", F.col("ingested_at").alias("arrived"), F.col("r.paperid.collection").alias("collection"), _number("r.paperid.id_value").alias("number"))
    )
    found = orphans.unresolved(placed, removed, ON).unionByName(orphans.outside(spans)).unionByName(orphans.direct(pointers, targets, removed, ON))

    inside = spans.select(*span, F.lit("paragraph").alias("parent_link"), F.col("key_id").alias("parent_key"), F.lit(-1).alias("parent_pos"))
    held = spans.filter(F.col("known") & orphans.valid_entry(F.col("entry"), F.coalesce("size", F.lit(0))))
    cited = held.select(*span, F.lit("reference").alias("parent_link"), F.col("number").alias("parent_key"), F.col("entry").try_cast("int").alias("parent_pos"))
    return orphans.cascade(found, inside.unionByName(cited))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _report(spark, sf_dir).filter("origin = 'direct'")
    return rows.select("link", F.date_format("arrived", "yyyy-MM").alias("arrival_month"), "key_id", "pos", "reason")


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans per link and month, direct and inherited."""
    rows = _report(spark, sf_dir)
    return rows.groupBy("link", F.date_format("arrived", "yyyy-MM").alias("arrival_month"), "reason", "origin").agg(F.count("*").alias("orphans"))


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans of the other tables that refer to papers, per table and month, and what hangs on them: labels and vectors on documents."""
    paper = table(spark, sf_dir, "paper").select("id_int", F.col("ingested_at").alias("arrived"))
    removed = table(spark, sf_dir, "removal_log").select("id_int")
    row = lambda link, key, arrived: [F.lit(link).alias("link"), F.col(key).alias("key_id"), F.lit(-1).alias("pos"), arrived.alias("arrived")]
    documents = table(spark, sf_dir, "documents").filter("id_int is not null").select(*row("document", "doc_id", F.col("ingested_at")), "id_int")
    names = table(spark, sf_dir, "author_name").filter("first_id_int is not null").select(*row("author_name", "name_id", F.col("first_seen_at")), F.col("first_id_int").alias("id_int"))
    found = orphans.direct(documents.unionByName(names), paper, removed, ["id_int"]).groupBy(*orphans.KEY).agg(F.min("arrived").alias("arrived"), F.min("reason").alias("reason"))
    never = F.lit(None).cast("timestamp_ntz")
    hung = [table(spark, sf_dir, name).select(*row(name, key, never), F.lit("document").alias("parent_link"), F.col(key).alias("parent_key"), F.lit(-1).alias("parent_pos")) for name, key in (("subject_label", "doc_id"), ("embeddings", "vec_id"))]
    rows = orphans.cascade(found.select("link", "arrived", "key_id", "pos", "reason"), hung[0].unionByName(hung[1]))
    return rows.groupBy("link", F.date_format("arrived", "yyyy-MM").alias("arrival_month"), "reason", "origin", "depth").agg(F.count("*").alias("orphans"))


_DIRECT = """
WITH removed AS (SELECT DISTINCT collection, id_int FROM removal_log),
     first AS (SELECT para_id, ingested_at, collection, id_int, cite_spans FROM
               (SELECT *, row_number() OVER (PARTITION BY para_id ORDER BY ingested_at) AS rn FROM paragraph) WHERE rn = 1),
     placed AS (SELECT f.*, p.ingested_at AS there, CASE WHEN p.id_int IS NOT NULL THEN coalesce(len(p.reference), 0) END AS n_refs
                FROM first f LEFT JOIN paper p ON p.collection = f.collection AND p.id_int = f.id_int),
     span AS (SELECT para_id, ingested_at, id_int, n_refs, i - 1 AS pos, cite_spans[i].ref_id AS ref_id
              FROM placed, unnest(generate_series(1, len(cite_spans))) AS t(i)),
     ref AS (SELECT id_int, ingested_at, i - 1 AS pos, reference[i].paperid.collection AS collection, try_cast(trim(reference[i].paperid.id_value) AS BIGINT) AS number
             FROM paper, unnest(generate_series(1, len(reference))) AS t(i) WHERE trim(reference[i].paperid.id_value) <> ''),
     direct AS (
       SELECT 'paragraph' AS link, q.ingested_at AS arrived, para_id AS key_id, -1 AS pos,
              CASE WHEN n_refs IS NOT NULL THEN 'late' WHEN r.id_int IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
       FROM placed q LEFT JOIN removed r ON r.collection = q.collection AND r.id_int = q.id_int WHERE n_refs IS NULL OR there > q.ingested_at
       UNION ALL
       SELECT 'cite_span', ingested_at, para_id, pos, 'missing' FROM span
       WHERE n_refs IS NOT NULL AND ref_id <> '' AND NOT (regexp_full_match(ref_id, '[0-9]+') AND coalesce(try_cast(ref_id AS INT) < n_refs, false))
       UNION ALL
       SELECT 'reference', f.ingested_at, f.id_int, f.pos,
              CASE WHEN p.id_int IS NOT NULL THEN 'late' WHEN r.id_int IS NOT NULL THEN 'deleted' ELSE 'missing' END
       FROM ref f LEFT JOIN paper p ON p.collection = f.collection AND p.id_int = f.number
       LEFT JOIN removed r ON r.collection = f.collection AND r.id_int = f.number
       WHERE p.id_int IS NULL OR p.ingested_at > f.ingested_at)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_tables": p4_tables}
SQL = {
    "p4_found": _DIRECT + "SELECT link, strftime(arrived, '%Y-%m') AS arrival_month, key_id, CAST(pos AS INT) AS pos, reason FROM direct",
    "p4_report": _DIRECT
    + """, inherited AS (
       SELECT 'cite_span' AS link, min(s.ingested_at) AS arrived, s.para_id AS key_id, s.pos, min(d.reason) AS reason
       FROM span s JOIN direct d ON d.link = 'paragraph' AND d.key_id = s.para_id
            OR d.link = 'reference' AND s.n_refs IS NOT NULL AND regexp_full_match(s.ref_id, '[0-9]+') AND try_cast(s.ref_id AS INT) < s.n_refs AND d.key_id = s.id_int AND d.pos = try_cast(s.ref_id AS INT)
       WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.link = 'cite_span' AND x.key_id = s.para_id AND x.pos = s.pos)
       GROUP BY s.para_id, s.pos)
SELECT link, strftime(arrived, '%Y-%m') AS arrival_month, reason, origin, count(*) AS orphans
FROM (SELECT link, arrived, reason, 'direct' AS origin FROM direct UNION ALL SELECT link, arrived, reason, 'inherited' FROM inherited)
GROUP BY ALL""",
    "p4_tables": """WITH gone AS (SELECT DISTINCT id_int FROM removal_log),
     pointer AS (SELECT 'document' AS link, doc_id AS key_id, ingested_at AS arrived, id_int FROM documents WHERE id_int IS NOT NULL
                 UNION ALL SELECT 'author_name', name_id, first_seen_at, first_id_int FROM author_name WHERE first_id_int IS NOT NULL),
     direct AS (SELECT link, key_id, min(q.arrived) AS arrived, min(CASE WHEN p.id_int IS NOT NULL THEN 'late' WHEN g.id_int IS NOT NULL THEN 'deleted' ELSE 'missing' END) AS reason
                FROM pointer q LEFT JOIN paper p ON p.id_int = q.id_int LEFT JOIN gone g ON g.id_int = q.id_int WHERE p.id_int IS NULL OR p.ingested_at > q.arrived GROUP BY link, key_id),
     hung AS (SELECT DISTINCT 'subject_label' AS link, doc_id AS key_id FROM subject_label UNION ALL SELECT DISTINCT 'embeddings', vec_id FROM embeddings)
SELECT link, strftime(arrived, '%Y-%m') AS arrival_month, reason, origin, CAST(depth AS INT) AS depth, count(*) AS orphans
FROM (SELECT link, arrived, reason, 'direct' AS origin, 0 AS depth FROM direct
      UNION ALL SELECT h.link, NULL, d.reason, 'inherited', 1 FROM hung h JOIN direct d ON d.link = 'document' AND d.key_id = h.key_id)
GROUP BY ALL""",
}
