"""Operations on one paper's sentences: marking, highlights and placeholders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import citations
from quillspark.functions import text as T
from quillspark.operators import sections, summary


def sentences(df: DataFrame, key: str, parsed: str) -> DataFrame:
    """(key, section_id, paragraph_id, sentence_id, sentence_text) of a parsed array of sections, numbered from 0."""
    section = df.select(key, F.posexplode(parsed).alias("section_id", "s"))
    paragraph = section.select(key, "section_id", F.posexplode("s.section_text").alias("paragraph_id", "p"))
    return paragraph.select(key, "section_id", "paragraph_id", F.posexplode("p.paragraph_text").alias("sentence_id", "x")).select(key, "section_id", "paragraph_id", "sentence_id", F.col("x.sentence_text").alias("sentence_text"))


def mark(found: DataFrame, wanted: DataFrame, key: str, order: list[str], least: float = 95.0) -> DataFrame:
    """Sentences of ``found`` that are, or nearly are, sentences of ``wanted`` (key, ref, ref_text); for a ref the last such sentence counts.

    Only sentences of the same document whose lengths allow the ratio meet.
    """
    a = found.withColumn("_n", F.length("sentence_text"))
    b = wanted.withColumn("_m", F.length("ref_text"))
    bound = least / 100.0
    # 2 min / (n + m) bounds the ratio
    near = (F.least("_n", "_m") * 2.0) >= (F.col("_n") + F.col("_m")) * bound
    pairs = a.join(b, key).filter(near).filter(T.alike(F.col("sentence_text"), F.col("ref_text"), least - 1e-9))
    by = Window.partitionBy(key, "ref").orderBy(*[F.desc(c) for c in order])
    return pairs.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r", "_n", "_m", "ref_text")


def bracket_style(text: Column, least: int = 5) -> Column:
    """Whether citations in a text are mostly written as numbers in brackets."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\[\d+(?:\s*[,;–-]\s*\d+)*\])"), F.lit(1))) > least


def marker_number(marker: Column) -> Column:
    """The number in a citation marker such as [12], else null."""
    return F.regexp_extract(marker, r"^\s*[\[(]?(\d+)[\])]?\s*$", 1).try_cast("int")


def fill_placeholders(text: Column, tokens: Column) -> Column:
    """Text with tokens (struct token, surface) replaced in order, and the spans of the surfaces in the new text."""
    start = F.struct(text.alias("text"), F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        place = F.position(t.token, acc.text)
        begin = place - 1
        new = F.concat(F.substring(acc.text, F.lit(1), begin), t.surface, F.substring(acc.text, place + F.length(t.token), F.length(acc.text)))
        span = F.struct(begin.cast("int").alias("start"), (begin + F.length(t.surface)).cast("int").alias("end"), t.surface.alias("text"))
        shift = F.length(t.surface) - F.length(t.token)
        moved = F.transform(acc.spans, lambda s: F.when(s.start > begin, F.struct((s.start + shift).cast("int").alias("start"), (s.end + shift).cast("int").alias("end"), s.text.alias("text"))).otherwise(s))
        return F.struct(F.when(place > 0, new).otherwise(acc.text).alias("text"), F.lit(0).alias("at"), F.when(place > 0, F.concat(moved, F.array(span))).otherwise(acc.spans).alias("spans"))

    return F.aggregate(tokens, start, step, lambda acc: F.struct(acc.text.alias("text"), F.array_sort(acc.spans).alias("spans")))


def highlights(df: DataFrame, key: str, parsed: str, most: int = 7, scorer: summary.SentenceScorer | None = None) -> DataFrame:
    """(key, section_id, paragraph_id, sentence_id, sentence_text) of the sentences that sum a paper's body up, in the order of the text; a paper without a body has none."""
    placed = sentences(df, key, parsed)
    whole = placed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_id", "paragraph_id", "sentence_id", F.coalesce("sentence_text", F.lit("")).alias("sentence_text")))).alias("all"))
    chosen = summary.summarise(whole.withColumn("texts", F.transform("all", lambda s: s.sentence_text)), key, "texts", most, scorer)
    return whole.join(chosen, key).select(key, F.explode("sentence_position").alias("at"), "all").select(key, F.get("all", "at").alias("s")).select(key, "s.*")


def marked_paper(df: DataFrame, key: str, parsed: str, wanted: DataFrame, least: float = 95.0) -> tuple[DataFrame, DataFrame]:
    """(sentences, matches): all sentences of papers as runs of plain text and citation markers, those marked by a wanted sentence with its ref, and which ref stands where.

    ``wanted`` has key, ref and ref_text; for a ref the last sentence that is alike counts, and of
    refs at one sentence the greatest.
    """
    section = df.select(key, F.posexplode(parsed).alias("section_id", "s"))
    para = section.select(key, "section_id", F.posexplode("s.section_text").alias("paragraph_id", "p"))
    found = para.select(key, "section_id", "paragraph_id", F.posexplode("p.paragraph_text").alias("sentence_id", "x")).select(key, "section_id", "paragraph_id", "sentence_id", F.col("x.sentence_text").alias("sentence_text"), F.col("x.cite_spans").alias("cite_spans"))
    place = ["section_id", "paragraph_id", "sentence_id"]
    matches = mark(found.drop("cite_spans"), wanted, key, place, least).select(key, "ref", *place)
    marked = found.join(matches.groupBy(key, *place).agg(F.max("ref").alias("ref")), [key, *place], "left")
    runs = sections.fill_gaps(F.coalesce("sentence_text", F.lit("")), sections.typed_spans(F.col("cite_spans")))
    return marked.select(key, *place, "sentence_text", "ref", runs.alias("runs")), matches


def result_card(df: DataFrame, key: str, parsed: str, most: int = 3) -> DataFrame:
    """(key, citation, title, summary): what is shown of a search result: who wrote it, its title and the sentences that sum it up.

    ``df`` has key, title, author and the parsed body.
    """
    picked = highlights(df, key, parsed, most)
    text = picked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_id", "paragraph_id", "sentence_id", "sentence_text"))), lambda s: s.sentence_text), " ").alias("summary"))
    return df.select(key, citations.card(F.col("author")).alias("citation"), "title").join(text, key, "left").select(key, "citation", "title", F.coalesce("summary", F.lit("")).alias("summary"))
