"""The library's functions under names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillspark.functions import stem, text

SCALAR = {"indel_ratio": text.ratio, "find_near": text.find_near, "find_passage": text.find_passage, "stems": stem.stems}


@udtf(returnType="pos int, sentence string")
class SplitSentences:
    """Pieces of a text between full stops, with their places."""

    def eval(self, whole: str) -> Iterator[tuple[int, str]]:
        squashed = " ".join((whole or "").split())
        pieces = squashed.split(". ")
        for i, piece in enumerate(p + ("." if k < len(pieces) - 1 else "") for k, p in enumerate(pieces)):
            if piece.strip():
                yield i, piece


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; returns their names."""
    for name, function in SCALAR.items():
        spark.udf.register(name, function)
    spark.udtf.register("split_sentences", SplitSentences)
    return [*SCALAR, "split_sentences"]
