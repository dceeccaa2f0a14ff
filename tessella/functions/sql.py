"""The functions by name in SQL text: temporary SQL functions, and the chunker as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

FUNCTIONS = {
    "normalize_text(t STRING) RETURNS STRING": r"trim(regexp_replace(lower(t), '\\s+', ' '))",
    "text_fingerprint(t STRING) RETURNS STRING": r"sha2(trim(regexp_replace(lower(coalesce(t, '')), '\\s+', ' ')), 256)",
    "vector_dot(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "inverse_euclidean(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "CASE WHEN size(a) > 0 AND size(a) = size(b) THEN 1 / (1 + sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))) ELSE 0D END",
    "cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "CASE WHEN size(a) > 0 AND size(a) = size(b) AND vector_dot(a, a) > 0 AND vector_dot(b, b) > 0 "
        "THEN least(1D, greatest(-1D, vector_dot(a, b) / (sqrt(vector_dot(a, a)) * sqrt(vector_dot(b, b))))) ELSE 0D END",
}


class ChunkText:
    """chunk_text(content, size, overlap): a row a chunk, sentences by the rules with abbreviations."""

    def eval(self, content: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
        from tessella.operators.segment import split_sentences

        group: list[tuple[str, int, int]] = []
        for one in split_sentences(content):
            if group and sum(len(x[0]) + 1 for x in group) + len(one[0]) > size:
                yield group[0][1], group[-1][2], " ".join(x[0] for x in group)
                group = group[-overlap:] if overlap else []
            group.append(one)
        if group:
            yield group[0][1], group[-1][2], " ".join(x[0] for x in group)


def register(spark: SparkSession) -> None:
    """Makes the functions known to ``spark.sql`` for the session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="start_char int, end_char int, content string"))
