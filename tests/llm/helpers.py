"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import functions as F

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text[, lang])."""
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], DOCUMENT)


def with_clashes(df, *names):
    """Extra columns named like an operator's own."""
    return df.withColumns({n: F.lit("x") for n in names})


def odd_rows():
    long = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "a"), (5, "a"), (None, "a null id has a text of its own here"), (7, "é 😀 ß\r\nÀ"), (8, "!!!")]
