"""Tables of a folder, and the views of them that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content), a row a whole file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """(id, content, embedding): the document n takes the vector n, null where there is none."""
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")).join(vectors, "id", "left")


def whole_chunks(docs: DataFrame) -> DataFrame:
    """One chunk a document over its whole content; every third has its first ten characters as context."""
    return docs.where("content is not null and content <> ''").select(
        F.col("id") , F.col("id").alias("document_id"), F.lit(0).alias("start_char"), F.length("content").alias("end_char"), "embedding",
        F.when(F.col("id") % 3 == 0, F.substring("content", 1, 10)).alias("context"))


def json_lines(df: DataFrame) -> DataFrame:
    """(value): each row as a JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written by the driver, on any file system that Spark knows."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
