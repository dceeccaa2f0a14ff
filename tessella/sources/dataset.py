"""Question sets for evaluation."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "struct<question:string,expected_answer:string,expected_keywords:array<string>,topic:string>"
LECTURE = f"id string, file string, source string, content string, questions array<{QUESTION}>"


def parse(text: str) -> list[dict]:
    """The lectures of a YAML or JSON document {lectures: [...]}; YAML needs PyYAML."""
    try:
        data = json.loads(text)
    except ValueError:
        import yaml

        data = yaml.safe_load(text)
    return data["lectures"]


def load(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Rows as LECTURE: each lecture with the text of its file in ``folder``. Missing keywords are []."""
    source = spark.read.text(path, wholetext=True).first()[0]  # one small file
    rows = []
    for x in parse(source):
        questions = [(q["question"], q["expected_answer"], list(q.get("expected_keywords") or []), q.get("topic")) for q in x.get("questions") or []]
        rows.append((str(x["id"]), x["file"], x.get("source"), questions))
    lectures = spark.createDataFrame(rows, f"id string, file string, source string, questions array<{QUESTION}>")
    names = [r[1] for r in rows]
    texts = spark.read.text([f"{folder}/{n}" for n in names], wholetext=True) if names else spark.createDataFrame([], "value string")
    texts = texts.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content")) if names else spark.createDataFrame([], "file string, content string")
    return lectures.join(texts, "file", "left").select("id", "file", "source", "content", "questions")


def lecture(lectures: DataFrame, id: object) -> DataFrame:
    return lectures.where(F.col("id") == F.lit(str(id)))


def questions(lectures: DataFrame) -> DataFrame:
    """(lecture_id, question, expected_answer, expected_keywords, topic)."""
    return lectures.select(F.col("id").alias("lecture_id"), F.explode("questions").alias("q")).select("lecture_id", "q.*")


def total_questions(lectures: DataFrame) -> DataFrame:
    return lectures.agg(F.coalesce(F.sum(F.size("questions")), F.lit(0)).alias("total"))
