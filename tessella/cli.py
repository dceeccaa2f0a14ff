"""python -m tessella.cli run|lecture ID|list DATASET FOLDER [ANSWERS]: evaluate answers to a question set.

ANSWERS is a Parquet folder (lecture_id, question, rag_answer, sources array<string>).
Without it the lectures are ingested into the store at $STORE and each question is answered
from it, with $SEARCH_TYPE (hybrid) and $RERANK (false), by the services at $EMBED_URL
(model $EMBED_MODEL) and $GENERATE_URL (model $GENERATE_MODEL, key $GENERATE_KEY), or by
offline stand-ins where these are unset. ``run`` writes its report to a folder below
$REPORTS (reports) and ends with status 1 if fewer than half of the questions pass.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import functions as F

from tessella.operators.evaluate import evaluate, gate, report, run, write_report
from tessella.session import session
from tessella.sources import dataset, providers
from tessella.sources.store import Store


def services(env: dict[str, str]) -> tuple[providers.Embedder, providers.Generator]:
    embedder = providers.HttpEmbedder(env["EMBED_URL"], env.get("EMBED_MODEL", "")) if env.get("EMBED_URL") else providers.HashEmbedder(256)
    generator = providers.HttpGenerator(env["GENERATE_URL"], env.get("GENERATE_MODEL", ""), env.get("GENERATE_KEY", "")) if env.get("GENERATE_URL") else providers.EchoGenerator(providers.first_passage)
    return embedder, generator


def main(args: list[str], env: dict[str, str] | None = None) -> int:
    env = dict(os.environ) if env is None else env
    spark = session("tessella-evaluate")
    kind = args[0]
    wanted = args[1] if kind == "lecture" else None
    path, folder, *rest = args[2 if wanted else 1 :]
    lectures = dataset.load(spark, path, folder)
    if kind == "list":
        for r in lectures.select("id", "source", F.size("questions").alias("n")).orderBy("id").toLocalIterator():
            print(f"{r['id']}\t{r['source']}\t{r['n']} questions")
        return 0
    lectures = dataset.lecture(lectures, wanted) if wanted else lectures
    if lectures.isEmpty():
        print(f"no such lecture: {wanted}")
        return 1
    if rest:
        results = evaluate(dataset.questions(lectures), spark.read.parquet(rest[0]))
    else:
        results = run(Store(spark, env.get("STORE", "store")), lectures, *services(env), env.get("SEARCH_TYPE", "hybrid"), env.get("RERANK", "false") == "true")
    print(report(results))
    if not wanted:
        at = f"{env.get('REPORTS', 'reports')}/evaluation-{time.strftime('%Y%m%d-%H%M%S')}"
        write_report(results, at)
        print(f"report: {at}")
    return 0 if wanted or gate(results) else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
