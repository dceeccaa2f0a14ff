"""Quality rules with risk-controlled thresholds.

Each rule compares one ratio with a cutoff. Its cutoffs run from lenient to strict. For
every stratum, documents labelled good are the holdout: a cutoff is certified if the
exact binomial tail shows that it rejects at most ``risk / rules`` of the good documents.
Cutoffs of a rule are tested in order up to the first that fails (a fixed sequence,
which needs no correction), and the level is divided by strata times rules (Bonferroni).
So with probability ``1 - delta`` no stratum loses more than ``risk`` of its good
documents to all rules together. Documents labelled bad only decide whether a cutoff is
of any use, which leaves the bounds as they are. A stratum with too few labels gets no
cutoff.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, NOT_BLANK, let, words, written

RISK, DELTA = 0.02, 0.05
#: Rule, numerator, denominator, cutoffs from lenient to strict; a ratio above the cutoff is rejected, one of nothing never.
RULES = [
    ("symbols", "n_symbols", "word_chars", [0.5, 0.3, 0.2, 0.1, 0.05, 0.02]),
    ("dup_lines", "n_dup_lines", "n_lines", [0.95, 0.9, 0.8, 0.7, 0.6, 0.5]),
    ("word_length", "word_chars", "n_words", [20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0]),
    ("repeats", "n_repeat_words", "n_words", [0.19, 0.17, 0.15]),
]
#: More strata than these are joined by a shuffle and not by a broadcast.
BROADCAST_STRATA = 10_000


def _repeat_words(w: Column, k: int = 5) -> Column:
    """Words in k-word windows that the array holds twice or more, the first time included."""

    def covered(g: Column) -> Column:
        return let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("p")))), lambda s: let(
            F.sort_array(F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["p"])),
            lambda ps: F.aggregate(F.transform(ps, lambda p, j: F.least(F.lit(k), F.coalesce(F.get(ps, j + 1) - p, F.lit(k)))), F.lit(0).cast("bigint"), lambda a, x: a + x)))

    grams = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + t) for t in range(k)])))
    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(covered(g)))
    return F.when(F.size(w) >= k, counted).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """Per row: doc_id, text_hash, stratum ('' for null), n_words, word_chars, n_symbols, n_lines, n_dup_lines,
    n_repeat_words, base_failed. Null texts have no words and fail."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_BLANK))
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"), text.alias("text"), words(text).alias("w"), lines.alias("l"))
    base = base.select(
        "doc_id", "text_hash", "stratum", F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"))
    return base.withColumn("base_failed", (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20))


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), for k <= n * p; 1 beyond."""
    start = n * math.log1p(-p)
    odds = math.log(p) - math.log1p(-p)

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(t.alias("t"), (F.greatest(a["s"], t) + F.log1p(F.exp(-F.abs(a["s"] - t)))).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1).cast("bigint"), k), F.struct(start.alias("t"), start.alias("s")), step, lambda a: F.exp(a["s"]))
    return F.when(k > n * p, F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(total)


def certify(measured: DataFrame, labels: DataFrame, *, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The strictest certified and useful cutoff of each rule: a row (stratum, cut_<rule>...) per stratum with labels.

    A document counts as good if every label of its id has quality 1, else as bad; null
    qualities count for nothing. Equal texts of a stratum are one draw, not several, and good
    if all of them are.
    """
    own = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    seen = measured.join(own, "doc_id").groupBy("stratum", "text_hash").agg(F.min("good").alias("good"), *(F.any_value(c).alias(c) for c in sorted({c for _, a, b, _ in RULES for c in (a, b)})))
    cuts = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(j).alias("level"), F.lit(float(c)).alias("cutoff"), F.coalesce(F.try_divide(a, b) > c, F.lit(False)).alias("out"))
                     for r, a, b, cs in RULES for j, c in enumerate(cs)])
    counts = seen.select("stratum", "good", F.explode(cuts).alias("c")).groupBy("stratum", "c.rule", "c.level", "c.cutoff").agg(
        F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("c.out")).alias("k"), F.count_if(~F.col("good") & F.col("c.out")).alias("bad"))
    counts = written(counts, "quality-counts")
    tests = len(RULES) * max(1, counts.where("n > 0").select("stratum").distinct().count())
    passed = counts.withColumn("ok", (F.col("n") > 0) & (_tail(F.col("n"), F.col("k"), risk / len(RULES)) <= delta / tests))
    first = passed.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(~F.col("ok"), F.col("level"))), F.lit(10**6)).alias("stop"),
        F.sort_array(F.collect_list(F.struct("level", "cutoff", "bad"))).alias("cuts"))
    best = F.element_at(F.filter("cuts", lambda x: (x["level"] < F.col("stop")) & (x["bad"] > 0)), -1)["cutoff"]
    best = F.when(F.size(F.filter("cuts", lambda x: (x["level"] < F.col("stop")) & (x["bad"] > 0))) > 0, best)
    return first.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, best)).alias(f"cut_{r}") for r, *_ in RULES])


def judge(docs: DataFrame, labels: DataFrame, *, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The columns of measure() and kept: false if base_failed or if a certified cutoff rejects."""
    measured = written(measure(docs, stratum), "quality")
    cuts = written(certify(measured, labels, risk=risk, delta=delta), "quality-cuts")
    few = cuts.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    out = measured.join(F.broadcast(cuts) if few else cuts, "stratum", "left")
    rejected = F.lit(False)
    for r, a, b, _ in RULES:
        rejected = rejected | F.coalesce(F.try_divide(a, b) > F.col(f"cut_{r}"), F.lit(False))
    return out.select(*measured.columns, (~F.col("base_failed") & ~rejected).alias("kept"))
