"""Benchmark decontamination by winnowing.

Both sides keep the k-gram hashes that are the least of some sliding window of
``window - k + 1`` k-grams. Any shared span of ``window`` words holds a k-gram that
both sides keep, so an equi-join of the kept hashes finds each of them. Benchmark
fingerprints with equal surroundings are one, and get their items back at the end. Every hit is
then extended word by word, as far as one window reaches, and counts only if a whole
window agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, words, written

#: Everything below 0x80 that is neither a digit nor a letter, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, K = 10, 5
#: A larger set of item fingerprints is joined by a shuffle and not by a broadcast.
BROADCAST_ROWS = 200_000


def _hashed(text: Column) -> Column:
    return F.transform(words(ascii_lower(text), SEPARATORS), lambda w: F.xxhash64(w))


def _grams(hashes: Column, k: int) -> Column:
    return F.when(
        F.size(hashes) >= k,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + t) for t in range(k)])),
    ).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, span: int) -> Column:
    """(p, h) of each k-gram that is the least of a window of ``span``; equal ones are all kept."""
    least = F.transform(F.sequence(F.lit(0), F.size(grams) - span), lambda i: F.least(*[F.get(grams, i + t) for t in range(span)]))
    picked = let(least, lambda m: F.filter(
        F.transform(F.sequence(F.lit(0), F.size(grams) - 1), lambda p: F.when(
            F.greatest(*[F.get(m, p - t) for t in range(span)]) == F.get(grams, p),
            F.struct(F.lit(0).alias("m"), p.alias("p"), F.get(grams, p).alias("h")))),
        lambda x: x.isNotNull()))
    return F.when(F.size(grams) >= span, picked).otherwise(F.array().cast("array<struct<m:int,p:int,h:bigint>>"))


def _numbered(grams: Column, m: int) -> Column:
    return F.transform(grams, lambda h, i: F.struct(F.lit(m).alias("m"), i.alias("p"), h.alias("h")))


def _fingerprints(hashes: Column, window: int, k: int, short: list[int]) -> Column:
    """Winnowed k-grams (m = 0), and all m-grams for each length m of items below the window."""
    kept = let(_grams(hashes, k), lambda g: _winnowed(g, window - k + 1))
    for m in short:
        kept = F.concat(kept, _numbered(_grams(hashes, m), m))
    return kept


def _run(a: Column, b: Column, most: int) -> Column:
    """How many leading elements agree."""
    return let(F.array_position(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda t: F.coalesce(F.get(a, t) == F.get(b, t), F.lit(False))), False),
               lambda at: F.when(at == 0, F.lit(most)).otherwise(at.cast("int") - 1))


def _context(h: Column, p: Column, k: int, reach: int) -> tuple[Column, Column]:
    """The ``reach`` hashes before p, nearest first, and after the k-gram at p."""
    left = F.reverse(F.slice(h, F.greatest(p - reach, F.lit(0)) + 1, p - F.greatest(p - reach, F.lit(0))))
    return left, F.slice(h, p + k + 1, F.lit(reach))


def find_windows(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Spans of documents that items also hold: (doc_id, text_hash, s, e, w), words s to e - 1, with repeats; and (w, item_id), the items of each context w.

    A document is known by its id and the xxhash64 of its text, so that rows that share an id, or have none, stay apart.

    An item of fewer words than ``window`` is one window by itself. Null texts have no words.
    """
    reach = window - k
    item = items.select("item_id", _hashed(F.col("text")).alias("ih")).where(F.size("ih") > 0)
    short = sorted(r[0] for r in item.where(F.size("ih") < window).select(F.size("ih")).distinct().collect())  # below window values
    own = F.when(F.size("ih") >= window, _fingerprints(F.col("ih"), window, k, [])).otherwise(
        F.array(F.struct(F.size("ih").alias("m"), F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("h"))))
    each = item.select("item_id", "ih", F.explode(own).alias("f"))
    whole = F.lit(None).cast("bigint")
    for m in short:
        whole = F.when(F.col("f.m") == m, F.xxhash64(*[F.get("ih", F.lit(t)) for t in range(m)])).otherwise(whole)
    il, ir = _context(F.col("ih"), F.col("f.p"), k, reach)
    # Items that agree around a fingerprint, as far as a window reaches, are one candidate: a document meets each context once.
    each = each.select("item_id", F.col("f.m").alias("m"), F.when(F.col("f.m") > 0, whole).otherwise(F.col("f.h")).alias("h"), F.when(F.col("f.m") == 0, il).alias("il"), F.when(F.col("f.m") == 0, ir).alias("ir"))
    each = written(each.withColumn("w", F.xxhash64("m", "h", "il", "ir")), "item-windows")
    item = each.groupBy("w").agg(*(F.any_value(c).alias(c) for c in ("m", "h", "il", "ir")))
    few = item.limit(broadcast_rows + 1).count() <= broadcast_rows
    doc = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), _hashed(F.col("text")).alias("dh"))
    doc = doc.select("doc_id", "text_hash", "dh", F.explode(_fingerprints(F.col("dh"), window, k, short)).alias("f"))
    dl, dr = _context(F.col("dh"), F.col("p"), k, reach)
    doc = doc.select("doc_id", "text_hash", "dh", F.col("f.m").alias("m"), F.col("f.p").alias("p"), F.col("f.h").alias("h"))
    if few:  # the word hashes ride along in the same codegen stage and are copied for hits only
        hit = doc.join(F.broadcast(item), ["m", "h"]).withColumns({"dl": dl, "dr": dr})
    else:
        hit = doc.withColumns({"dl": dl, "dr": dr}).drop("dh").join(item, ["m", "h"])
    hit = hit.select("doc_id", "text_hash", "w", "m", "p", _run(F.col("dl"), F.col("il"), reach).alias("l"), _run(F.col("dr"), F.col("ir"), reach).alias("r"))
    hit = hit.where((F.col("m") > 0) | (F.col("l") + F.col("r") + k >= window)).select(
        "doc_id", "text_hash", F.when(F.col("m") > 0, F.col("p")).otherwise(F.col("p") - F.col("l")).alias("s"),
        F.when(F.col("m") > 0, F.col("p") + F.col("m")).otherwise(F.col("p") + k + F.col("r")).alias("e"), "w")
    return hit, each.select("w", "item_id").distinct()


def find_hits(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Spans of documents that items also hold: (doc_id, s, e, item_id), words s to e - 1, with repeats. See find_windows()."""
    hit, owners = find_windows(docs, items, **how)
    return hit.join(owners, "w").select("doc_id", "s", "e", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, item_ids (ids as strings, sorted), contaminated.

    Each row has the hits of its own text, whether its id is repeated or null. Items without an id count as hits but have no entry in item_ids.
    """
    hit, owners = find_windows(docs, items, **how)
    met = hit.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("w").alias("ws"))
    met = written(met, "contaminated")
    ids = met.select("doc_id", "text_hash", F.explode("ws").alias("w")).join(owners, "w").groupBy(F.col("doc_id").alias("_of"), F.col("text_hash").alias("_hash")).agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    spans = met.join(ids, F.col("doc_id").eqNullSafe(F.col("_of")) & (F.col("text_hash") == F.col("_hash")), "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    found = spans.select(
        F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash"), F.lit(True).alias("hit"), F.array_sort("ids").alias("ids"),
        F.size(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(x["s"], x["e"] - 1))))).cast("bigint").alias("n"))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(ascii_lower(F.col("text")), SEPARATORS)).cast("bigint").alias("n_words"))
    return own.join(found, own["doc_id"].eqNullSafe(found["hit_id"]) & (own["text_hash"] == found["hit_hash"]), "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("ids", F.array().cast("array<string>")).alias("item_ids"), F.coalesce("hit", F.lit(False)).alias("contaminated"))
