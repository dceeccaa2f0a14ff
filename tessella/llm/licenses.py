"""License scans: a text is a known licence if its canonical digest is.

The canonical form lower-cases, drops copyright lines, joins hyphenated words, turns
other punctuation and white space into one space, and puts equivalent spellings into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, words, written
from .license_texts import KNOWN, SPELLINGS

COPYRIGHT_LINE = r"^[ \t/*#;]*(?:copyright[ \t]*(?:\(c\)|©|[0-9<\[{])|copyright[^\n]*(?:19|20)[0-9]{2}|\(c\)|©|all rights reserved)[^\n]*"
JOINED = "['’‘`´\"“”‐‑–—-]"
OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: More known texts than these are joined by a shuffle; more one-line texts meet the lines by a join and not in the row.
MOST_KNOWN, MOST_LINES = 10_000, 500


def canonical(text: Column) -> Column:
    """'' for null, and where no letter, digit or other character beyond ASCII is left."""
    marked = lambda x: x.contains("copyright") | x.contains("(c)") | x.contains("©") | x.contains("all rights reserved")
    same = F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair])
    variants = F.array(*map(F.lit, SPELLINGS))
    bare = let(F.lower(text), lambda x: F.when(marked(x), F.regexp_replace(x, "(?md)" + COPYRIGHT_LINE, "")).otherwise(x))
    spelt = lambda w: F.when(F.arrays_overlap(w, variants), F.transform(w, lambda x: F.coalesce(same[x], x))).otherwise(w)
    return F.array_join(let(words(F.regexp_replace(bare, JOINED, ""), OTHER), spelt), " ")


def digest(text: Column) -> Column:
    """Hex SHA-256 of the canonical form, null where that is empty."""
    return let(canonical(text), lambda c: F.when(c != "", F.sha2(c, 256)))


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """(digest, license, single), one row a digest; of licences with equal texts the least name. single: a text of one line."""
    rows = known.select("license", "known_text") if isinstance(known, DataFrame) else spark.createDataFrame(list(known), "license string, known_text string")
    single = ~F.btrim("known_text", F.lit(" \t\r\n\x0b\x0c")).contains("\n")
    return rows.select(digest(F.col("known_text")).alias("digest"), "license", single.alias("single")).where("digest is not null").groupBy("digest").agg(F.min("license").alias("license"), F.max("single").alias("single"))


def scan(docs: DataFrame, known: Sequence[tuple[str, str]] | DataFrame = KNOWN, *, most_known: int = MOST_KNOWN, most_lines: int = MOST_LINES) -> DataFrame:
    """Per row: doc_id, digest, license (of the entire text, else null), line_licenses (of entire lines, sorted).

    ``known``: pairs, or rows (license, known_text) of any number. Null, empty and purely
    punctuated texts have no digest and no licence. Repeated rows get equal answers.
    """
    table = written(known_digests(docs.sparkSession, known), "known-licenses")
    few = table.limit(most_known + 1).count() <= most_known
    whole = table.select("digest", "license")
    single = table.where("single").select("digest", "license")
    names = {r["digest"]: r["license"] for r in single.limit(most_lines + 1).collect()}
    none, lines = F.array().cast("array<string>"), F.split("text", "\n")
    if len(names) <= most_lines:
        found = none
        if names:
            lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
            found = F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: lookup[digest(x)]), lambda x: x.isNotNull()))), none)
        out = docs.select("doc_id", digest(F.col("text")).alias("digest"), found.alias("line_licenses"))
    else:
        rid = F.xxhash64("doc_id", "text").alias("rid")
        each = docs.select(rid, F.explode(lines).alias("line")).select("rid", digest(F.col("line")).alias("digest")).where("digest is not null")
        met = each.join(F.broadcast(single) if few else single, "digest").groupBy("rid").agg(F.array_sort(F.collect_set("license")).alias("line_licenses"))
        own = docs.select("doc_id", digest(F.col("text")).alias("digest"), rid)
        out = own.join(met, "rid", "left").select("doc_id", "digest", F.coalesce("line_licenses", none).alias("line_licenses"))
    return out.join(F.broadcast(whole) if few else whole, "digest", "left").select("doc_id", "digest", "license", "line_licenses")
