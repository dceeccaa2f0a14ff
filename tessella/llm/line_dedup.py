"""Repeated lines, exact or within a few edits, by a segment-partition join.

With a threshold of k edits, the shorter line of a near pair is cut into k + 1 segments.
Edits can touch k of them at most, so one stands in the longer line too, at a place that
is shifted by no more than the edits before or after it allow. A line therefore indexes its segments, and
probes for those of lines that are 0 to k characters shorter by its substrings at these
places; the key holds the shorter line's length, the segment's number and its characters.

Lines that share a key but differ elsewhere can be many (versions of one passage). With
one edit such a group isn't paired: its lines also differ by at most one edit in the rest,
so the rest is cut again, and again, until groups are small or one character is left. No
pair is lost, and a group of m costs m rows a step. What is left, and large groups with
more edits, is paired in blocks: an index line with each other line, never probe with probe.
Pairs are verified by a banded bit-parallel edit distance. Counts of characters by class,
kept with each line, turn most of them away before: an edit changes two counts by one at most.

Lines below ``min_chars`` are compared as they are, without edits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, unused, written

#: Edits are allowed in lines from this length on. Larger groups are cut further.
MIN_CHARS, EDITS, GROUP = 30, 1, 16
#: Large groups are paired in blocks of about this size.
BLOCK = 64
BLANK = " \t\r\x0b\x0c"
#: Classes of characters that a line's profile counts, and the widest count in it.
CLASSES, WIDTH = ("ae", "io", "nr", "st", "dl", "cmu", "0123456789"), 8


def _lines(docs: DataFrame) -> DataFrame:
    """rid, doc_id, pos, line, i, j of lines that aren't blank: i and j are two hashes, together the line's identity."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("rid"), F.posexplode(F.split(text, "\n")).alias("pos", "raw"))
    rows = rows.select("rid", "doc_id", "pos", F.btrim("raw", F.lit(BLANK)).alias("line")).withColumn("len", F.length("line")).where("len > 0")
    return rows.withColumns({"i": F.xxhash64("line"), "j": F.xxhash64(F.lit(7), F.col("line"))})


def roles(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): the substrings of a line that it is indexed (0, segment, 0) and probes by."""
    out = [(0, i, 0) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less or shift:
                    out.append((less, i, shift))
    return out


def _keys(line: Column, size: Column, edits: int) -> Column:
    """A hash for each role."""
    out = []
    for less, i, shift in roles(edits):
        n = size - less
        start, end = F.floor(n * i / (edits + 1)).cast("int"), F.floor(n * (i + 1) / (edits + 1)).cast("int")
        out.append(F.xxhash64(F.lit(i), n, F.substring(line, start + shift + 1, end - start)))
    return F.array(*out)


def _cut(line: Column, size: Column, group: Column, n: Column, a: Column, b: Column) -> list[Column]:
    """With one edit: the two groups that a line of ``size`` joins in a pair whose shorter line has n characters.

    The group so far agrees outside characters a to b of the shorter line.
    """
    h = F.floor((b - a) / 2).cast("int")
    first = F.substring(line, a + 1, h)
    last = F.substring(line, size - (n - b) - (b - a - h) + 1, b - a - h)
    return [
        F.struct(F.xxhash64(group, F.lit(1), n, a, b, first).alias("g"), (a + h).alias("a"), b.alias("b")),
        F.struct(F.xxhash64(group, F.lit(2), n, a, b, last).alias("g"), a.alias("a"), (a + h).alias("b")),
    ]


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether two lines are within so many edits, by banded bit-parallel steps.

    Bit d of state e says that all characters of y so far, and as many of x plus d - edits,
    agree up to e edits. A step meets a character of y with the 2 * edits + 1 of x around it.
    """
    band, every = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    chars = lambda c: F.split(c, "")
    names = [f"r{e}" for e in range(edits + 1)]
    start = F.struct(*[F.lit(((1 << (e + 1)) - 1) << edits).alias(r) for e, r in enumerate(names)])

    def run(a: Column, b: Column) -> Column:
        def step(r: Column, p: Column) -> Column:
            c = F.get(b, p)
            same = reduce(lambda m, t: m.bitwiseOR(F.when(F.get(a, p + (t - edits)) == c, F.lit(1 << t)).otherwise(F.lit(0))), range(band), F.lit(0))

            def fields(m: Column) -> Column:
                now = [r["r0"].bitwiseAND(m)]
                for e in range(1, edits + 1):
                    less = r[f"r{e - 1}"]
                    inserted, deleted = F.shiftright(less, 1), F.shiftleft(now[-1], 1)
                    now.append(r[f"r{e}"].bitwiseAND(m).bitwiseOR(less).bitwiseOR(inserted).bitwiseOR(deleted).bitwiseAND(F.lit(every)))
                return F.struct(*[v.alias(k) for k, v in zip(names, now, strict=True)])

            return let(same, fields)

        end = F.call_function("shiftleft", F.lit(1), F.size(a) - F.size(b) + edits)
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, step, lambda r: r[names[-1]].bitwiseAND(end) != 0)

    near = F.abs(F.length(x) - F.length(y)) <= edits
    return near & let(F.struct(chars(x).alias("a"), chars(y).alias("b")), lambda z: run(z["a"], z["b"]))


def profile(line: Column) -> Column:
    """How often each class of characters occurs in a line, modulo 256: a byte each."""
    return reduce(lambda a, c: F.shiftleft(a, WIDTH).bitwiseOR(c), [(F.length(line) - F.length(F.translate(line, k, ""))).bitwiseAND((1 << WIDTH) - 1).cast("bigint") for k in CLASSES])


def _alike(p: Column, q: Column, edits: int) -> Column:
    """False only for profiles of lines that are further apart: an edit adds 2 at most to the sum of differences (circular ones)."""
    top = 1 << WIDTH
    byte = lambda c, k: F.shiftright(c, WIDTH * k).bitwiseAND(top - 1).cast("int")
    apart = lambda k: F.abs(byte(p, k) - byte(q, k))
    return reduce(lambda a, b: a + b, [F.least(apart(k), top - apart(k)) for k in range(len(CLASSES))]) <= 2 * edits


def _verified(pair: DataFrame, edits: int) -> DataFrame:
    """Links (i, j, i2, j2), the first the lesser, of the near ones of the pairs (x, y)."""
    pair = pair.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where("x.i <> y.i or x.j <> y.j")
    near = pair.where(_alike(F.col("x.p"), F.col("y.p"), edits)).where(within(F.col("x.line"), F.col("y.line"), edits))
    return near.select("x.i", "x.j", F.col("y.i").alias("i2"), F.col("y.j").alias("j2"))


def _pairs(groups: DataFrame, edits: int) -> DataFrame:
    """Links between an index line of each group and its other lines, for small groups."""
    many = groups.groupBy("g").agg(F.collect_list(F.struct("i", "j", "line", "p")).alias("m"), F.collect_list("short").alias("s")).where(F.size("m") > 1)
    every = F.flatten(F.transform("m", lambda x, k: F.transform(F.filter("m", lambda y, t: (t > k) & (F.get("s", k) | F.get("s", t))), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return _verified(many.select(F.explode(every).alias("p")).select("p.x", "p.y"), edits)


def _block_pairs(groups: DataFrame, edits: int) -> DataFrame:
    """The same for large groups (with c, their size): each block of index lines meets all lines."""
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    one = F.struct("i", "j", "line", "p")
    x = groups.where("short").select("g", F.pmod("i", blocks).cast("int").alias("block"), one.alias("x"))
    y = groups.select("g", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), one.alias("y"), "short")
    met = x.join(y, ["g", "block"]).where((~F.col("short")) | (F.col("x.i") < F.col("y.i")) | ((F.col("x.i") == F.col("y.i")) & (F.col("x.j") < F.col("y.j"))))
    return _verified(met.select("x", "y"), edits)


def near_lines(docs: DataFrame, *, edits: int = EDITS, min_chars: int = MIN_CHARS, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines (rid, doc_id, pos, i, j), the distinct ones (i, j, first, copies) and the links between these."""
    if edits < 1 or min_chars < 2 * (edits + 1):
        raise ValueError("at least one edit, and two characters a segment")
    keys = F.when(F.col("len") >= min_chars, _keys(F.col("line"), F.col("len"), edits)).otherwise(F.array().cast("array<bigint>"))
    lines = written(_lines(docs).select("rid", "doc_id", "pos", "i", "j", "len", keys.alias("keys")), "lines")
    distinct = written(lines.groupBy("i", "j").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("copies")), "distinct-lines")
    each = lines.select("i", "j", "len", F.posexplode("keys").alias("role", "g"))
    short = F.col("role") <= edits
    shared = each.groupBy("g").agg(F.min("i").alias("lo"), F.max("i").alias("hi"), F.max(short).alias("short")).where("lo <> hi and short").select("g")
    members = written(each.join(shared, "g").distinct(), "line-groups")
    wanted = members.select("i", "j").distinct().join(distinct, ["i", "j"]).groupBy(F.col("first.doc_id").alias("of")).agg(F.collect_set("first.pos").alias("at"))
    texts = docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["of"])).select("at", F.split("text", "\n").alias("all"))
    texts = texts.select(F.explode(F.transform("at", lambda p: F.btrim(F.get("all", p), F.lit(BLANK)))).alias("line")).where("line is not null")
    texts = texts.withColumns({"i": F.xxhash64("line"), "j": F.xxhash64(F.lit(7), F.col("line"))}).dropDuplicates(["i", "j"]).withColumn("p", profile(F.col("line")))
    state = members.join(texts, ["i", "j"]).select("g", "i", "j", "line", "p", "len", "role", short.alias("short"))
    if edits == 1:  # the rest of the shorter line, in which an edit is still possible: after the first segment, or before the last
        n = F.col("len") - F.when(short, 0).otherwise(1)
        h, first = F.floor(n / 2).cast("int"), F.col("role") % 2 == 0
        state = state.withColumns({"n": n, "a": F.when(first, h).otherwise(0), "b": F.when(first, n).otherwise(h)})
    state, links = state.drop("role"), []
    while True:
        state = written(state, "line-state")
        sizes = state.groupBy("g").agg(F.count("*").alias("c"), F.max("short").alias("any")).where("c > 1 and any").select("g", "c")
        counted = state.join(sizes, "g")
        large = F.col("c") > group
        further = large & (F.col("b") - F.col("a") > 1) if edits == 1 else F.lit(False)
        links.append(written(_pairs(counted.where(~large), edits), "line-links"))
        last = counted.where(large & ~further)
        if not last.isEmpty():
            links.append(written(_block_pairs(last, edits), "line-block-links"))
        if edits > 1 or counted.where(further).isEmpty():
            break
        state = counted.where(further).select("i", "j", "line", "p", "len", "short", "n", F.explode(F.array(*_cut(F.col("line"), F.col("len"), F.col("g"), F.col("n"), F.col("a"), F.col("b")))).alias("k")).select(
            F.col("k.g").alias("g"), "i", "j", "line", "p", "len", "short", "n", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
    return lines, distinct, reduce(DataFrame.unionByName, links).distinct()


def repeated_lines(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs with a line that isn't blank: rid, n_lines, n_links, removed.

    removed: the positions (from 0) of the lines that occur before, in the order of doc_id and
    position, as they are or within the edits. n_links: the other texts within the edits of
    its lines, counted a line. Lines are compared without blanks at their ends. Rows with
    equal doc_id and text are one.
    """
    lines, distinct, links = near_lines(docs, **how)
    both = links.unionByName(links.select(F.col("i2").alias("i"), F.col("j2").alias("j"), F.col("i").alias("i2"), F.col("j").alias("j2")))
    other = distinct.select(F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("first").alias("other"))
    linked = both.join(other, ["i2", "j2"]).groupBy("i", "j").agg(F.min("other").alias("other"), F.count("*").alias("links"))
    known = distinct.join(linked, ["i", "j"], "left").where("copies > 1 or links is not null").select("i", "j", F.least("first", "other").alias("best"), F.coalesce("links", F.lit(0)).alias("links"))
    known = written(known, "known-lines")  # so that both sides of the next join are plain shuffles, which adaptive execution splits at hot lines
    rows = lines.select("rid", "doc_id", "pos", "i", "j").join(known, ["i", "j"], "left").dropDuplicates(["rid", "pos"])
    gone = F.struct("doc_id", "pos") > F.col("best")
    return rows.groupBy("rid").agg(
        F.count("*").alias("n_lines"), F.sum(F.coalesce("links", F.lit(0))).cast("bigint").alias("n_links"),
        F.array_sort(F.collect_set(F.when(gone, F.col("pos")))).alias("removed"))


def line_report(docs: DataFrame, **how) -> DataFrame:
    """Per row of docs: doc_id, n_lines (not blank), n_links, removed. Null texts have no lines."""
    found = repeated_lines(docs, **how)
    own = docs.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rid"))
    none = F.array().cast("array<int>")
    zero = F.lit(0).cast("bigint")
    return own.join(found, "rid", "left").select("doc_id", F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce("n_links", zero).alias("n_links"), F.coalesce("removed", none).alias("removed"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with its other columns as they are and the repeated lines gone from text."""
    rid, gone, all_ = unused(docs, "_rid", "_removed", "_lines")
    found = repeated_lines(docs, **how).where(F.size("removed") > 0).select(F.col("rid").alias(rid), F.col("removed").alias(gone))
    lines = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda p: F.get(F.col(all_), p))
    own = docs.withColumn(rid, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(found, rid, "left").withColumn(all_, F.when(F.col(gone).isNotNull(), lines))
    return own.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)
