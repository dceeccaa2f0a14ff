"""Main text of web pages by differencing against the nearest URL.

1. Each page becomes lines of text, menus and adverts too. Pages of a host with equal lines
   are one.
2. The pages of a host are put in the order of their paths. Neighbours that share nearly
   all of their text are versions of one page and form a run; the nearest other page, that
   with the longest common path beginning, stands just before or just after the run. If
   that is a version too, the search goes on behind its run, until a page decides or the
   host has no more.
3. Both pages' lines are aligned by their longest common subsequence. What they share goes.
4. Marks protect: the plain lines of a marked article stay although others have them.
   Otherwise copies of an article would delete each other.
5. What differencing can't see, since no other page has it, goes by tag, role, class or id:
   menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.
   Of a page with a marked article, only that stays; of another one, lines that are
   nothing but links go as menus.
"""

from __future__ import annotations

import html
import os.path
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, written
from .url_filters import host_of, path_of

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[a-zA-Z][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_HIDDEN = re.compile(r"""\shidden(?=[\s/>=])(?=(?:[^"']|"[^"]*"|'[^']*')*>$)""")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_SPACE = frozenset("br td th".split())
_GONE = frozenset("head script style textarea title xmp iframe noembed noframes noscript template nav footer aside form button select datalist dialog menu object svg canvas audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_NAMES = frozenset(
    "nav navbar navigation menu menubar topnav sidenav mainmenu submenu masthead footer sidebar aside ad ads adv advert adverts advertisement advertising adsense adsbygoogle adbox sponsor sponsored promo promotion banner cookie cookies cookiebar cookiebanner consent gdpr "
    "notice notices notification alert hidden skip popup modal overlay newsletter subscribe subscription signup comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations "
    "breadcrumb breadcrumbs pagination pager toolbar widget widgets copyright login".split())
_NOT = frozenset("has no with without is not hide".split())
_OWN = frozenset("article post entry story content body main".split())
_ARTICLE = frozenset("articlebody article-body article-content article-text post-content post-body entry-content story-body story-content main-content maincontent content-body page-content".split())
#: What an opening tag closes first, if it is open within the nearest of the second.
_CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _CLOSES.items()}
#: Pages that share more than this part of their text's characters are versions of one page.
COPY_SHARE = 0.8
#: Alignments of more line pairs than these are halved first.
MOST_BITS = 100_000_000


class Line(NamedTuple):
    text: str
    linked: int  # characters within links
    mark: int  # as in _marks
    title: bool  # within a level-one heading
    gone: bool  # within an unwanted element
    plain: bool  # no named container between the mark and the line


def _attributes(tag: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").strip().lower() for m in _ATTR.finditer(tag)}


def _unwanted(name: str, attrs: dict[str, str], inside: bool, by_name: bool) -> bool:
    if name in _GONE or "hidden" in attrs or attrs.get("role") in _ROLES or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if name == "header":
        return not inside
    if not by_name or name in ("html", "body", "main"):
        return False
    for label in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        parts = [x for x in re.split(r"[^a-z0-9]+", label) if x]
        if not parts or parts[0] in _NOT or label in _ARTICLE:
            continue
        if name == "article":
            if {"comment", "comments"} & {*parts}:
                return True
        elif _NAMES & {*parts} or ("header" in parts and not inside and not _OWN & {*parts}):
            return True
    return False


def _marks(name: str, attrs: dict[str, str]) -> int:
    """2: an article, 1: the main part, 0: neither."""
    if name == "article" or attrs.get("itemprop") == "articlebody" or attrs.get("role") == "article":
        return 2
    labels = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return 1 if name == "main" or attrs.get("role") == "main" or (name in ("div", "section", "td") and any(x in _ARTICLE for x in labels)) else 0


def _named(name: str, attrs: dict[str, str]) -> bool:
    """Whether an element is a container that a page's author named, other than as the article."""
    if name not in ("div", "section", "span", "ul", "ol", "dl", "table", "center", "details"):
        return False
    labels = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return bool(labels) and not any(x in _ARTICLE or _OWN & {*re.split(r"[^a-z0-9]+", x)} for x in labels)


def _parse(source: str, by_name: bool) -> list[Line]:
    lines: list[Line] = []
    stack: list[tuple[str, bool, int, bool]] = []  # name, unwanted (itself or above), mark (of itself or above), named below the mark
    text: list[str] = []
    lost: list[str] = []  # of unwanted elements within the line
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        mark, named = (stack[-1][2], stack[-1][3]) if stack else (0, False)
        title = any(x[0] == "h1" for x in stack)
        for parts, gone in ((text, False), (lost, True)):
            line = " ".join("".join(parts).split()) if parts else ""
            if line:
                lines.append(Line(line, linked, mark, title, gone, mark > 0 and not named and not gone))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        if any(x[0] in _BLOCK for x in stack[k:]):
            flush()
        del stack[k:]

    def put(chunk: str) -> None:
        nonlocal linked
        if not chunk:
            return
        chunk = html.unescape(chunk)
        if stack and stack[-1][1]:
            lost.append(chunk)
            return
        text.append(chunk)
        if any(x[0] == "a" for x in stack):
            linked += len("".join(chunk.split()))

    while (m := _TOKEN.search(source, at)) is not None:
        put(source[at : m.start()])
        at, tag = m.end(), m[0]
        named = _NAME.match(tag)
        if not named:
            if tag.startswith("<![CDATA["):
                put(html.escape(tag[9:-3]))
            continue
        name = named[1].lower()
        if tag[1] == "/":
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None:
                close(k)
            elif name in _BLOCK:
                flush()
            continue
        if name in _SPACE:
            (lost if stack and stack[-1][1] else text).append(" ")
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _BLOCK:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p"), None)
            if k is not None:
                close(k)
            flush()
        if name in _CLOSES:
            own, until = _CLOSES[name]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in own:
                    close(k)
                    break
                if stack[k][0] in until:
                    break
        attrs = _attributes(tag) if "=" in tag else {}
        if _HIDDEN.search(tag):
            attrs["hidden"] = ""
        gone, mark, named_ = stack[-1][1:] if stack else (False, 0, False)
        if not gone and _unwanted(name, attrs, mark > 0, by_name):
            gone = True
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if tag.endswith("/>") and name in ("svg", "path"):
            continue
        own = _marks(name, attrs)
        named_ = named_ and own <= mark or (mark > 0 or own == 0) and _named(name, attrs)
        stack.append((name, gone, max(mark, own), named_))
    put(source[at:])
    flush()
    return lines


def _body(source: str | None) -> tuple[list[Line], list[bool], bool]:
    """All lines of the page, which of them structure takes for its text, and whether its article is marked.

    Of a marked article these are its own lines, and a level-one heading before it if it has none.
    """
    lines: list[Line] = []
    for by_name in (True, False):
        lines = _parse(source or "", by_name)
        best = max((x.mark for x in lines if not x.gone), default=0)
        if best:
            first = next(i for i, x in enumerate(lines) if x.mark == best and not x.gone)
            titled = any(x.title for x in lines if x.mark == best and not x.gone)
            return lines, [not x.gone and (x.mark == best or (x.title and i < first and not titled)) for i, x in enumerate(lines)], True
        if any(not x.gone for x in lines):
            break
    return lines, [not x.gone for x in lines], False


def page_lines(source: str | None) -> tuple[list[tuple[str, int]], bool]:
    """The lines that structure takes for the text, with their characters within links, and whether the article is marked."""
    lines, body, marked = _body(source)
    return [x[:2] for x, b in zip(lines, body, strict=True) if b], marked


def _masks(b: list[int]) -> dict[int, int]:
    """The places of each value as bits."""
    out: dict[int, int] = {}
    for j, x in enumerate(b):
        out[x] = out.get(x, 0) | 1 << j
    return out


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """After each element of a, a bit for each prefix of b: 0 where its last element lengthens the common subsequence (Hyyrö)."""
    every, places = (1 << len(b)) - 1, _masks(b)
    v = every
    for x in a:
        u = v & places.get(x, 0)
        v = (v + u | v - u) & every
        yield v


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the common subsequence of a with each prefix of b."""
    v = (1 << len(b)) - 1
    for v in _rows(a, b):  # noqa: B007  the last one
        pass
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list[int], b: list[int], most_bits: int = MOST_BITS) -> list[int]:
    """The positions in a of a longest common subsequence with b, bit-parallel.

    The memory is bounded: large problems are halved at a and cut where the halves' sum is best (Hirschberg).
    """
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    inner_a, inner_b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not inner_a or not inner_b:
        found: list[int] = []
    elif len(inner_a) > 1 and len(inner_a) * len(inner_b) > most_bits:
        half = len(inner_a) // 2
        cut = int((_lengths(inner_a[:half], inner_b) + _lengths(inner_a[half:][::-1], inner_b[::-1])[::-1]).argmax())
        found = common_lines(inner_a[:half], inner_b[:cut], most_bits) + [half + i for i in common_lines(inner_a[half:], inner_b[cut:], most_bits)]
    else:
        rows, found, i, j = list(_rows(inner_a, inner_b)), [], len(inner_a), len(inner_b)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
        found.reverse()
    return [*range(lo), *(lo + i for i in found), *range(len(a) - hi, len(a))]


def _outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of a page's lines, and for each twice its characters (0 if structure drops it), plus 1 if it is protected."""
    for b in batches:
        rows = []
        for source in b.column("html"):
            lines, body, _ = _body(source.as_py())
            hashes = [xxhash.xxh3_64_intdigest(x.text.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]
            weights = [2 * len(x.text) * k + (x.plain and k) for x, k in zip(lines, body, strict=True)]
            rows.append((xxhash.xxh3_128_digest(np.array([hashes, weights], np.int64).tobytes()), hashes, weights))
        key, hashes, weights = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(n) for n in ("rid", "host", "path")), pa.array(key, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int32()))],
            names=["rid", "host", "path", "key", "hashes", "weights"])


def _copies(weights: list[int], at: list[int]) -> bool:
    """Whether the shared lines are nearly all of the text."""
    return sum(weights[i] // 2 for i in at) > COPY_SHARE * sum(w // 2 for w in weights)


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The numbers of the pages that are versions of the one before."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            at = common_lines(r["hashes"], r["before"])
            if _copies(r["weights"], at):
                out.append(r["number"])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["number"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page against one other, t runs away. A smaller ``near`` is a longer common beginning of their paths.

    deleted: the places of lines that both have and that nothing else removes or protects; null if
    the page is a version of the other. n_shared counts all that both have but protected lines.
    """
    for b in batches:
        out = []
        for r in b.to_pylist():
            at, deleted, n_shared = common_lines(r["hashes"], r["other"]), None, 0
            if not _copies(r["weights"], at):
                deleted = [i for i in at if r["weights"][i] > 1 and not r["weights"][i] & 1]
                n_shared = sum(not r["weights"][i] & 1 for i in at)
            out.append((r["number"], r["t"], -len(os.path.commonprefix([r["path"], r["other_path"]])), r["side"], deleted, n_shared))
        columns = zip(*out, strict=True) if out else [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["number", "t", "near", "side", "deleted", "n_shared"])


def _text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for source, gone in zip(b.column("html"), b.column("deleted"), strict=True):
            lines, body, marked = _body(source.as_py())
            gone = set(gone.as_py() or ())
            kept = [x for i, x in enumerate(lines) if body[i] and i not in gone and (marked or x.linked < len(x.text.replace(" ", "")))]
            texts.append("\n".join(x.text for x in kept))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


BROADCAST_ROWS = 100_000


def _numbered(pages: DataFrame) -> DataFrame:
    """The distinct pages of each host in the order of their paths, numbered, whatever their host's size; part is a stretch of them."""
    order = ["host", "path", "key"]
    sorted_ = written(pages.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1)
    return _with_offset(sorted_.withColumn("part", part), F.count("*")).withColumn("number", F.col("offset") + within).drop("offset", "place")


def _with_offset(rows: DataFrame, total) -> DataFrame:
    """rows (part, ...) with offset, the sum of ``total`` over all parts before. A row a part comes to the driver."""
    before, sum_ = [], 0
    for r in sorted(rows.groupBy("part").agg(total.alias("n")).collect()):
        before.append((r["part"], sum_))
        sum_ += r["n"]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(before, "part long, offset long")), "part")


def shared_lines(pages: DataFrame) -> DataFrame:
    """(rid, deleted, n_shared) for the pages of which another page of the host has lines.

    deleted: the places, among all lines of the page, of those that go by differencing alone.
    n_shared: how many lines the other page has too, those that structure drops as well
    included, protected ones not.
    """
    slim = pages.select("rid", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"), "html")
    outline = written(slim.mapInArrow(lean(_outline), "rid long, host string, path string, key binary, hashes array<long>, weights array<int>"), "outline")
    distinct = outline.groupBy("host", "key").agg(F.min("path").alias("path"), F.any_value("hashes").alias("hashes"), F.any_value("weights").alias("weights"))
    numbered = written(_numbered(distinct), "numbered")
    before = numbered.select((F.col("number") + 1).alias("number"), F.col("host").alias("_host"), F.col("hashes").alias("before"))
    met = numbered.select("number", "host", "hashes", "weights").join(before, "number").where("host = _host").select("number", "hashes", "weights", "before")
    same = met.mapInArrow(lean(_versions), "number long").select("number", F.lit(0).alias("first"))
    # Runs of versions: the number of runs up to each page, summed within its stretch and then over the stretches before.
    flags = written(numbered.select("number", "part").join(same, "number", "left").withColumn("first", F.coalesce("first", F.lit(1))), "runs")
    inner = F.sum("first").over(W.partitionBy("part").orderBy("number"))
    runs = _with_offset(flags, F.sum("first")).select("number", (F.col("offset") + inner).alias("run"))
    ends = runs.groupBy("run").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    spans = written(numbered.join(runs.join(ends, "run"), "number"), "spans")
    # A run is met at its nearer end: from after it at its last page (side 0), from before it at its first (side 1).
    sides = F.filter(F.array(F.when(F.col("number") == F.col("hi"), 0), F.when(F.col("number") == F.col("lo"), 1)), lambda x: x.isNotNull())
    other = spans.select(F.col("run").alias("ask"), F.explode(sides).alias("_side"), F.col("host").alias("_host"), F.col("path").alias("other_path"), F.col("hashes").alias("other"))
    left, decided, t = spans, [], 1
    while True:  # each round asks twice as far as the one before, so their number is logarithmic in a host's runs
        asks = left.select("number", "host", "path", "hashes", "weights", "run", F.explode(F.sequence(F.lit(t), F.lit(2 * t - 1)).cast("array<bigint>")).alias("t"))
        asks = asks.select("number", "host", "path", "hashes", "weights", "t", F.posexplode(F.array(F.col("run") - F.col("t"), F.col("run") + F.col("t"))).alias("side", "ask"))
        met = asks.join(other, (asks["ask"] == other["ask"]) & (F.col("side") == F.col("_side"))).where("host = _host").select("number", "path", "hashes", "weights", "t", "side", "other_path", "other")
        each = met.mapInArrow(lean(_shared), "number long, t long, near int, side int, deleted array<int>, n_shared int")
        first = F.min(F.when(F.col("deleted").isNotNull(), F.struct("t", "near", "side", "deleted", "n_shared")))
        done = written(each.groupBy("number").agg(first.alias("d"), F.max("t").alias("far")), "differences")
        decided.append(done.where("d is not null").select("number", "d.deleted", "d.n_shared"))
        open_ = done.where((F.col("far") == 2 * t - 1) & F.col("d").isNull()).select("number")
        if open_.isEmpty():
            break
        left, t = spans.join(open_, "number", "left_semi"), 2 * t
    found = reduce(DataFrame.unionByName, decided).where("n_shared > 0")
    found = numbered.select("number", "host", "key").join(found, "number")
    return outline.select("rid", "host", "key").join(found, ["host", "key"]).select("rid", "deleted", "n_shared").dropDuplicates(["rid"])


def extract(pages: DataFrame, *, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars. Null and empty html have the text ''.

    Pages without a readable host count as one host. A page that shares nearly all of its
    text with every other page of its host keeps it. Repeated rows get equal texts.
    """
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("rid"))
    shared = written(shared_lines(keyed).where(F.size("deleted") > 0).select("rid", "deleted"), "shared-lines")
    few = shared.limit(broadcast_rows + 1).count() <= broadcast_rows
    kind = pages.schema["page_id"].dataType.simpleString()
    met = keyed.join(F.broadcast(shared) if few else shared, "rid", "left").select("page_id", "url", "html", "deleted")
    return met.mapInArrow(lean(_text), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
