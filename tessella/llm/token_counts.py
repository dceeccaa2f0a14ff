"""Token counts of whole texts, without their ids.

1. Texts are cut into pre-tokens in blocks of bounded size. A block lists each distinct
   pre-token once and keeps, for each text, the frequencies of its pre-tokens as pairs of
   (number in that list, count). Blocks are written in buckets, so frequencies are never shuffled.
2. The distinct pre-tokens of all blocks meet in one shuffle by their hash, and the pieces
   of each distinct one are counted once.
3. The counts go back to the blocks by a join; a text's tokens are the sum of frequency
   times pieces. No sequence of ids is made anywhere.

Normalising, pre-tokenising and counting are the tokenizer library's own steps. A text is cut
at ASCII white space first where the pre-tokenizer drops white space, so that each
distinct word is normalised once.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PART_BYTES, REMEMBERED, _pack, _unpack
from .common import bucketed, lean

#: Tokens over which a text counts as too long.
LIMIT = 2048
#: Words, and distinct ones, from which a block is closed.
BLOCK_WORDS, BLOCK_DISTINCT = 4_000_000, 400_000


def load_tokenizer(path: str) -> str:
    """The tokenizer's JSON, which goes to the workers as it is. Added tokens must be matched in the raw text, as they stand."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    for t in json.loads(source)["added_tokens"]:
        if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"added token {t['content']!r} isn't matched in the raw text as it stands")
    return source


def drops_white_space(source: str) -> bool:
    """Whether words between white space are tokenised apart: the first pre-tokenizer keeps matches of a pattern without white space only."""
    first = json.loads(source)["pre_tokenizer"] or {}
    first = (first.get("pretokenizers") or [first])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "\\s")
    return first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and "\\s" not in pattern.replace("[^\\s", "") and "." not in pattern


def cutter(source: str) -> Callable[[str], list[str]]:
    """A text or word to its pre-tokens as the model gets them; an added token is one by itself."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(source)
    normal = own.normalizer.normalize_str if own.normalizer else str
    pre = own.pre_tokenizer.pre_tokenize_str if own.pre_tokenizer else lambda s: [(s, None)]
    added = sorted((t["content"] for t in json.loads(source)["added_tokens"]), key=len, reverse=True)
    special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def cut(text: str) -> list[str]:
        parts = special.split(text) if special else [text]
        return [w for k, part in enumerate(parts) if part for w in ([part] if k % 2 else [x for x, _ in pre(normal(part))])]

    return cut


def counter(source: str) -> Callable[[str], int]:
    """A pre-token's number of pieces."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_str(source)
    added = {t["content"] for t in json.loads(source)["added_tokens"]}
    return lambda w: 1 if w in added else len(own.model.tokenize(w))


def _cut(source: str, kind: pa.DataType, block_words: int, block_distinct: int, parts: int):
    schema = pa.schema([("block", pa.int64()), ("doc_id", kind), ("n_bytes", pa.int64()), ("part", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("letters", pa.binary()), ("counts", pa.binary())])
    apart = drops_white_space(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, zip_, block = cutter(source), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        find = re.compile(r"[^ \t\n\r]+").findall if apart else lambda t: [t]
        units: dict[str, int] = {}
        remembered: dict[str, list[str]] = {}
        texts, n = [], 0

        def flush():
            words: dict[str, int] = {}
            sizes, flat = np.zeros(len(units), np.int64), []
            for k, u in enumerate(units):
                got = remembered.get(u)
                if got is None:
                    if len(remembered) > REMEMBERED:
                        remembered.clear()
                    got = remembered[u] = cut(u)
                sizes[k] = len(got)
                flat += [words.setdefault(w, len(words)) for w in got]
            flat, starts = np.array(flat, np.int64), np.cumsum(sizes) - sizes
            every = [w.encode() for w in words]
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in every), np.int32, len(every))
            order = np.argsort(part, kind="stable")
            own, at = np.unique(part[order], return_index=True)
            rows = []
            for lo, hi in itertools.pairwise([*at, len(order)]):
                some = [every[k] for k in order[lo:hi]]
                rows.append((_pack(order[lo:hi].astype(np.int32), zip_), _pack([len(w) for w in some], zip_), zip_.compress(b"".join(some))))
            k = len(own)
            columns = [pa.array([r[c] for r in rows], pa.binary()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.array(own, pa.int32()), *columns, pa.nulls(k, pa.binary())], schema=schema)
            numbers, counts = [], []
            for _, _, u, c in texts:
                s = sizes[u]
                places = np.repeat(starts[u] - np.cumsum(s) + s, s) + np.arange(s.sum())
                own, back = np.unique(flat[places], return_inverse=True)
                numbers.append(_pack(np.diff(own, prepend=0), zip_))
                counts.append(_pack(np.bincount(back, np.repeat(c, s)).astype(np.int64), zip_))
            k = len(texts)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * k, pa.int64()), pa.array([t[0] for t in texts], kind), pa.array([t[1] for t in texts], pa.int64()), pa.nulls(k, pa.int32()),
                pa.array(numbers, pa.binary()), *[pa.nulls(k, pa.binary())] * 2, pa.array(counts, pa.binary())], schema=schema)

        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist()
            for doc, nb, text in zip(b.column(0).to_pylist(), size, b.column(1), strict=True):
                found = Counter(find(text.as_py())) if nb else {}
                texts.append((doc, nb, np.array([units.setdefault(u, len(units)) for u in found], np.int64), np.array(list(found.values()), np.int64)))
                n += sum(found.values())
                if n >= block_words or len(units) >= block_distinct:
                    yield from flush()
                    units, texts, n, block = {}, [], 0, block + 1
        if texts:
            yield from flush()

    return run


def _count(source: str):
    """A partition holds whole parts, one after another, and a part all occurrences of its words: each is counted once a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, zip_, unzip = counter(source), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        last = None
        for b in batches:
            sizes = []
            for part, lengths, letters in zip(b.column("part").to_pylist(), b.column("lengths"), b.column("letters"), strict=True):
                if part != last or len(known) > REMEMBERED:
                    known.clear()
                last, got = part, []
                ends, text = np.cumsum(_unpack(lengths.as_py(), unzip)).tolist(), unzip.decompress(letters.as_py())
                for lo, hi in zip([0, *ends], ends, strict=False):
                    w = text[lo:hi]
                    if w not in known:
                        known[w] = pieces(w.decode())
                    got.append(known[w])
                sizes.append(_pack(got, zip_))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("numbers"), pa.array(sizes, pa.binary())], names=["block", "numbers", "sizes"])

    return run


def _sum(kind: pa.DataType):
    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        rows = [(_unpack(a.as_py(), unzip), _unpack(s.as_py(), unzip)) for a, s in zip(words.column("numbers"), words.column("sizes"), strict=True)]
        size = np.zeros(sum(len(a) for a, _ in rows), np.int64)
        for at, s in rows:
            size[at] = s
        total = [int(size[np.cumsum(_unpack(a.as_py(), unzip))] @ _unpack(c.as_py(), unzip).astype(np.int64)) for a, c in zip(docs.column("numbers"), docs.column("counts"), strict=True)]
        return pa.table({"doc_id": docs.column("doc_id").cast(kind), "n_bytes": docs.column("n_bytes"), "n_tokens": pa.array(total, pa.int64())})

    return run


def count_tokens(docs: DataFrame, source: str, *, limit: int = LIMIT, block_words: int = BLOCK_WORDS, block_distinct: int = BLOCK_DISTINCT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Tokens are those of the tokenizer (see load_tokenizer()), without begin and end, and with
    its added tokens where their strings stand in a text. Null and empty texts have none.
    Repeated rows, null ids and ids of any type are rows like any other; other columns are
    not read. A text of any length is counted as a whole, in a block of its own if it is longer than one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"]
    spark_kind, kind = field.dataType.simpleString(), to_arrow_type(field.dataType)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * tasks, math.ceil(size / PART_BYTES))
    schema = f"block long, doc_id {spark_kind}, n_bytes long, part int, numbers binary, lengths binary, letters binary, counts binary"
    cut = docs.select("doc_id", "text").mapInArrow(lean(_cut(source, kind, block_words, block_distinct, parts)), schema)
    cut = bucketed(cut, "count-blocks", "block", max(tasks, parts // 4))
    words = cut.where("part is not null").select("block", "part", "numbers", "lengths", "letters").repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part")
    counted = words.mapInArrow(lean(_count(source)), "block long, numbers binary, sizes binary")
    texts = cut.where("part is null").select(F.col("block").alias("of"), "doc_id", "n_bytes", "numbers", "counts")
    summed = counted.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(_sum(kind), f"doc_id {spark_kind}, n_bytes long, n_tokens long")
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
