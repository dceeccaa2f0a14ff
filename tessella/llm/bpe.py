"""Byte-level BPE over a global shuffle of distinct words.

1. Texts are cut into pre-tokens in blocks of bounded size. A block lists each distinct
   pre-token once and keeps, for each text, the positions as numbers into that list. The
   blocks are written in buckets, so their positions are never shuffled.
2. The distinct pre-tokens of all blocks meet in one shuffle by their hash (those of a
   block and a hash share a packed row), and each distinct one is encoded once.
3. The ids go back to the blocks by a join, which puts them in order by position.
Decoding joins the ids with the table of token bytes by position: the table is as long as
the vocabulary (a bound known beforehand), goes to each worker, and the id is the place in it.
"""

from __future__ import annotations

import base64
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, lean

#: Pre-tokens, and distinct ones, from which a block is closed.
BLOCK_TOKENS, BLOCK_WORDS = 4_000_000, 600_000
#: Encoded words that a task remembers. Beyond that it forgets them all and encodes some again.
REMEMBERED = 500_000
#: Bytes of text for each part of the distinct words.
PART_BYTES = 32 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def split_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with \s as Unicode white space, as in the tiktoken library: Python's has four controls more."""
    return regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


def _pack(numbers: list[int] | np.ndarray, zip_: zstandard.ZstdCompressor) -> bytes:
    """Whole numbers below 2 ** 31, byte by byte in planes."""
    return zip_.compress(np.array(numbers, "<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(data: bytes, zip_: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zip_.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _cut(pattern: str, kind: pa.DataType, block_tokens: int, block_words: int, parts: int):
    schema = pa.schema([("block", pa.int64()), ("doc_id", kind), ("part", pa.int32()), ("numbers", pa.binary()), ("lengths", pa.binary()), ("letters", pa.binary()), ("positions", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, zip_, task = split_pattern(pattern).findall, zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        words: dict[str, int] = {}
        ids, packed, n, block = [], [], 0, task

        def flush():
            every = [w.encode() for w in words]
            part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in every), np.int32, len(every))
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            rows = []
            for lo, hi in itertools.pairwise(np.append(starts, len(order)).tolist()):
                at = order[lo:hi]  # ascending
                some = [every[k] for k in at]
                rows.append((_pack(np.diff(at, prepend=0), zip_), _pack([len(w) for w in some], zip_), zip_.compress(b"".join(some))))
            k = len(own)
            columns = [pa.array([r[c] for r in rows], pa.binary()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.nulls(k, kind), pa.array(own, pa.int32()), *columns, pa.nulls(k, pa.binary())], schema=schema)
            k = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([block] * k, pa.int64()), pa.array(ids, kind), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.binary())] * 3, pa.array(packed, pa.binary())], schema=schema)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = [words.setdefault(w, len(words)) for w in find(text.as_py() or "")]
                ids.append(doc)
                packed.append(_pack(found, zip_))
                n += len(found)
                if n >= block_tokens or len(words) >= block_words:
                    yield from flush()
                    words, ids, packed, n, block = {}, [], [], 0, block + 1
        if ids:
            yield from flush()

    return run


def _encode(ranks: dict[bytes, int]):
    """A partition holds whole parts, one after another, and a part all occurrences of its words: each is encoded once a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        piece = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        zip_, unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        known: dict[bytes, list[int]] = {}
        last = None
        for b in batches:
            sizes, ids = [], []
            for part, lengths, letters in zip(b.column("part").to_pylist(), b.column("lengths"), b.column("letters"), strict=True):
                if part != last or len(known) > REMEMBERED:
                    known.clear()
                last = part
                ends, text = np.cumsum(_unpack(lengths.as_py(), unzip)).tolist(), unzip.decompress(letters.as_py())
                got = []
                for lo, hi in zip([0, *ends], ends, strict=False):
                    w = text[lo:hi]
                    if w not in known:
                        known[w] = piece(w)
                    got.append(known[w])
                sizes.append(_pack([len(x) for x in got], zip_))
                ids.append(_pack(np.fromiter(itertools.chain.from_iterable(got), np.int32), zip_))
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("numbers"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], names=["block", "numbers", "sizes", "ids"])

    return run


def _gathered(values: pa.BinaryArray, at: np.ndarray) -> memoryview:
    """The bytes of ``values`` at these places, one after another."""
    got = values.take(pa.array(at))
    offsets = np.frombuffer(got.buffers()[1], np.int64 if pa.types.is_large_binary(got.type) else np.int32)[got.offset : got.offset + len(got) + 1]
    return memoryview(got.buffers()[2])[offsets[0] : offsets[-1]] if len(at) and got.buffers()[2] is not None else memoryview(b"")


def _place(kind: pa.DataType):
    def run(words: pa.Table, docs: pa.Table) -> pa.Table:
        unzip, none = zstandard.ZstdDecompressor(), [np.empty(0, np.int32)]
        numbers, sizes, ids = (np.concatenate(none + [f(_unpack(x.as_py(), unzip)) for x in words.column(c)]) for c, f in (("numbers", np.cumsum), ("sizes", lambda x: x), ("ids", lambda x: x)))
        size, start = np.zeros(len(numbers), np.int32), np.zeros(len(numbers), np.int64)
        size[numbers], start[numbers] = sizes, np.cumsum(sizes) - sizes
        parts = []
        for p in docs.column("positions"):
            at = _unpack(p.as_py(), unzip)
            n = size[at]
            parts.append(ids[np.repeat(start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = np.concatenate(none + parts)
        return pa.table({"doc_id": docs.column("doc_id").cast(kind), "token_ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))})

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, block_tokens: int = BLOCK_TOKENS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of docs: doc_id, token_ids. Null and empty texts have no tokens.

    Repeated rows and null ids are rows like any other. A text of any length is cut as a whole,
    in a block of its own if it is longer than one.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    field = docs.schema["doc_id"]
    spark_kind, kind = field.dataType.simpleString(), to_arrow_type(field.dataType)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4 * tasks, math.ceil(size / PART_BYTES))
    schema = f"block long, doc_id {spark_kind}, part int, numbers binary, lengths binary, letters binary, positions binary"
    cut = docs.select("doc_id", "text").mapInArrow(lean(_cut(pattern, kind, block_tokens, block_words, parts)), schema)
    cut = bucketed(cut, "bpe-blocks", "block", max(tasks, parts // 4))
    words = cut.where("part is not null").select("block", "part", "numbers", "lengths", "letters").repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part")
    coded = words.mapInArrow(lean(_encode(ranks)), "block long, numbers binary, sizes binary, ids binary")
    texts = cut.where("positions is not null").select(F.col("block").alias("of"), "doc_id", "positions")
    return coded.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(_place(kind), f"doc_id {spark_kind}, token_ids array<int>")


def _decode(ranks: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for k, v in ranks.items():
            table[v] = k
        table = pa.array(table, pa.large_binary())
        for b in batches:
            out = [bytes(_gathered(table, x.values.to_numpy())) if x.is_valid else None for x in b.column("token_ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with decoded, the bytes of token_ids (null for null)."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(lean(_decode(ranks)), schema)


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, more of its columns, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    return decoded.select(
        "doc_id", *more, F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
