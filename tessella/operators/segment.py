"""Sentences and chunks of a document, a batch of documents at a time and without a shuffle.

Both need running positions within a text. Folds of the engine copy what they have gathered
at every step, which is quadratic in a document's length, so these are Arrow functions:
one pass over a text, or over its sentences' lengths.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.batches import pieces
from tessella.functions.text import BLANK
from tessella.functions.vector import cosine

SENTENCE = "struct<content:string,start_char:int,end_char:int>"
CHUNK = "struct<start_char:int,end_char:int,content:string>"
SIZE, OVERLAP, SEMANTIC = 500, 1, 0.8
#: A sentence ends after stops and white space, or at a line's end.
BOUNDARY = r"[.!?]+\s+|\n\s*"
WHITE = " \t\n\x0b\f\r"
_BOUNDARY, _ALL_BLANK = re.compile(BOUNDARY, re.ASCII), regex.compile(BLANK.replace(r"\s", WHITE))


def _lists(lengths: Sequence[int], **columns: pa.Array) -> pa.ListArray:
    """Lists of structs, with so many entries each."""
    offsets = [0]
    for n in lengths:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def plain_sentences(text: str | None) -> list[tuple[str, int, int]]:
    """(content, start, end) of the sentences; [] for a blank text. Offsets count characters from 0, the end excluded."""
    out: list[tuple[str, int, int]] = []
    if not text or _ALL_BLANK.match(text):
        return out
    start = 0
    for end in [*(m.end() for m in _BOUNDARY.finditer(text)), len(text)]:
        piece = text[start:end]
        body = piece.strip(WHITE)
        if body:
            at = start + len(piece) - len(piece.lstrip(WHITE))
            out.append((body, at, at + len(body)))
        start = end
    return out


def _splitter(split):
    @F.arrow_udf(f"array<{SENTENCE}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (batch,) in pieces(texts):
            found = [split(t) for t in batch.to_pylist()]
            flat = [x for xs in found for x in xs]
            yield _lists([len(x) for x in found], content=pa.array([x[0] for x in flat], pa.string()), start_char=pa.array([x[1] for x in flat], pa.int32()), end_char=pa.array([x[2] for x in flat], pa.int32()))

    return run


def sentences(text: Column) -> Column:
    """array<SENTENCE> of a text, as plain_sentences()."""
    return _splitter(plain_sentences)(text)


def _gathered(lengths: Sequence[int], breaks: Sequence[bool | None], size: int, overlap: int) -> list[tuple[int, int]]:
    """The first and last sentence of each chunk. The length of the open chunk is carried along."""
    out: list[tuple[int, int]] = []
    first, length = 0, -1  # of the open chunk: its first sentence, and its characters with one between sentences

    def close(k: int) -> None:
        nonlocal first, length
        out.append((first, k - 1))
        first = max(k - overlap, first)
        length = sum(lengths[first:k]) + k - first - 1

    for k, n in enumerate(lengths):
        if k > first and breaks[k]:
            close(k)
        if k > first and length + 1 + n > size:
            close(k)
        length += 1 + n
    if len(lengths) > first:
        out.append((first, len(lengths) - 1))
    return out


def chunks(spans: Column, size: int = SIZE, overlap: int = OVERLAP, breaks: Column | None = None) -> Column:
    """array<CHUNK>: sentences gathered greedily up to ``size`` characters.

    A chunk ends before a sentence that would exceed the size, or that ``breaks`` marks;
    the next one begins with its last ``overlap`` sentences. A longer sentence stays whole.
    """

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for spans_, breaks_ in pieces(batches):
            counts, starts, ends, contents = [], [], [], []
            for own, marked in zip(spans_, breaks_, strict=True):
                own = own.values if own.is_valid else None
                text = own.field("content").to_pylist() if own is not None else []
                at = _gathered([len(t) for t in text], (marked.as_py() or []) + [False] * len(text), size, overlap)
                counts.append(len(at))
                if at:
                    first, last = own.field("start_char").to_pylist(), own.field("end_char").to_pylist()
                    starts += [first[i] for i, _ in at]
                    ends += [last[j] for _, j in at]
                    contents += [" ".join(text[i : j + 1]) for i, j in at]
            yield _lists(counts, start_char=pa.array(starts, pa.int32()), end_char=pa.array(ends, pa.int32()), content=pa.array(contents, pa.string()))

    return run(spans, F.array().cast("array<boolean>") if breaks is None else breaks)


def text_chunker(size: int = SIZE, overlap: int = OVERLAP, split: Callable[[str | None], list[tuple[str, int, int]]] = plain_sentences):
    """chunks() of a text's sentences as one function: sentences don't leave the task's Python."""

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for (batch,) in pieces(texts):
            counts, starts, ends, contents = [], [], [], []
            for text in batch.to_pylist():
                own = split(text)
                at = _gathered([len(x[0]) for x in own], [False] * len(own), size, overlap)
                counts.append(len(at))
                starts += [own[i][1] for i, _ in at]
                ends += [own[j][2] for _, j in at]
                contents += [" ".join(x[0] for x in own[i : j + 1]) for i, j in at]
            yield _lists(counts, start_char=pa.array(starts, pa.int32()), end_char=pa.array(ends, pa.int32()), content=pa.array(contents, pa.string()))

    return run


def text_chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    return text_chunker(size, overlap)(text)


def semantic_breaks(vectors: Column, threshold: float = SEMANTIC) -> Column:
    """array<boolean>: whether a sentence is less similar to the one before than the threshold."""
    return F.transform(vectors, lambda v, i: F.when(i == 0, F.lit(False)).otherwise(cosine(F.get(vectors, i - 1), v) < threshold))


def chunks_with_vectors(spans: Column, vectors: Column, size: int = SIZE, overlap: int = OVERLAP, threshold: float = SEMANTIC) -> Column:
    """Semantic breaks where every sentence has a vector, else by size alone."""
    sound = F.coalesce((F.size(vectors) == F.size(spans)) & F.forall(vectors, lambda v: F.coalesce(F.size(v) > 0, F.lit(False))), F.lit(False))
    return chunks(spans, size, overlap, F.when(sound, semantic_breaks(vectors, threshold)))


#: Words with a full stop that end no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof st jr sr vs etc e.g i.e fig no vol inc ltd co dept est approx".split())


def split_sentences(text: str | None) -> list[tuple[str, int, int]]:
    """Rule-based splitting: as sentences(), but not after abbreviations, initials and numbered items."""
    out, start = [], 0
    text = text or ""
    cuts = []
    for m in regex.finditer(BOUNDARY, text):
        if "\n" not in m[0] and m[0][0] == "." and not m[0].startswith(".."):
            word = regex.search(r"[\w.]*$", text[start : m.start()])[0].lower()
            if word in ABBREVIATIONS or regex.fullmatch(r"\p{L}|\d{1,2}", word):
                continue
        cuts.append(m.end())
        start = m.end()
    start = 0
    for end in [*cuts, len(text)]:
        body = text[start:end].strip()
        if body:
            at = text.index(body, start)
            out.append((body, at, at + len(body)))
        start = end
    return out


def rule_sentences(text: Column) -> Column:
    """split_sentences() in place of sentences()."""
    return _splitter(split_sentences)(text)


def chunk_rows(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, splitter=sentences) -> DataFrame:
    """(document_id, chunk_no, start_char, end_char, content) from docs (id, content)."""
    made = text_chunks(F.col("content"), size, overlap) if splitter is sentences else chunks(splitter(F.col("content")), size, overlap)
    each = docs.select(F.col("id").alias("document_id"), F.posexplode(made).alias("chunk_no", "c"))
    return each.select("document_id", "chunk_no", "c.start_char", "c.end_char", "c.content")
