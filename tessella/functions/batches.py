"""Arrow batches in pieces, so that a function's Python objects don't grow with the batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a piece; a longer row is a piece by itself.
PIECE = 1 << 20


def pieces(batches: Iterator[pa.Array | tuple[pa.Array, ...]], most: int = PIECE) -> Iterator[tuple[pa.Array, ...]]:
    """The rows of the batches (an array, or some of equal length) in their order, in halves of halves down to ``most`` bytes."""
    for batch in batches:
        yield from _halved(batch if isinstance(batch, tuple) else (batch,), most)


def _halved(arrays: tuple[pa.Array, ...], most: int) -> Iterator[tuple[pa.Array, ...]]:
    n = len(arrays[0])
    if n < 2 or sum(a.nbytes for a in arrays) <= most:
        yield arrays
    else:
        yield from _halved(tuple(a.slice(0, n // 2) for a in arrays), most)
        yield from _halved(tuple(a.slice(n // 2) for a in arrays), most)
