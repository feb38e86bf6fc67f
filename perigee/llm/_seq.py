"""Vectorised byte and word helpers shared by the operators of this subpackage.

Everything works on Arrow string columns block by block, without a Python
object per text: a block is a run of whole texts whose bytes lie in one numpy
array.  The helpers run inside ``mapInArrow`` tasks; Spark partitions and
shuffles what they emit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once by the numpy kernels (a longer text forms a block of its own).
BLOCK_BYTES = 256 << 10

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LEFT, _RIGHT = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring halves.  It isn't linear in either, so that no algebra of the symbols cancels."""
    x = a * _LEFT
    x += b
    x ^= x >> U64(29)
    x *= _RIGHT
    x ^= x >> U64(32)
    return x


def span_hash(symbols: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of symbols[start:end] for many ranges at once; equal contents give equal hashes.

    Hashes of all stretches of 1, 2, 4, ... symbols are built in turn; a range is told by its
    length and the two stretches, the longest that fit, at its ends.
    """
    size = (end - start).astype(np.int64)
    out = np.zeros(len(size), U64)
    level = np.frexp(size.astype(np.float64))[1] - 1
    top = int(level.max(initial=-1))
    have, width = symbols, 1
    for k in range(top + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = _joined(have[start[at]], have[end[at] - width])
        if k < top:
            have = _joined(have[:-width], have[width:])
            width *= 2
    return mix(out ^ mix(size.astype(U64) + U64(0x5851F42D4C957F2D + seed)))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, size: int = 8) -> np.ndarray:
    """BLAKE2b of data[start:end] for many ranges, as rows of signed 64-bit integers; stands for the bytes."""
    view = memoryview(data)
    raw = b"".join([blake2b(view[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    return np.frombuffer(raw, np.int64).reshape(-1, size // 8)


@dataclass
class Block:
    """Some consecutive rows: ``data[offsets[i]:offsets[i+1]]`` is row ``first + i``'s text in UTF-8."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    @property
    def n(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of an Arrow string or binary column; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, off, buf = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        j = min(j, n)
        yield Block(data[off[i] : off[j]], off[i : j + 1] - off[i], i)
        i = j


def shards(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """The rows of a task in runs of about ``most`` bytes of ``text``; a row is never cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy().astype(np.int64))
        i = 0
        while i < batch.num_rows:
            before = int(total[i - 1]) if i else 0
            j = min(batch.num_rows, int(np.searchsorted(total, before + most - size, "left")) + 1)
            held.append(batch.slice(i, j - i))
            size += int(total[j - 1]) - before
            i = j
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """data[start:end] of many ranges as an Arrow string column."""
    size = (end - start).astype(np.int64)
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.large_utf8(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``; every byte of a longer UTF-8 sequence belongs to a word.
NON_SPACE = ~_SPACE
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = _ALNUM


@dataclass
class Words:
    """The words of a block: byte ranges, the row each belongs to, a 64-bit hash of each."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of each row's first word; one longer than the rows

    @property
    def n(self) -> int:
        return len(self.start)


def runs(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true bytes; a run never crosses a row's border."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(flags) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(flags), bool)
    before[0], before[1:] = False, flags[:-1]
    after = np.empty(len(flags), bool)
    after[-1], after[:-1] = False, flags[1:]
    return np.flatnonzero(flags & ~(before & ~cut[:-1])), np.flatnonzero(flags & ~(after & ~cut[1:])) + 1


def words(block: Block, kind: np.ndarray, data: np.ndarray | None = None) -> Words:
    data = block.data if data is None else data
    start, end = runs(kind[data], block.offsets)
    row = np.searchsorted(block.offsets, start, "right") - 1
    return Words(start, end, row, span_hash(byte_symbols(data), start, end), np.searchsorted(row, np.arange(block.n + 1)))


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over values[first[i]:first[i+1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i:i+width] for every i that has as many."""
    if len(x) < width:
        return x[:0]
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


@dataclass
class Pieces:
    """Runs of windows that share their anchor, the window's least k-mer.

    A window of ``width`` symbols starts at each of lo..hi (both included); together they
    cover lo..hi+width.  Equal windows choose equal anchors, so a window can repeat only
    where its anchor repeats, and a piece is judged by what its anchor's other pieces hold.
    In a text that goes on with a short period one piece holds its anchor at many ``places``.
    """

    row: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    places: np.ndarray


def squeezed(data: np.ndarray, w: Words, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins: words i..j are out[at[i] : at[j + 1] - 1]."""
    size = w.end - w.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 32, np.uint8)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(w.n), size)] = data[kind[data]]
    return out, at


def kmer_hash(symbols: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive symbols; contents alone decide it."""
    have, width = symbols, 1
    while 2 * width <= k:
        have = _joined(have[:-width], have[width:])
        width *= 2
    return _joined(have[: len(have) - (k - width)], have[k - width :])


def pieces(symbols: np.ndarray, first: np.ndarray, width: int, k: int) -> Pieces:
    """Pieces of a block of hashed symbols, of which row i has first[i]..first[i+1]; contents are left to the caller."""
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if n < width:
        return Pieces(none, none, none, none.view(U64), none)
    low = U64(0xFFFFFFFF)  # of a key: the upper half ranks by hash, the lower holds the place
    kmer = kmer_hash(symbols, k)
    key = kmer & ~low
    key |= np.arange(len(kmer), dtype=U64)  # ties go to the leftmost
    at = (sliding_min(key, width - k + 1) & low).astype(np.int64)
    moved = np.zeros(len(at) + 1, np.int64)
    np.cumsum(at[1:] != at[:-1], out=moved[1:-1])
    held = kmer[at]
    new = np.ones(len(at), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    new[first[first < len(at)]] = True
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    row = np.searchsorted(first, lo, "right") - 1
    hi = np.minimum(hi, first[row + 1] - width)  # windows end with their row
    ok = hi >= lo
    lo, hi, row = lo[ok], hi[ok], row[ok]
    return Pieces(row, lo, hi, mix(held[lo]), moved[hi] - moved[lo] + 1)
