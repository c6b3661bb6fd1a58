"""Vectorised text primitives shared by the training-data operators.

Everything works on *chunks*: the bytes of several whole texts laid end to end in one uint8
array, with an offset per text.  A chunk holds at most ``max_bytes`` unless a single text is
longer, so memory does not follow the size of an Arrow batch or of a partition.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
LONG = 512  # bytes beyond which a span gets a digest of its own


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at every place, as numbers (zeros behind the end)."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def byte_span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes a round, mixed after each.  Hashes of different seeds
    are independent.  Spans over LONG bytes go by a cryptographic digest."""
    size = ends - starts
    out = mix(size.astype(U64) * _STEP + U64(seed))
    at8, k, live = loads(buf), 0, np.flatnonzero((size > 0) & (size <= LONG))
    while len(live):
        left = size[live] - k
        out[live] = mix(out[live] * _STEP ^ (at8[starts[live] + k] & _MASKS[np.minimum(left, 8)]))
        live, k = live[left > 8], k + 8
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(buf[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
        out[i] = np.frombuffer(digest, U64)[0]
    return out


def equal_spans(buf: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes from a and from b on are the same, for each pair of places and its size."""
    at8, k, out = loads(buf), 0, np.ones(len(a), bool)
    live = np.flatnonzero(size > 0)
    while len(live):
        out[live] = (at8[a[live] + k] ^ at8[b[live] + k]) & _MASKS[np.minimum(size[live] - k, 8)] == 0
        k += 8
        live = live[out[live] & (size[live] > k)]
    return out


def run_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` codes in a row, by joining runs of powers of two."""
    if len(codes) < n:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, codes, 1
    while True:
        if n & size:
            out = power if out is None else mix(out[: len(codes) - done - size + 1] * _STEP + power[done:])
            done += size
        if done == n:
            return mix(out + U64(n))
        power = mix(power[:-size] * _STEP + power[size:])
        size *= 2


_forgetful: list = []  # what to call when another operator's work begins in this process


def on_other_work(forget) -> None:
    """Have a process-wide memory emptied as soon as the worker turns to another operator."""
    if forget not in _forgetful:
        _forgetful.append(forget)


def forget() -> None:
    """Empty such memories, and give freed memory back to the machine: workers outlive their tasks."""
    while _forgetful:
        _forgetful.pop()()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


@dataclass
class Chunk:
    """Some rows of a batch: ``rows`` of the batch, bytes of their texts, ``offs[i]:offs[i+1]``."""

    batch: pa.RecordBatch
    buf: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def ints(self, name: str) -> np.ndarray:
        return self.batch.column(name).to_numpy(zero_copy_only=False)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column (null: empty) and the offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(batches: Iterator[pa.RecordBatch], max_bytes: int, column: str = "text", max_rows: int = 1 << 15) -> Iterator[Chunk]:
    """Cut Arrow batches into chunks of whole texts."""
    forget()
    for batch in batches:
        if not batch.num_rows:
            continue
        buf, offs = text_bytes(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1
            to = min(max(to, at + 1), at + max_rows, batch.num_rows)
            yield Chunk(batch.slice(at, to - at), buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
            at = to


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words ``[^\\x20\\x09-\\x0D]+``; for each text, its first word's number."""
    n = len(buf)
    inside = (buf != 0x20) & ((buf < 9) | (buf > 13))
    first = np.zeros(n + 1, bool)
    first[offs] = True
    starts = np.flatnonzero(inside & (first[:n] | ~np.concatenate(([False], inside[:-1])))) if n else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & (first[1:] | ~np.concatenate((inside[1:], [False])))) + 1 if n else np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text its first word's number (one more at the end)."""
    starts, ends, first = word_spans(buf, offs)
    return byte_span_hashes(buf, starts, ends), first


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a text, the number of each one's first word, and for
    each text the number of its first run.  ``short``: a text of 1 to n-1 words counts as one run."""
    length = np.diff(first)
    counts = np.maximum(length - n + 1, 0)
    few = (counts == 0) & (length > 0) & short
    counts[few] = 1
    run = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(run[-1]) - np.repeat(run[:-1] - first[:-1], counts)
    whole = ~np.repeat(few, counts)
    out = np.empty(len(at), U64)
    out[whole] = run_hashes(words, n)[at[whole]]
    for k in range(1, n) if few.any() else ():
        some = np.flatnonzero(few & (length == k))
        out[run[some]] = run_hashes(words, k)[first[some]]
    return out, at, run


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays of one dimension as one compressed value."""
    head = b"".join(a.dtype.str.encode().ljust(8) + len(a).to_bytes(8, "little") for a in arrays)
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=level).compress(len(arrays).to_bytes(2, "little") + head + body)


def unpack(value: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    n = int.from_bytes(raw[:2], "little")
    out, at = [], 2 + 16 * n
    for i in range(n):
        head = raw[2 + 16 * i : 18 + 16 * i]
        a = np.frombuffer(raw, np.dtype(head[:8].decode().strip()), int.from_bytes(head[8:], "little"), at)
        at += a.nbytes
        out.append(a)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions ``start .. start+length-1`` of each span, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def text_hash(text: str = "text") -> Column:
    """What texts are known by (null: empty)."""
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))
