"""Vectorised text kernels shared by the corpus operators.

Everything here works on the raw UTF-8 bytes of one Arrow batch: words are found, hashed and shingled for many
documents at once with numpy, so a task spends its time in array code and never in a per-word Python loop.
Memory is bounded by ``CHUNK_BYTES`` plus the longest single document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text handled at once: arrays of eight bytes a place then stay in a core's cache.
CHUNK_BYTES = 1 << 17
#: Bytes of rows that go to a Python worker at once, and the setting that bounds them.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def batches_by_bytes(spark: SparkSession) -> None:
    """Bound Arrow batches of this session by ``BATCH_BYTES``, unless it has a bound of its own.

    By rows alone a batch holds 10,000 texts of any length. Both sides of the pipe hold it whole, and a worker keeps what it has
    once held while later steps run that need no Python.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, up to n."""
    have = _powers.get("up")
    if have is None or len(have) < n + 1:
        size = max(n + 1, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            row = np.full(size, base, dtype=U64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=U64)
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, from prefix sums of a polynomial modulo 2**64."""
    up, down = _tables(len(data))
    prefix = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def window_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """``span_hashes`` of every window of ``k`` places, without a gather."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    up, down = _tables(len(data))
    prefix = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=prefix[1:])
    h = prefix[k:] - prefix[:-k]
    h *= down[:n]
    h += U64(k * 0xD6E8FEB86659FD93 % (1 << 64))
    return mix(h)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Chunk:
    """Some documents of a batch: ``data`` holds their bytes, document i is ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, null: np.ndarray):
        self.first, self.data, self.offsets, self.null = first, data, offsets, null

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every run of bytes that are not 0x20 or 0x09-0x0D, and the number of runs per document."""
        return runs(~_SPACE[self.data], self.offsets)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of True within a document, and the number of runs per document."""
    n = len(inside)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < n]
    first[at] = inside[at]  # a document starts anew
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = offsets[1:][offsets[1:] > 0] - 1
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    cuts = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(cuts)


def chunks(column: pa.Array) -> Iterator[Chunk]:
    """Split a text column into chunks of about CHUNK_BYTES; null counts as empty but is marked."""
    column = column.cast(pa.large_binary())
    if column.offset:
        column = pa.concat_arrays([column])
        column = pa.array(column.to_pylist(), pa.large_binary()) if column.offset else column
    n = len(column)
    if not n:
        return
    null = np.asarray(column.is_null())
    _, off, buf = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[: n + 1]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, dtype=np.uint8)
    if null.any():  # a null may cover bytes
        offsets = offsets.copy()
        sizes = np.where(null, 0, np.diff(offsets))
        if int(sizes.sum()) != int(offsets[-1] - offsets[0]):
            kept = [data[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(~null)]
            data = np.concatenate(kept) if kept else np.zeros(0, dtype=np.uint8)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1
        j = min(n, max(i + 1, j))
        part = offsets[i : j + 1]
        yield Chunk(i, data[part[0] : part[-1]], part - part[0], null[i:j])
        i = j


#: Odd weights of the words of a shingle.
_WEIGHTS = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and their number per document; fewer than k words make one shingle of all."""
    n = len(hashes)
    starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    total = int(per_doc.sum())
    if not total:
        return np.zeros(0, dtype=U64), per_doc
    firsts = np.concatenate([[0], np.cumsum(per_doc)])[:-1]
    at = np.arange(total) - np.repeat(firsts - starts, per_doc)  # first word of each shingle
    acc = np.zeros(total, dtype=U64)
    length = np.repeat(np.minimum(counts, k), per_doc)
    short = bool((length < k).any())
    for j in range(k):
        take = hashes[np.minimum(at + j, n - 1)] * _WEIGHTS[j]
        acc += np.where(length > j, take, U64(0)) if short else take
    return mix(acc + length.astype(U64)), per_doc


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting: several times as fast here as the hash table behind ``np.unique``."""
    ordered = np.sort(values)
    fresh = np.ones(len(ordered), dtype=bool)
    fresh[1:] = ordered[1:] != ordered[:-1]
    return ordered[fresh]


def distinct_by_doc(values: np.ndarray, per_doc: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct values of each document."""
    cuts = np.concatenate([[0], np.cumsum(per_doc)])
    return [distinct(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def word_hashes(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word after lower-casing A-Z, and the number of words per document."""
    starts, ends, counts = chunk.words()
    return span_hashes(lower_ascii(chunk.data), starts, ends), counts
