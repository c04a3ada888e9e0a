"""What the operators share: cutting lineage, and numpy kernels over the bytes of Arrow text columns.

The kernels treat all texts of a slice of a batch as one byte buffer, so that no Python loop runs
over documents. Slices hold at most `limit` bytes of text (or one longer text).
"""

from __future__ import annotations

import contextlib
import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.spread import looked_up, looked_up_by_size  # noqa: F401  (used by the operators)
from tracklake.sources.tables import cut, tidied  # noqa: F401

SLICE = 1 << 20
U = np.uint64


def blocks_for(df: DataFrame, rows: int) -> int:
    """How many blocks of about `rows` rows df needs."""
    return max(1, -(-df.count() // rows))


def text_only(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key and text, whatever other columns df has; a null text is empty; rows without a key take no part."""
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias(key), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def give_back() -> None:
    """Freed memory goes back to the system: Python workers live on, idle, while other stages need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: str = "text", limit: int = SLICE):
    """Slices of the batches with at most `limit` bytes in `column` each; after the last one freed memory is given back."""
    yield from _slices(batches, column, limit)
    give_back()


def _slices(batches, column: str, limit: int):
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            end = min(max(start + 1, int(np.searchsorted(sizes, base + limit, "right"))), start + 4000)
            yield batch.slice(start, end - start)
            start = end


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins (with the end at last)."""
    array = pc.fill_null(array, "").cast(pa.large_binary())
    _, at, data = array.buffers()
    at = np.frombuffer(at, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power of 0 .. n-1 modulo 2^64, and the inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 64)
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with (H[e] - H[s]) * BASE^-s a hash of the bytes s .. e."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], dtype=np.uint64, out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, at: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and each word's text number; `outside` says which bytes are in no word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~outside[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return span_hash(prefix_hash(LOWER[data]), s, e), np.searchsorted(at, s, "right") - 1


def shingles(w: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """Sorted distinct keys, text number << 52 | 52 bits of hash, of the k-word shingles of n < 4096 texts.

    A text with 1 to k-1 words has one shingle of all of them.
    """
    count = np.bincount(doc, minlength=n)
    if len(w) >= k:
        h = np.zeros(len(w) - k + 1, np.uint64)
        for i in range(k):
            h = mix(h + w[i : len(w) - k + 1 + i] + U(i + 1))
        keep = doc[: len(h)] == doc[k - 1 :]
        h, d = h[keep], doc[: len(h)][keep]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.searchsorted(doc, short)
        x = np.full(len(short), 0x5DEECE66D, np.uint64)
        for i in range(k - 1):
            more = i < count[short]
            x[more] = mix(x[more] + w[first[more] + i] + U(i + 1))
        h, d = np.concatenate([h, x]), np.concatenate([d, short])
    key = (d.astype(np.uint64) << U(52)) | (h >> U(12))
    key.sort()
    return key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key


def starts(doc: np.ndarray, n: int) -> np.ndarray:
    """For sorted text numbers: where each of n texts begins, with the end at last."""
    return np.searchsorted(doc, np.arange(n + 1))


def rows(schema: pa.Schema | list, *columns) -> pa.RecordBatch:
    """A batch from numpy arrays or lists in the order of the schema."""
    schema = pa.schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
