"""Signal kernels on arrays, as Arrow batches: FFT cross-correlation, overlap-save, perceptual hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.operators.spread import looked_up

LAG = T.StructType([T.StructField("peak", T.LongType()), T.StructField("n", T.LongType())])


def peak(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Place of the first largest magnitude of the circular cross-correlation, and its length."""
    n = 1 << max(0, int(len(x) + len(y) - 2)).bit_length()
    c = np.abs(np.fft.ifft(np.fft.fft(x, n) * np.conj(np.fft.fft(y, n))))
    return int(np.argmax(np.round(c, 9))), n


def peak_in_blocks(x: np.ndarray, y: np.ndarray, size: int) -> tuple[int, int]:
    """The same peak with memory bounded by `size`: y is correlated with blocks of x that overlap by len(y) - 1."""
    m = len(y)
    step = max(1, size - m + 1)
    n = 1 << max(0, int(len(x) + m - 2)).bit_length()
    padded = np.concatenate([np.zeros(m - 1), x, np.zeros(m - 1)])
    turned = np.conj(np.fft.fft(y, size))
    best, at = -1.0, 0
    for s in range(0, len(x) + m - 1, step):
        block = padded[s : s + size]
        c = np.round(np.abs(np.fft.ifft(np.fft.fft(block, size) * turned))[: min(step, len(x) + m - 1 - s)], 9)
        for k in (np.flatnonzero(c == c.max())[0],):
            lag = s + int(k) - (m - 1)
            place = lag % n
            if c[k] > best or (c[k] == best and place < at):
                best, at = c[k], place
    return at, n


@F.pandas_udf(LAG)
def fft_peak(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([peak(np.asarray(a, float), np.asarray(b, float)) if a is not None and b is not None and len(a) and len(b) else (None, None) for a, b in zip(x, y, strict=True)], columns=["peak", "n"])


@F.pandas_udf(LAG)
def block_peak(x: pd.Series, y: pd.Series) -> pd.DataFrame:
    def one(a, b):
        if a is None or b is None or not len(a) or not len(b):
            return None, None
        return peak_in_blocks(np.asarray(a, float), np.asarray(b, float), 1 << (2 * len(b)).bit_length())

    return pd.DataFrame([one(a, b) for a, b in zip(x, y, strict=True)], columns=["peak", "n"])


def lag(found, rate):
    """(which of the two starts late, by how many seconds): a peak beyond the middle is a negative lag."""
    back = found["peak"] > found["n"] / 2
    return F.when(back, 2).otherwise(1).cast("long"), F.when(back, found["n"] - found["peak"]).otherwise(found["peak"]) / rate


def _cosines(n: int = 32) -> np.ndarray:
    k = np.arange(n)
    d = np.sqrt(2 / n) * np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))
    d[0] /= np.sqrt(2)
    return d


@F.pandas_udf(T.LongType())
def frame_hash(gray: pd.Series) -> pd.Series:
    """64 bits of a 32 x 32 gray frame (1024 bytes): low frequencies over their median, row by row, lowest bit first."""
    d = _cosines()

    def one(raw):
        if raw is None or len(raw) != 1024:
            return None
        low = (d @ np.frombuffer(raw, np.uint8).reshape(32, 32).astype(float) @ d.T)[:8, :8].ravel()
        bits = low > np.median(low[1:])
        return int(np.packbits(bits, bitorder="little").view(np.int64)[0])

    return pd.Series([one(x) for x in gray], dtype="Int64")


PEAK = T.StructType([T.StructField("corr", T.DoubleType()), T.StructField("at", T.LongType())])


@F.pandas_udf(PEAK)
def best_in_block(before: pd.Series, block: pd.Series, y: pd.Series) -> pd.DataFrame:
    """The first largest magnitude of the correlation of y with a block and the samples before it, and its place in the block."""

    def one(p, b, s):
        if b is None or s is None or not len(b) or not len(s):
            return None, None
        m = len(s)
        p = np.asarray(p if p is not None else [], float)[-(m - 1) :] if m > 1 else np.zeros(0)
        x = np.concatenate([np.zeros(m - 1 - len(p)), p, np.asarray(b, float)])
        n = 1 << int(len(x) + m - 2).bit_length()
        c = np.abs(np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(np.asarray(s, float), n)), n)[: len(b)])
        c = np.round(c, 9)
        return float(c.max()), int(c.argmax())

    return pd.DataFrame([one(p, b, s) for p, b, s in zip(before, block, y, strict=True)], columns=["corr", "at"])


def lag_by_blocks(blocks: DataFrame, short: DataFrame, width: int) -> DataFrame:
    """The lag of a short signal in a long one that stands as block rows: file, lag (samples), corr.

    blocks: file, block (from 0), samples (`width` of them, the last may be shorter); short: file, y with at most
    width + 1 samples. A block meets the one before it by (file, block), so a task holds two blocks and y, however long
    the signal. The tail after the last block is a block of zeros. Of equal peaks the smallest lag counts.
    """
    b = blocks.select("file", F.col("block").cast("long").alias("block"), F.col("samples").cast("array<double>").alias("samples"))
    last = b.groupBy("file").agg(F.max(F.struct("block", F.size("samples").alias("n"))).alias("l"))
    about = short.select("file", "y").join(last, "file")
    back = lambda k: b.select("file", (F.col("block") + k).alias("block"), F.col("samples").alias(f"before{k}"))
    inside = b.join(back(1), ["file", "block"], "left").select("file", "block", "samples", F.col("before1").alias("before"))
    # after the last block, which may be short: zeros, with the two blocks before them
    tail = about.where(F.size("y") > 1).select("file", (F.col("l.block") + 1).alias("block"), F.array_repeat(F.lit(0.0), F.size("y") - 1).alias("samples"))
    none = F.array().cast("array<double>")
    tail = tail.join(back(1), ["file", "block"], "left").join(back(2), ["file", "block"], "left").select("file", "block", "samples", F.concat(F.coalesce("before2", none), F.coalesce("before1", none)).alias("before"))
    met = looked_up(inside.unionByName(tail), "file", "block", about)
    start = F.when(F.col("block") > F.col("l.block"), F.col("l.block") * width + F.col("l.n")).otherwise(F.col("block") * width)
    found = met.select("file", best_in_block("before", "samples", "y").alias("p"), (start - (F.size("y") - 1)).alias("_from")).withColumn("lag", F.col("_from") + F.col("p.at"))
    return found.groupBy("file").agg(F.max_by(F.struct("lag", "p.corr"), F.struct("p.corr", -F.col("lag"))).alias("r")).select("file", "r.lag", "r.corr")
