"""Cross-correlation of two signals of any length, as blocks of `width` values.

Of signals of few blocks (FEW) block i of the left and block j of the right one give the lags around (i - j) * width. So blocks
meet by their difference: a task turns the blocks of one difference into spectra, pair after pair, and adds the products up; one
inverse transform at the end gives all lags of that difference, half of which the neighbouring difference gives too. Each block
is sent to as many differences as the other signal has blocks. A task holds two blocks and one spectrum.

Longer signals are turned into one spectrum by the steps of one long transform, so that what is sent grows with their length:
blocks are the lines of a matrix, tasks transform some of its columns, turn them by the place and send them on as lines, which
other tasks transform, multiply and transform back; tasks of some columns again end it. A task holds SPAN values (at least one
column or one line) of both signals.

Fingerprints (words of 32 bits) are correlated as 32 planes of +1 and -1 whose products of spectra are added before the inverse
transform: the sum at a lag is equal bits less unequal ones.

Signals: key, block (from 0), values (all but a signal's last block are full). Empty signals have no rows and no result.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.functions import signals
from tracklake.operators.records import strategy
from tracklake.sources.tables import cut

WIDTH, PLANES, AT_ONCE = 1 << 16, 32, 8
# by whether signals are bits, which become 32 planes: blocks up to which they meet in pairs, and values of a task beyond
FEW, SPAN = {False: 8, True: 64}, {False: 1 << 17, True: 1 << 14}


def blocks(rows: DataFrame, value: str, width: int = WIDTH) -> DataFrame:
    """key, block, values from rows of key, n (from 1) and a value."""
    at = F.floor((F.col("n") - 1) / width).cast("long")
    return rows.groupBy("key", at.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", value))), lambda x: x[value].cast("double" if value != "word" else "long")).alias("values"))


def spectrum(values: np.ndarray, size: int, bits: bool):
    """The spectra of a block's planes, some at once."""
    if not bits:
        yield np.fft.rfft(values.astype(float), size)[None]
        return
    for s in range(0, PLANES, AT_ONCE):
        plane = (values[None, :] >> np.arange(s, s + AT_ONCE)[:, None]) & 1
        yield np.fft.rfft(plane * 2.0 - 1, size, axis=1)


def both(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of both, written once, with side (0 or 1); and of each key in both n, m (lengths), lefts and rights (blocks)."""
    one = lambda df, side: df.select("key", F.lit(side).alias("side"), "block", "values")
    sides = cut(one(left, 0).unionByName(one(right, 1)))
    own = lambda side, x: F.when(F.col("side") == side, x)
    size, last = F.size("values"), F.col("block") + 1
    about = sides.groupBy("key").agg(F.sum(own(0, size)).alias("n"), F.sum(own(1, size)).alias("m"), F.max(own(0, last)).alias("lefts"), F.max(own(1, last)).alias("rights"))
    return sides, cut(about.where("n is not null and m is not null"))


def key_kind(df: DataFrame) -> tuple[str, pa.DataType]:
    return ("long", pa.int64()) if df.schema["key"].dataType.typeName() in ("long", "integer", "short") else ("string", pa.string())


def curve(sides: DataFrame, about: DataFrame, bits: bool, width: int) -> DataFrame:
    """Sums of products by lag, each lag once: key, start (a lag), step, values (of lags from the start on by steps).

    A lag is a left place less the right place that it meets.
    """
    kind = key_kind(sides)[0]
    few = F.greatest("lefts", "rights") <= FEW[bits]
    many = about.where(~few)
    if not many.limit(1).count():
        return added(sums(sides, about, bits, width)).select("key", "start", F.lit(1).cast("long").alias("step"), "values")
    long_ = long_sums(sides.join(many, "key"), bits, width)
    short = added(sums(sides, about.where(few), bits, width)).select(F.col("key").cast(kind), "start", F.lit(1).cast("long").alias("step"), "values")
    return short.unionByName(long_)


def by_run(batches, by: list[str]):
    """Rows (as dict and values) of Arrow batches, those in a row with the same `by` together."""

    def rows():
        for batch in batches:
            values = batch.column("values")
            for i, r in enumerate(batch.select([c for c in batch.schema.names if c != "values"]).to_pylist()):
                yield r, values[i].values.to_numpy(zero_copy_only=False)

    return groupby(rows(), lambda x: tuple(x[0][c] for c in by))


def turned(lines: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
    """The factors between the transforms of columns and lines, of a transform of n values."""
    return np.exp(-2j * np.pi / n * (lines[:, None] * columns[None, :] % n))


def long_sums(met: DataFrame, bits: bool, width: int) -> DataFrame:
    """As `curve`, for blocks with lefts, rights, n and m of their key. Value n1 * width + n2 of a signal is in line n1 and column n2;
    the matrix has lines for all lags, filled up to a length that transforms well. Of a real signal half the lines of the spectrum say all."""
    name, key_type = key_kind(met)
    span, high = SPAN[bits], max(1, SPAN[bits] // width)
    need = F.ceil((F.col("n") + F.col("m")) / width).cast("long")
    fill = F.pow(F.lit(2), F.greatest(F.lit(0), F.floor(F.log2(need)) - 3))
    met = met.withColumn("lines", (F.ceil(need / fill) * fill).cast("long")).withColumn("wide", F.greatest(F.lit(1), F.least(F.lit(width), F.floor(F.lit(span) / F.col("lines")))).cast("long"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.size("values") - 1) / F.col("wide"))), lambda c: F.struct(c.alias("part"), F.slice("values", (c * F.col("wide") + 1).cast("int"), F.col("wide").cast("int")).alias("values")))
    kept = [("key", key_type), *((c, pa.int64()) for c in ("n", "m", "lines", "wide"))]
    sent = pa.schema([*kept, *((c, pa.int64()) for c in ("high", "plane", "part")), ("values", pa.list_(pa.float64()))])
    text = f"key {name}, n long, m long, lines long, wide long, high long, plane long, part long, values array<double>"

    def row(kind, r, *rest):
        numbers = [*(r[c] for c, _ in kept), *rest[:-1]]
        values = pa.ListArray.from_arrays(pa.array([0, len(rest[-1])], pa.int32()), pa.array(rest[-1]))
        return pa.RecordBatch.from_arrays([*(pa.array([v], f.type) for v, f in zip(numbers, list(kind)[:-1], strict=True)), values], schema=kind)

    def flat(tile):
        return np.ascontiguousarray(tile).view(np.float64).ravel()

    def down(batches):
        for (_, part), rows in by_run(batches, ["key", "part"]):
            signal = None
            for r, v in rows:
                if signal is None:
                    signal = np.zeros((2, r["lines"], min(r["wide"], width - part * r["wide"])), np.int64 if bits else float)
                    there, about = np.zeros(signal.shape, bool), r
                signal[r["side"], r["block"], : len(v)], there[r["side"], r["block"], : len(v)] = v, True
            lines = np.arange(about["lines"] // 2 + 1)
            turn = turned(lines, part * about["wide"] + np.arange(signal.shape[2]), about["lines"] * width)
            for plane in range(0, PLANES if bits else 1, AT_ONCE):
                x = ((signal[None] >> np.arange(plane, plane + AT_ONCE)[:, None, None, None] & 1) * 2.0 - 1) * there if bits else signal[None]
                x = np.fft.rfft(x, axis=2) * turn
                for i, at in enumerate(range(0, len(lines), high)):
                    yield row(sent, about, i, plane, part, flat(x[:, :, at : at + high]))

    def across(batches):
        for (_, i), rows in by_run(batches, ["key", "high"]):
            total = None
            for _, own in groupby(rows, lambda x: x[0]["plane"]):
                x = None
                for r, v in own:
                    if x is None:
                        lines = np.arange(i * high, min((i + 1) * high, r["lines"] // 2 + 1))
                        x, about = np.zeros((AT_ONCE if bits else 1, 2, len(lines), width), complex), r
                    at = r["part"] * r["wide"]
                    x[..., at : at + r["wide"]] = v.view(complex).reshape(*x.shape[:3], -1)
                x = np.fft.fft(x, axis=3)
                product = (x[:, 0] * np.conj(x[:, 1])).sum(axis=0)
                total = product if total is None else total + product
            total = np.fft.ifft(total, axis=1) * np.conj(turned(lines, np.arange(width), about["lines"] * width))
            for part, at in enumerate(range(0, width, about["wide"])):
                yield row(sent, about, i, 0, part, flat(total[:, at : at + about["wide"]]))

    def up(batches):
        for (_, part), rows in by_run(batches, ["key", "part"]):
            x = None
            for r, v in rows:
                if x is None:
                    columns = part * r["wide"] + np.arange(min(r["wide"], width - part * r["wide"]))
                    x, about = np.zeros((r["lines"] // 2 + 1, len(columns)), complex), r
                x[r["high"] * high : (r["high"] + 1) * high] = v.view(complex).reshape(-1, len(columns))
            c = np.fft.irfft(x, about["lines"], axis=0)
            n, least = about["lines"] * width, about["lines"] * width - about["m"] + 1
            for j, column in enumerate(columns.tolist()):
                # lags from 0 on are the first places, those below it the last ones
                first = max(0, -((column - least) // width))
                for start, values in ((column, c[: max(0, -((column - about["n"]) // width)), j]), (first * width + column - n, c[first:, j])):
                    if len(values):
                        yield row(given, about, start, width, values)

    given = pa.schema([*kept, ("start", pa.int64()), ("step", pa.int64()), ("values", pa.list_(pa.float64()))])
    dealt = lambda df, *by: df.repartition(*by[:2]).sortWithinPartitions(*by)
    pieces = met.select(F.col("key").cast(name), "n", "m", "lines", "wide", "side", "block", F.inline(parts))
    lines = dealt(dealt(pieces, "key", "part").mapInArrow(down, text), "key", "high", "plane").mapInArrow(across, text)
    return dealt(lines, "key", "part").mapInArrow(up, f"key {name}, n long, m long, lines long, wide long, start long, step long, values array<double>").select("key", "start", "step", "values")


def sums(sides: DataFrame, about: DataFrame, bits: bool, width: int = WIDTH) -> DataFrame:
    """Sums of products by lag of blocks that meet in pairs: key, base, start (the first lag), values; up to two rows of one base,
    to be added up."""
    schema = [("base", pa.int64()), ("start", pa.int64()), ("values", pa.list_(pa.float64()))]
    met = sides.join(about.withColumn("wide", F.least(F.lit(width), F.greatest("n", "m"))), "key")
    count = F.sequence(F.lit(0).cast("long"), F.when(F.col("side") == 0, F.col("rights")).otherwise(F.col("lefts")) - 1)
    left = F.col("side") == 0
    shift = F.explode(F.transform(count, lambda k: F.when(left, F.col("block") - k).otherwise(k - F.col("block")))).alias("shift")
    met = met.select(F.col("key").cast(key_kind(sides)[0]), shift, "block", "side", "wide", "values")
    met = met.select("key", "shift", F.when(left, F.col("block")).otherwise(F.col("block") + F.col("shift")).alias("at"), "side", "wide", "values")

    def run(batches):
        held, key, total, wide, first = None, None, None, 0, None
        kind = pa.schema([pa.field("key", key_type), *schema])

        def done():
            if total is None:
                return
            c = np.fft.irfft(total, 2 * pad(wide))
            shift = key[1]
            halves = ([shift - 1, shift], [shift * width - wide, shift * width], [c[len(c) - wide :], c[:wide]])
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * 2, key_type), *(pa.array(v, f.type) for v, f in zip(halves, list(kind)[1:], strict=True))], schema=kind)

        for batch in batches:
            values = batch.column("values")
            for i, r in enumerate(batch.select(["key", "shift", "at", "side", "wide"]).to_pylist()):
                if (r["key"], r["shift"]) != key:
                    yield from done()
                    key, total, wide, first = (r["key"], r["shift"]), None, r["wide"], None
                held = values[i].values.to_numpy(zero_copy_only=False)
                if r["side"] == 0:
                    first = r["at"], held
                elif first is not None and first[0] == r["at"]:
                    for x, y in zip(spectrum(first[1], 2 * pad(wide), bits), spectrum(held, 2 * pad(wide), bits), strict=True):
                        part = (x * np.conj(y)).sum(axis=0)
                        total = part if total is None else total + part
        yield from done()

    name, key_type = key_kind(sides)
    return met.repartition("key", "shift").sortWithinPartitions("key", "shift", "at", "side").mapInArrow(run, f"key {name}, base long, start long, values array<double>")


def pad(n: int) -> int:
    return 1 << max(0, int(n - 1).bit_length())


def added(parts: DataFrame) -> DataFrame:
    """The rows of one base as one."""
    whole = F.reduce(F.collect_list("values"), F.array().cast("array<double>"), lambda s, v: F.when(F.size(s) == 0, v).otherwise(F.zip_with(s, v, lambda p, q: p + q)))
    return parts.groupBy("key", "base", "start").agg(whole.alias("values"))


def lags() -> Column:
    """x (lag, v): the sums of a row of `curve` one by one."""
    end = F.col("start") + F.col("step") * (F.size("values") - 1)
    return F.explode(F.arrays_zip(F.sequence(F.col("start"), end, F.col("step")).alias("lag"), F.col("values").alias("v"))).alias("x")


def similarity(left: DataFrame, right: DataFrame, least: int, width: int = WIDTH) -> DataFrame:
    """The best offset of two fingerprints over their whole span: key, corr, offset (the first of the largest similarity).

    All offsets within the span, the shorter length less `least`, count. A key with less than that many words has no row.
    """
    sides, about = both(left, right)
    # one word of a curve is a small row; the best of a base is found before anything is shuffled again
    rows = curve(sides, about, True, width).join(about, "key").select("key", "n", "m", lags()).select("key", "n", "m", F.col("x.lag").alias("offset"), "x.v")
    overlap = F.least("n", F.col("m") + F.col("offset")) - F.greatest(F.lit(0), "offset")
    same = (PLANES * F.col("overlap") + F.round("v").cast("long")) / 2
    inside = (F.col("overlap") >= least) & (F.abs("offset") <= F.least("n", "m") - least)
    scored = rows.withColumn("overlap", overlap).where(inside).select("key", (same / F.col("overlap") / PLANES).alias("corr"), F.col("offset").cast("int").alias("offset"))
    return scored.groupBy("key").agg(F.max_by(F.struct("corr", "offset"), F.struct("corr", -F.col("offset"))).alias("b")).select("key", "b.corr", "b.offset")


def lag(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """The lag of the largest magnitude of two signals of samples: key, lag, corr. Of equal ones the first place counts,
    lags from zero on before negative ones, as in a transform of both as a whole."""
    return peak(*both(left, right), width)


def peak(sides: DataFrame, about: DataFrame, width: int) -> DataFrame:
    rows = curve(sides, about, False, width).select("key", lags()).select("key", "x.lag", F.round(F.abs("x.v"), 9).alias("corr"))
    best = rows.groupBy("key").agg(F.max_by(F.struct("lag", "corr"), F.struct("corr", (F.col("lag") >= 0), -F.col("lag"))).alias("b"))
    return best.select("key", "b.lag", "b.corr")


def chosen_lag(left: DataFrame, right: DataFrame, memory: float, width: int = WIDTH) -> DataFrame:
    """key, strategy, lag: signals whose whole transform fits the memory are correlated in one row, others in blocks.

    Both ways give the same lag; the size of the transform decides, pair by pair.
    """
    sides, about = both(left, right)
    about = about.withColumn("strategy", strategy(F.col("n"), F.col("m"), memory))
    one = F.col("strategy") == "full"
    whole = lambda side: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("block", "values")))), lambda x: x["values"]))
    full = sides.join(about.where(one).select("key"), "key").groupBy("key").agg(whole(0).alias("x"), whole(1).alias("y")).select("key", F.size("x").alias("length"), signals.fft_peak("x", "y").alias("p"))
    # a lag is below the left signal's length; what lies beyond is a negative one
    full = full.select("key", F.when(F.col("p.peak") >= F.col("length"), F.col("p.peak") - F.col("p.n")).otherwise(F.col("p.peak")).alias("lag"))
    long_ = peak(sides, about.where(~one).drop("strategy"), width).select(F.col("key").cast(full.schema["key"].dataType), "lag")
    return about.join(full.unionByName(long_), "key").select("key", "strategy", "lag")
