"""Offsets probed at places of two recordings: drift, a step between two offsets, and bad ranges whose offsets agree.

Probes are windows of both recordings; `measuring.fine` correlates their samples. Offsets are in seconds, positive where
the second recording is later.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.operators import measuring, spread
from tracklake.operators.cuts import COHERENT, drift

# fixed values: seconds of a window, number of probes
LEAST_S, MOST_S, PROBES, LOCAL = 10.0, 30.0, 5, 3


def window(seconds: Column, least: float = LEAST_S, most: float = MOST_S) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), seconds))


def spots(files: DataFrame, begin: Column, length: Column, n: int, width: Column) -> DataFrame:
    """files with n rows each: segment (from 0), center_s at (segment + 1) / (n + 1) of the length, and the window about it,
    begin_s and length_s, which doesn't begin before 0."""
    at = files.withColumns({"_begin": begin, "_length": length, "length_s": width}).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    at = at.withColumn("center_s", F.col("_begin") + (F.col("segment") + 1) * F.col("_length") / (n + 1)).drop("_begin", "_length")
    return at.withColumn("begin_s", F.greatest(F.lit(0.0), F.col("center_s") - F.col("length_s") / 2))


def spread_over(files: DataFrame, n: int = PROBES, least: float = LEAST_S, most: float = MOST_S) -> DataFrame:
    """Probes over whole recordings (match, duration_s); three at least. Without a duration above 0 there are none."""
    whole = files.where("duration_s > 0").select("match", "duration_s")
    return spots(whole, F.lit(0.0), F.col("duration_s"), max(3, n), window(F.col("duration_s") / 10, least, most)).drop("duration_s")


def within(ranges: DataFrame, least: float = LEAST_S, most: float = MOST_S) -> DataFrame:
    """Three probes in each range (match, range_, start_s, end_s); segment is unique in the match, three times the range's
    number (from 0) and one of 0 to 2."""
    length = F.greatest(F.lit(0.5), F.col("end_s") - F.col("start_s"))
    known = ranges.where("start_s is not null and end_s is not null").select("match", "range_", "start_s", "end_s")
    at = spots(known, F.col("start_s"), length, LOCAL, window(length * 0.6, least, most))
    return at.withColumn("segment", F.col("range_") * LOCAL + F.col("segment")).select("match", "range_", "segment", "center_s", "begin_s", "length_s")


def measured(t: measuring.Tracks, grid: DataFrame) -> DataFrame:
    """grid (match, segment, center_s, begin_s, length_s) with each pair of tracks' offset: pair and delay_s."""
    asked = measuring.pairs_of(t.samples).withColumn("delay_ms", F.lit(0.0))
    found = measuring.fine(t, asked, grid.select("match", "segment", "begin_s", "length_s"))
    return grid.join(found, ["match", "segment"])


def drifting(probed: DataFrame) -> DataFrame:
    """slope, intercept, mse and tempo of each match's offsets over the probes' centers."""
    return drift(probed, "match", "center_s", "delay_s")


def step(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """One offset or a step between two: group, n, kind, at, before, after, mse.

    Of all places between two probes the one counts whose two means leave the least squares (of equal ones the first); at is
    the last x before it. kind is constant where one mean leaves at most COHERENT a row, else step where the two do, else
    unsettled. Sums up to each place come from pieces of the group (`spread.running`), so a group may have any size. A
    null in x or y drops the row.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(group, x, F.col(y).cast("double").alias("_y"))
    # squares are summed about the mean of all rows, which keeps their differences exact for large offsets
    level = known.agg(F.avg("_y")).first()[0] or 0.0
    moved = known.groupBy(group, x).agg(F.count("*").alias("_c"), F.sum(F.col("_y") - level).alias("_v"), F.sum((F.col("_y") - level) ** 2).alias("_w"))
    whole = moved.groupBy(group).agg(F.sum("_c").alias("n"), F.sum("_v").alias("_all"), F.sum("_w").alias("_squares"), F.count("*").alias("_rows"))
    up = spread.running(moved, [group], x, sums={"_k": F.col("_c"), "_s": F.col("_v"), "_q": F.col("_w")})
    both = spread.looked_up_by_size(up.select(group, x, "_k", "_s", "_q"), group, whole, "_rows")
    rest, left = F.col("n") - F.col("_k"), F.col("_all") - F.col("_s")
    cost = F.col("_squares") - F.col("_s") * F.col("_s") / F.col("_k") - F.when(rest > 0, left * left / rest).otherwise(0.0)
    placed = both.withColumns({"_cost": F.round(F.greatest(cost, F.lit(0.0)), 9), "_before": F.col("_s") / F.col("_k") + level, "_after": F.when(rest > 0, left / rest) + level, "_open": rest > 0})
    best = placed.where("_open").groupBy(group).agg(F.min_by(F.struct(F.col(x).alias("at"), "_before", "_after", "_cost"), F.struct("_cost", x)).alias("_b"))
    out = whole.join(best, group, "left").withColumn("_one", F.greatest(F.col("_squares") - F.col("_all") * F.col("_all") / F.col("n"), F.lit(0.0)) / F.col("n"))
    kind = F.when(F.col("_one") <= COHERENT, "constant").when(F.col("_b._cost") / F.col("n") <= COHERENT, "step").otherwise("unsettled")
    out = out.withColumn("kind", kind)
    stepped = F.col("kind") == "step"
    return out.select(
        group, "n", "kind", F.when(stepped, F.col("_b.at")).alias("at"), F.when(stepped, F.col("_b._before")).otherwise(F.col("_all") / F.col("n") + level).alias("before"),
        F.when(stepped, F.col("_b._after")).alias("after"), F.when(stepped, F.col("_b._cost") / F.col("n")).otherwise(F.col("_one")).alias("mse"))


def agreeing(probed: DataFrame) -> DataFrame:
    """match, range_, spread and agrees: whether a range's probed offsets vary by no more than COHERENT (fewer than two do)."""
    s = probed.groupBy("match", "range_").agg(F.count("delay_s").alias("_n"), F.var_pop("delay_s").alias("spread"))
    return s.select("match", "range_", "spread", ((F.col("_n") < 2) | (F.col("spread") <= COHERENT)).alias("agrees"))


def settled(torn: DataFrame, ranges: DataFrame) -> DataFrame:
    """Matches all of whose segments have several offsets, with settled: true where every range's probes agree.

    torn: match, all_torn; ranges: match, agrees. A match without ranges has nothing that disagrees.
    """
    found = ranges.groupBy("match").agg(F.bool_and("agrees").alias("_all"))
    return torn.where("all_torn").select("match").join(found, "match", "left").select("match", F.coalesce("_all", F.lit(True)).alias("settled"))
