"""Bad ranges between recordings, drift, and alignment of frame hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.scalars import tempo
from tracklake.operators import spread

LOW, HIGH, COHERENT = 0.85, 0.95, 0.12


def bad_ranges(rows: DataFrame, group: str) -> DataFrame:
    """Runs of segments under the group's threshold or with several offsets, a segment wider on each side.

    rows: group, segment, fidelity, offsets.
    """
    limit = rows.groupBy(group).agg(F.least(F.greatest(F.avg("fidelity") - 0.75 * (F.max("fidelity") - F.min("fidelity")), F.lit(LOW)), F.lit(HIGH)).alias("limit"), F.min("segment").alias("least"), F.max("segment").alias("most"), F.count("*").alias("_rows"))
    marked = spread.looked_up_by_size(rows, group, limit, "_rows").withColumn("bad", (F.col("fidelity") < F.col("limit")) | (F.col("offsets") > 1))
    marked = spread.running(marked, [group], "segment", sums={"island": F.when(F.col("bad"), 0).otherwise(1)}, cuts=spread.borders(rows, "segment"))
    return marked.where("bad").groupBy(group, "island").agg(F.greatest(F.min("segment") - 1, F.min("least")).alias("begin"), F.least(F.max("segment") + 1, F.min("most")).alias("end"), F.count("*").alias("segments")).drop("island")


def drift(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Least-squares slope (0 where x doesn't vary), intercept, mean squared residual and tempo of each group."""
    both = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = rows.groupBy(group).agg(both.alias("n"), F.regr_slope(y, x).alias("s"), F.regr_avgx(y, x).alias("x"), F.regr_avgy(y, x).alias("y"), F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"))
    flat = F.col("n") * F.col("sxx") < 1e-12
    s = s.withColumn("slope", F.when(flat, 0.0).otherwise(F.col("s"))).withColumn("intercept", F.col("y") - F.col("slope") * F.col("x"))
    left = F.when(flat, F.col("syy")).otherwise(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)))
    s = s.withColumn("mse", left / F.col("n"))
    return s.select(group, "slope", "intercept", "mse", tempo(F.col("slope"), F.col("mse") <= COHERENT).alias("tempo"))


def banded_nearest(left: DataFrame, right: DataFrame, band: int, own: bool = True) -> DataFrame:
    """For each frame i of left the frame j of right within the band whose hash differs least, the lowest of equals.

    Rows: clip, frame, hash. Each left frame meets only the frames of its band, joined by (clip, frame). own: false
    leaves the frame of the same number out, for a clip against itself.
    """
    l = left.select("clip", F.col("frame").alias("i"), F.col("hash").alias("x"), F.explode(F.sequence(F.col("frame") - band, F.col("frame") + band)).alias("j"))
    l = l if own else l.where("i <> j")
    r = right.select("clip", F.col("frame").alias("j"), F.col("hash").alias("y"))
    d = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))).cast("long")
    return l.join(r, ["clip", "j"]).withColumn("d", d).groupBy("clip", "i").agg(F.min_by(F.struct("j", "d"), F.struct("d", "j")).alias("m")).select("clip", "i", "m.j", "m.d")


def trailing_sum(rows: DataFrame, width: int) -> DataFrame:
    """Adds the sum of d over the last `width` frames of the clip."""
    return spread.trailing_sum(rows, "clip", "i", "d", width, "total")


def widest_gap(rows: DataFrame, half: int) -> DataFrame:
    """The first largest total of each clip, widened by half on each side and clamped to the clip."""
    s = rows.groupBy("clip").agg(F.max_by("i", F.struct("total", -F.col("i"))).alias("peak"), F.min("i").alias("least"), F.max("i").alias("most"))
    return s.select("clip", "peak", F.greatest(F.col("peak") - half, "least").alias("begin"), F.least(F.col("peak") + half, "most").alias("end"))
