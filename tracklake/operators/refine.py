"""Cuts made exact (frames, else scene changes, else sound), spliced tracks, and the verdict on a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.operators.cuts import COHERENT, LOW, bad_ranges

# Fixed values in seconds: least length of a range, and what a spliced track takes before and after a cut.
LEAST, LEAD, OVERLAP, SKIP, TAIL, NEAR = 0.5, 0.5, 0.05, 0.01, 5.0, 0.005


def length(begin: Column, end: Column) -> Column:
    return F.greatest(F.lit(LEAST), end - begin)


def by_frames(begin: Column, end: Column, gap_begin: Column, gap_end: Column, fps: Column) -> Column:
    """(start_s, end_s) of a gap counted in frames from the padded begin of the range."""
    padded = F.greatest(F.lit(0.0), begin - F.least(F.lit(4.0), length(begin, end) / 2))
    return F.when(gap_begin.isNotNull() & gap_end.isNotNull(), F.struct((padded + gap_begin / F.bround(fps, 0)).alias("start_s"), (padded + gap_end / F.bround(fps, 0)).alias("end_s")))


def by_scene(begin: Column, end: Column, times: Column) -> Column:
    """(start_s, end_s) about the middle one of the scene changes found, within the range."""
    middle = F.get(times, F.floor(F.size(times) / 2).cast("int"))
    band = F.greatest(F.lit(0.2), F.least(F.lit(2.0), length(begin, end) * 0.2))
    return F.when(middle.isNotNull(), F.struct(F.greatest(begin, middle - band).alias("start_s"), F.least(end, middle + band).alias("end_s")))


def by_sound(begin: Column, end: Column, lag_s: Column) -> Column:
    """(start_s, end_s) moved by the lag of the sound about the range; an unknown lag moves nothing."""
    off = F.coalesce(lag_s, F.lit(0.0))
    return F.struct((begin + off).alias("start_s"), (end + off).alias("end_s"))


def refined(ranges: DataFrame) -> DataFrame:
    """Adds method, start_s, end_s, start_frame and end_frame, from the first of three ways that has a result.

    ranges: begin_s, end_s, fps_main, fps_target, gap_begin, gap_end (frames), scene_s (array), lag_s; each may be null.
    Frames count only where both rates are known and equal. A range without begin or end stays without times.
    """
    begin, end = F.col("begin_s"), F.col("end_s")
    fps = F.coalesce("fps_target", "fps_main", F.lit(25.0))
    known = begin.isNotNull() & end.isNotNull()
    frames = F.when(F.abs(F.col("fps_main") - F.col("fps_target")) < 1e-6, by_frames(begin, end, F.col("gap_begin"), F.col("gap_end"), fps))
    ways = ranges.withColumns({"_frames": frames, "_scene": by_scene(begin, end, F.col("scene_s")), "_sound": by_sound(begin, end, F.col("lag_s"))})
    at = F.when(known, F.coalesce("_frames", "_scene", "_sound"))
    method = F.when(~known, None).when(F.col("_frames").isNotNull(), "frames").when(F.col("_scene").isNotNull(), "scene").otherwise("sound")
    out = ways.withColumns({"method": method, "_at": at}).withColumns({"start_s": F.col("_at.start_s"), "end_at_s": F.col("_at.end_s")})
    return out.withColumns({"start_frame": F.bround(F.col("start_s") * fps, 0).cast("long"), "end_frame": F.bround(F.col("end_at_s") * fps, 0).cast("long")}).drop("_frames", "_scene", "_sound", "_at")


def verdict(segments: DataFrame, ranges: DataFrame, group: str) -> DataFrame:
    """One row a group: mean fidelity, number of cuts, incompatible and why (null where it is compatible).

    segments: group, fidelity, offsets. ranges: group, method, lag_s. Groups that only have ranges lack measurements.
    Offsets that conflict in every segment are settled if the lags of the ranges hardly vary.
    """
    s = segments.groupBy(group).agg(F.avg("fidelity").alias("mean_fidelity"), F.bool_and(F.col("offsets") > 1).alias("_torn"))
    r = ranges.groupBy(group).agg(F.count("*").alias("_cuts"), F.count_if(F.col("method").isNull()).alias("_open"), F.var_pop("lag_s").alias("_spread"))
    both = s.join(r, group, "full").withColumn("cuts", F.coalesce("_cuts", F.lit(0)))
    reason = (
        F.when(F.col("mean_fidelity").isNull(), "no measurement")
        .when(F.col("cuts") == 0, None)
        .when(F.col("_torn") & ~F.coalesce(F.col("_spread") <= COHERENT, F.lit(False)), "conflicting offsets")
        .when(F.col("_open") > 0, "range not refined")
        .when(F.col("mean_fidelity") < LOW, "low fidelity")
    )
    return both.select(group, "mean_fidelity", "cuts", reason.isNotNull().alias("incompatible"), reason.alias("reason"))


def run(segments: DataFrame, evidence: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """The whole way from measured segments to a verdict: refined ranges of each recording, and its verdict.

    segments: group, segment, fidelity, offsets. evidence: group, begin (segment a bad range begins at), and what is known
    of it: begin_s, end_s, fps_main, fps_target, gap_begin, gap_end, scene_s, lag_s; a range without evidence stays open.
    """
    found = bad_ranges(segments, group).select(group, "begin", "end")
    ranges = refined(found.join(evidence, [group, "begin"], "left"))
    return ranges, verdict(segments, ranges, group)


def pieces(cuts: DataFrame) -> DataFrame:
    """What a spliced track is made of: piece 0 ends just after the cut's start, piece 1 follows its end.

    cuts: file, cut, start_s, end_s. A cut at the very start has no piece 0.
    """
    before = F.struct(F.lit(0).alias("piece"), F.greatest(F.lit(0.0), F.col("start_s") - LEAD).alias("from_s"), (F.col("start_s") + OVERLAP).alias("to_s"))
    first = F.greatest(F.lit(0.0), F.col("end_s") + SKIP)
    after = F.struct(F.lit(1).alias("piece"), first.alias("from_s"), (first + TAIL).alias("to_s"))
    two = F.when(F.col("start_s") - OVERLAP > NEAR, F.array(before, after)).otherwise(F.array(after))
    return cuts.where("start_s is not null and end_s is not null").select("file", "cut", F.inline(two))


def spliced(blocks: DataFrame, cuts: DataFrame, rate: int, width: int) -> DataFrame:
    """(file, cut, samples): the samples before and after each cut, in order.

    blocks: file, block (from 0), samples (`width` of them, the last may be shorter). Only the blocks that a piece touches
    are joined, by (file, block), so no recording is held whole; a result has at most LEAD + OVERLAP + TAIL seconds.
    """
    p = pieces(cuts).withColumns({"_a": F.round(F.col("from_s") * rate).cast("long"), "_b": F.round(F.col("to_s") * rate).cast("long")})
    p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.greatest(F.col("_b") - 1, F.col("_a")) / width))))
    met = p.join(blocks.select("file", F.col("block").cast("long").alias("block"), "samples"), ["file", "block"])
    low = F.greatest(F.col("_a") - F.col("block") * width, F.lit(0))
    part = F.slice("samples", (low + 1).cast("int"), F.greatest(F.least(F.col("_b") - F.col("block") * width, F.lit(width)) - low, F.lit(0)).cast("int"))
    parts = met.groupBy("file", "cut").agg(F.array_sort(F.collect_list(F.struct("piece", "block", part.alias("part")))).alias("_parts"))
    return parts.select("file", "cut", F.flatten(F.col("_parts.part")).alias("samples"))
