"""Delays of two files from their tracks to a decision: measure, decide, shift what isn't settled, measure again.

Tracks come whole: words (fingerprints) and samples as rows of match, side (1 or 2), track, n (from 0) and value. Segments of
both sides are cut out by joins on the place, the second side's moved by the delay to try, and correlated pair by pair.
Every round measures only the pairs and matches that the decisions before it left open, so rounds shrink, and one without any
is left out; each measurement and each summary of one is written once and shared by what reads it. Delays reach two segments
beyond the grid at most (`reach`), so callers may leave out other places (`within`).

1. All pairs of tracks are measured by their words. Pairs with two near delays are measured by samples in the middle of both.
2. Matches with two near delays are measured in the middle of them.
3. With that delay applied, all pairs in use are measured again (test 2), and once more where test 2 adds a delay (test 3).
4. Samples settle the rest of the delay; short matches by one long window. Both stages must agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.operators import correlation, delays
from tracklake.sources.tables import cut

PAIR = ["match", "pair"]


@dataclass(frozen=True)
class Tracks:
    """words and samples: match, side, track, n, value; grid: match, segment, begin_s, length_s; places a second of each."""

    words: DataFrame
    samples: DataFrame
    grid: DataFrame
    word_rate: float
    sample_rate: float

    @property
    def ms_per_word(self) -> int:
        return int(1000 / self.word_rate)


def pairs_of(tracks: DataFrame) -> DataFrame:
    """match, pair (i-j), i, j: each track of the one side with each of the other."""
    side = lambda s, name: tracks.where(F.col("side") == s).select("match", F.col("track").alias(name)).distinct()
    both = side(1, "i").join(side(2, "j"), "match")
    return both.select("match", F.concat_ws("-", "i", "j").alias("pair"), "i", "j")


def windows(rows: DataFrame, side: int, track: str, asked: DataFrame, grid: DataFrame, rate: float, name: str) -> DataFrame:
    """key (of match, pair and segment), block and values of the segments of one side.

    asked: match, pair, i, j, delay_ms; side 2 is read that much later. Places before the start or after the end are 0.
    """
    moved = F.bround(F.col("delay_ms") * rate / 1000, 0).cast("long") if side == 2 else F.lit(0)
    spots = asked.join(grid, "match").select(
        "match", F.col(track).alias("track"), F.struct("match", "pair", "segment").alias("key"), F.floor(F.col("begin_s") * rate).cast("long").alias("from"), moved.alias("moved"), F.floor(F.col("length_s") * rate).cast("long").alias("length")
    )
    spots = spots.select("match", "track", "key", "from", "moved", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("p", "_")).withColumn("n", F.col("from") + F.col("moved") + F.col("p"))
    found = spots.join(rows.where(F.col("side") == side).select("match", "track", "n", F.col("value").alias(name)), ["match", "track", "n"], "left")
    return correlation.blocks(found.select(F.to_json("key").alias("key"), (F.col("p") + 1).alias("n"), F.coalesce(name, F.lit(0)).alias(name)), name)


def reach(grid: DataFrame) -> DataFrame:
    """match, low_s, high_s: the seconds that `decided` may read. A delay by words is less than a segment; test 2 may add as much again,
    and samples an eighth of a second. The long window begins with the first segment."""
    g = grid.groupBy("match").agg(F.min("begin_s").alias("_b"), F.max("length_s").alias("_l"), F.max(F.col("begin_s") + F.col("length_s")).alias("_e"), F.count("*").cast("int").alias("_n"))
    beyond = 2 * F.col("_l") + 1
    return g.select("match", (F.col("_b") - beyond).alias("low_s"), (F.greatest("_e", F.col("_b") + delays.long_window(F.col("_l"), F.col("_n"))) + beyond).alias("high_s"))


def within(rows: DataFrame, bounds: DataFrame, on: list[str], rate: float) -> DataFrame:
    """rows joined with bounds by `on`, those whose place n lies in low_s to high_s. The ends of all bounds are literals, which
    reading can skip by."""
    b = bounds.withColumns({"_from": F.floor(F.col("low_s") * rate) - 2, "_to": F.ceil(F.col("high_s") * rate) + 2}).drop("low_s", "high_s")
    least, most = b.agg(F.min("_from"), F.max("_to")).first()
    return rows.where(F.col("n").between(F.lit(least), F.lit(most))).join(b, on).where("n between _from and _to").drop("_from", "_to")


def reached(t: Tracks) -> Tracks:
    """The tracks without the places that `decided` can't read."""
    bounds = cut(reach(t.grid))
    own = lambda rows, rate: cut(within(rows, bounds, ["match"], rate))
    return Tracks(own(t.words, t.word_rate), own(t.samples, t.sample_rate), t.grid, t.word_rate, t.sample_rate)


KEY = "match long, pair string, segment long"


def coarse(t: Tracks, asked: DataFrame) -> DataFrame:
    """match, pair, segment, fidelity and delay_ms by words."""
    asked = cut(asked)
    if not asked.head(1):
        return asked.sparkSession.createDataFrame([], f"{KEY}, fidelity double, delay_ms long")
    best = correlation.similarity(*(windows(t.words, s, c, asked, t.grid, t.word_rate, "word") for s, c in ((1, "i"), (2, "j"))), delays.LEAST_OVERLAP)
    return cut(best.select(F.from_json("key", KEY).alias("k"), F.col("corr").alias("fidelity"), (-F.col("offset") * t.ms_per_word).cast("long").alias("delay_ms")).select("k.*", "fidelity", "delay_ms"))


def fine(t: Tracks, asked: DataFrame, grid: DataFrame | None = None) -> DataFrame:
    """match, pair, segment and delay_s by samples."""
    asked = cut(asked)
    if not asked.head(1):
        return asked.sparkSession.createDataFrame([], f"{KEY}, delay_s double")
    found = correlation.lag(*(windows(t.samples, s, c, asked, t.grid if grid is None else grid, t.sample_rate, "sample") for s, c in ((1, "i"), (2, "j"))))
    return cut(found.select(F.from_json("key", KEY).alias("k"), (-F.col("lag") / t.sample_rate).alias("delay_s")).select("k.*", "delay_s"))


def decided(t: Tracks) -> DataFrame:
    """match, delay_ms (of the words), total_ms (with what samples add; null where none holds), reason (null if it holds)."""
    pairs = cut(pairs_of(t.words))
    at = lambda rows, delay: rows.select("match", "pair", "i", "j", delay.cast("double").alias("delay_ms"))
    middle = lambda: delays.middle(F.col("low"), F.col("high"))

    first = coarse(t, at(pairs, F.lit(0)))
    span = first.groupBy(*PAIR).agg(F.min("delay_ms").alias("low"), F.max("delay_ms").alias("high"))
    one = cut(delays.stage_one(first, tuple(PAIR)))
    near = one.where("verdict = 'adjust'").select(*PAIR).join(span, PAIR).join(pairs, PAIR)
    each = fine(t, at(near, middle()))
    # a pair by itself stands for a match here
    alone = delays.fine_delay(each.select(F.to_json(F.struct(*PAIR)).alias("match"), F.lit(0).alias("pair"), "segment", "delay_s"))
    fine_pair = cut(alone.select(F.from_json("match", "match long, pair string").alias("k"), "delay_s").select("k.*", "delay_s"))
    none = fine_pair.select("match", "delay_s").limit(0)
    begun = cut(delays.combined(first, fine_pair, none, one))
    used = lambda rows, delay: at(rows.join(pairs, "match").where(~F.array_contains("ignored", F.col("pair"))), delay)
    unsettled = begun.where("reason = 'not settled'")
    fine_match = cut(delays.fine_delay(fine(t, used(unsettled, middle()))).select("match", "delay_s"))
    start = cut(delays.combined(first, fine_pair, fine_match, one))

    held = start.where("delay_ms is not null")
    second = coarse(t, used(held, F.col("delay_ms")))
    two = cut(delays.stage_check(second, keys=tuple(PAIR)))
    tried = cut(delays.rechecked(start, second, None, two))
    open_ = tried.where("test = 3").select("match", "more").join(start.select("match", "ignored", "delay_ms"), "match")
    third = coarse(t, used(open_, F.col("delay_ms") + F.col("more")))
    checked = cut(delays.rechecked(start, second, third if third.head(1) else None, two).select("match", F.col("delay_ms").alias("ms")))

    held = checked.where("ms is not null").join(start.select("match", "ignored"), "match")
    by_segment = fine(t, used(held, F.col("ms")))
    about = t.grid.groupBy("match").agg(F.min("begin_s").alias("begin_s"), F.max("length_s").alias("length_s"), F.count("*").cast("int").alias("segments"))
    seconds: Column = delays.long_window(F.col("length_s"), F.col("segments"))
    long_ = about.select("match", F.lit(0).cast("long").alias("segment"), "begin_s", seconds.cast("double").alias("length_s")).where("length_s is not null")
    settled = delays.fine_delay(by_segment, fine(t, used(held, F.col("ms")), long_))
    out = start.select("match", "delay_ms", F.col("reason").alias("why")).join(checked, "match", "left").join(settled.select("match", "delay_s", F.col("reason").alias("fine_why")), "match", "left")
    total = delays.agreed(F.col("ms"), F.col("delay_s"))
    reason = F.when(F.col("why").isNotNull(), F.col("why")).when(F.col("ms").isNull(), "not confirmed").when(F.col("delay_s").isNull(), F.col("fine_why")).when(total.isNull(), "stages disagree")
    return out.select("match", F.col("ms").alias("delay_ms"), F.round(total, 6).alias("total_ms"), reason.alias("reason"))
