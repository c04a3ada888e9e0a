"""Repeated delay measurements turned into decisions, as decision tables over measurement rows.

Rows: pair, segment, fidelity, delay_ms. A second and third measurement come from the caller, as rows
of the same shape; nothing here measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.scalars import bit_similarity
from tracklake.operators.spread import borders, running
from tracklake.sources.tables import cut

# Fixed values of the decision rules: milliseconds, seconds and shares.
LEAST_OVERLAP = 32
NEAR_MS, CHECK_MS, AGREE_MS, SPREAD_S = 127, 128, 500, 0.004
FIRST_MEAN, SECOND_MEAN, GOOD, BAD, SEGMENT_GOOD, BAD_SHARE = 0.70, 0.90, 0.90, 0.75, 0.85, 0.25


def fidelity(points: DataFrame) -> DataFrame:
    """Adds the bit similarity of columns x and y."""
    return points.withColumn("fidelity", bit_similarity(F.col("x"), F.col("y")))


def curve(pairs: DataFrame, span: int, least: int) -> DataFrame:
    """Similarity of columns x and y at each offset -span .. span; null where fewer than `least` words overlap."""
    at = pairs.withColumn("offset", F.explode(F.sequence(F.lit(-span), F.lit(span))))
    x = F.when(F.col("offset") > 0, F.expr("slice(x, offset + 1, greatest(size(x) - offset, 0))")).otherwise(F.col("x"))
    y = F.when(F.col("offset") < 0, F.expr("slice(y, 1 - offset, greatest(size(y) + offset, 0))")).otherwise(F.col("y"))
    n = F.least(F.size("x"), F.size("y"))
    return at.withColumns({"x": x, "y": y}).withColumn("corr", F.when(n >= least, bit_similarity(F.col("x"), F.col("y")))).drop("x", "y")


def curve_by_word(left: DataFrame, right: DataFrame, span: int, least: int) -> DataFrame:
    """key, offset, overlap and corr of two fingerprints of any length, as word rows (key, n, word).

    Each word of left meets that of right `offset` places before it, joined by (key, n), so no fingerprint is held whole.
    corr is null where fewer than `least` words overlap.
    """
    at = left.select("key", "word", F.explode(F.sequence(F.lit(-span), F.lit(span))).alias("offset"), "n").withColumn("n", F.col("n") - F.col("offset"))
    met = at.join(right.select("key", "n", F.col("word").alias("_y")), ["key", "n"])
    same = F.lit(32) - F.bit_count(F.col("word").bitwiseXOR(F.col("_y")))
    sums = met.groupBy("key", "offset").agg(F.count("*").alias("overlap"), F.sum(same).alias("_same"))
    return sums.select("key", "offset", "overlap", F.when(F.col("overlap") >= least, F.col("_same") / F.col("overlap") / 32).alias("corr"))


def span_of(left: Column, right: Column, least: int = LEAST_OVERLAP) -> Column:
    """How far two fingerprints of these lengths may be shifted so that `least` words overlap; null where they never do."""
    return F.when(F.least(left, right) >= least, F.least(left, right) - least)


def located(best: DataFrame, seconds: Column, words: Column) -> DataFrame:
    """Adds ms_per_word (whole) and delay_ms, the negated offset in milliseconds, to rows of offset."""
    return best.withColumn("ms_per_word", (seconds / words * 1000).cast("long")).withColumn("delay_ms", -F.col("offset") * F.col("ms_per_word"))


def best_offset(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The first offset of the largest similarity."""
    return curves.where("corr is not null").groupBy(*keys).agg(F.max_by(F.struct("corr", "offset"), F.struct("corr", -F.col("offset"))).alias("m")).select(*keys, "m.corr", "m.offset")


def summary(rows: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """One row a pair (keys): distinct delays, mean fidelity, ends, bad share, changes and the longest run.

    What depends on the order comes from summaries of its pieces (`spread.running`), so a pair may have any number of rows.
    """
    rows = cut(rows.select(*keys, "segment", "fidelity", "delay_ms"))
    cuts = borders(rows, "segment")
    seen = running(rows, list(keys), "segment", lags={"last": F.col("delay_ms")}, mins={"worst": F.col("fidelity")}, cuts=cuts)
    seen = seen.withColumns({"changed": F.coalesce((F.col("delay_ms") != F.col("last")).cast("long"), F.lit(0)), "weak": F.coalesce(F.least("fidelity", "worst") < GOOD, F.lit(False))})
    seen = cut(running(seen, list(keys), "segment", sums={"run": F.col("changed")}, cuts=cuts))
    runs = seen.groupBy(*keys, "run").agg(F.min("delay_ms").alias("d"), F.count("*").alias("n"))
    runs = runs.groupBy(*keys).agg(F.max_by("d", F.struct("n", -F.col("run"))).alias("majority"))
    # the delay seen first is that of the head; all rows but its good ones are bad
    kinds = rows.groupBy(*keys, "delay_ms").agg(F.count_if(F.col("fidelity") >= SEGMENT_GOOD).alias("_good"), F.min("segment").alias("_at"))
    kinds = kinds.groupBy(*keys).agg(F.count("delay_ms").alias("distinct"), F.min_by("_good", "_at").alias("_good"))
    out = seen.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("fidelity").alias("sum_fidelity"),
        F.min("delay_ms").alias("low"), F.max("delay_ms").alias("high"), F.avg("fidelity").alias("mean_fidelity"),
        F.min_by("delay_ms", "segment").alias("head"), F.max_by("delay_ms", "segment").alias("tail"),
        F.sum(((F.col("changed") == 1) & F.col("weak")).cast("long")).alias("changes"),
        F.max((F.col("fidelity") > GOOD).cast("long")).alias("any_good"), F.max((F.col("fidelity") < BAD).cast("long")).alias("any_bad"))
    return out.join(kinds, list(keys)).withColumn("bad_share", 1 - F.col("_good") / F.col("n")).drop("_good").join(runs, list(keys))


def stage_one(rows: DataFrame, keys: tuple[str, ...] = ("pair",)) -> DataFrame:
    """Test 1: verdict accept, adjust (two near delays, to be settled by a finer measurement) or ignore; delay_ms."""
    one = F.col("distinct") == 1
    near = (F.col("distinct") == 2) & (F.col("high") - F.col("low") < NEAR_MS) & (F.col("mean_fidelity") >= FIRST_MEAN)
    steady = near & (F.col("head") == F.col("tail")) & (F.col("bad_share") <= BAD_SHARE)
    verdict = F.when(one | steady, "accept").when(near, "adjust").otherwise("ignore")
    delay = F.when(one | steady, F.col("head")).when(near, F.col("low") + F.bround((F.col("high") - F.col("low")) / 2, 0).cast("long"))
    return summary(rows, keys).select(*keys, "distinct", "mean_fidelity", "bad_share", verdict.alias("verdict"), delay.cast("long").alias("delay_ms"))


def stage_check(rows: DataFrame, strict: bool = False, keys: tuple[str, ...] = ("pair",), over: str | None = None) -> DataFrame:
    """Test 2 on measurements repeated with the first delay applied; strict: test 3, which lets no change pass.

    over: the column that pairs belong to, where the mean fidelity is that of all its pairs up to this one.
    """
    one = F.col("distinct") == 1
    close = (F.col("distinct") == 2) & (F.col("high") - F.col("low") < CHECK_MS)
    near = close & (F.col("mean_fidelity") >= SECOND_MEAN)
    ends = near & (F.col("head") == F.col("tail"))
    torn = near & ((F.col("changes") > 0) if strict else (F.col("changes") > 1) & (F.col("any_good") == 1) & (F.col("any_bad") == 1))
    still = F.lit(False) if strict else close & (F.col("mean_fidelity") >= BAD) & ((F.col("low") == 0) | (F.col("high") == 0))
    verdict = F.when(one | ends, "accept").when(torn, "incompatible").when(near | still, "accept").otherwise("incompatible")
    delay = F.when(one | ends, F.col("head")).when(torn, None).when(near, F.col("majority")).when(still, 0)
    s = summary(rows, keys)
    if over:
        w = Window.partitionBy(over).orderBy("pair")
        s = s.withColumn("mean_fidelity", F.sum("sum_fidelity").over(w) / F.sum("n").over(w))
    return s.select(*keys, "distinct", "low", "high", "mean_fidelity", "changes", "majority", verdict.alias("verdict"), delay.cast("long").alias("delay_ms"))


def stage_two(rows: DataFrame) -> DataFrame:
    """Fine delays (pair, segment, delay_s): all are kept if they hardly vary, both ends if those agree, else none."""
    s = rows.groupBy("pair").agg(F.count("*").alias("n"), F.var_samp("delay_s").alias("spread"), F.min_by("delay_s", "segment").alias("head"), F.max_by("delay_s", "segment").alias("tail"), F.avg("delay_s").alias("mean_s"))
    calm = (F.col("n") == 1) | (F.col("spread") < SPREAD_S)
    ends = F.abs(F.col("head") - F.col("tail")) < SPREAD_S
    delay = F.when(calm, F.col("mean_s")).when(ends, (F.col("head") + F.col("tail")) / 2)
    return s.select("pair", "n", F.when(calm, "all").when(ends, "ends").otherwise("fail").alias("verdict"), delay.alias("delay_s"))


def measured_pairs(left: DataFrame, right: DataFrame, ignored: DataFrame) -> DataFrame:
    """One row for each track of one file, track of the other and segment, but for the pairs to ignore.

    left, right: match, track, segment, words; ignored: match, i, j. Tracks meet segment by segment.
    """
    a = left.select("match", F.col("track").alias("i"), "segment", F.col("words").alias("x"))
    b = right.select("match", F.col("track").alias("j"), "segment", F.col("words").alias("y"))
    return a.join(b, ["match", "segment"]).join(ignored.select("match", "i", "j"), ["match", "i", "j"], "left_anti")


PAIR = ("match", "pair")


def fine_delay(rows: DataFrame, window: DataFrame | None = None) -> DataFrame:
    """The fine delay of each match: match, delay_s (null where its pairs vary too much), reason.

    rows: match, pair, segment, delay_s. A pair gives all its delays if they hardly vary, its two ends if those agree,
    else the match fails; so it does if the distinct delays of its pairs vary too much. window: match, delay_s of one long
    window measured for matches short enough (`long_window`), which takes the place of the segments.
    """
    p = rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.var_samp("delay_s").alias("spread"), F.min_by("delay_s", "segment").alias("head"), F.max_by("delay_s", "segment").alias("tail"), F.collect_set("delay_s").alias("every"))
    calm = (F.col("n") == 1) | (F.col("spread") < SPREAD_S)
    ends = F.abs(F.col("head") - F.col("tail")) < SPREAD_S
    given = p.select("match", F.explode(F.when(calm, F.col("every")).when(ends, F.array("head", "tail")).otherwise(F.array(F.lit(None).cast("double")))).alias("d")).distinct()
    m = given.groupBy("match").agg(F.bool_or(F.col("d").isNull()).alias("torn"), F.count("*").alias("kinds"), F.var_samp("d").alias("spread"))
    mean = rows.groupBy("match").agg(F.avg("delay_s").alias("mean"))
    if window is not None:
        mean = mean.join(window.groupBy("match").agg(F.avg("delay_s").alias("long")), "match", "left").withColumn("mean", F.coalesce("long", "mean"))
    reason = F.when(F.col("torn"), "a pair varies").when((F.col("kinds") > 1) & (F.col("spread") > SPREAD_S), "pairs vary")
    return m.join(mean, "match").select("match", F.when(reason.isNull(), F.col("mean")).alias("delay_s"), reason.alias("reason"))


# Seconds of the long window, and the divisor of a match's whole length.
LONGEST_S, CAP_S, DIVISOR, SETTLED_S = 2400, 1500, 2.5, 0.125


def long_window(segment_s: Column, segments: int) -> Column:
    """Seconds of the one long window that is measured again; null for matches too long for it."""
    whole = (segment_s * (segments + 1) / DIVISOR).cast("long")
    return F.when(whole < LONGEST_S, F.least(whole, F.lit(CAP_S)))


def settled(middle_ms: Column, fine_s: Column) -> Column:
    """The delay between two near ones, given the fine delay measured at their middle; null if that is an eighth of a second off."""
    return F.when(F.abs(fine_s) < SETTLED_S, middle_ms + F.bround(fine_s * 1000, 0).cast("long"))


def middle(low: Column, high: Column) -> Column:
    """The middle of two delays in whole milliseconds, half to even."""
    return F.bround((low + high) / 2, 0).cast("long")


def combined(first: DataFrame, fine_pair: DataFrame, fine_match: DataFrame, one: DataFrame | None = None) -> DataFrame:
    """Test 1 of all pairs of a match: match, ignored (pairs), delay_ms (null where it is incompatible), reason, and the
    least and largest delay of its pairs.

    first: match, pair, segment, fidelity, delay_ms. fine_pair: match, pair, delay_s measured at the middle of a pair that
    has two near delays; fine_match: match, delay_s measured at the middle of two near delays of the match.
    one: what `stage_one` says of first, if known.
    """
    one = (stage_one(first, PAIR) if one is None else one).join(fine_pair.select(*PAIR, F.col("delay_s").alias("_fine")), list(PAIR), "left")
    span = first.groupBy(*PAIR).agg(F.min("delay_ms").alias("low"), F.max("delay_ms").alias("high"))
    one = one.join(span, list(PAIR)).withColumn("_found", F.when(F.col("verdict") == "adjust", settled(middle(F.col("low"), F.col("high")), F.col("_fine"))))
    used = (F.col("verdict") == "accept") | F.col("_found").isNotNull()
    s = one.groupBy("match").agg(
        F.array_sort(F.collect_set(F.when(~used, F.col("pair")))).alias("ignored"), F.count_if(used).alias("_used"),
        F.countDistinct(F.when(used, F.col("delay_ms"))).alias("kinds"), F.min(F.when(used, F.col("delay_ms"))).alias("low"), F.max(F.when(used, F.col("delay_ms"))).alias("high"),
        F.max_by("_found", F.when(F.col("verdict") == "adjust", F.col("pair"))).alias("found"))
    s = s.join(fine_match.select("match", F.col("delay_s").alias("_fine")), "match", "left")
    near = (F.col("kinds") == 2) & (F.col("high") - F.col("low") < NEAR_MS)
    delay = F.when(F.col("kinds") == 1, F.coalesce("found", "low")).when(near, settled(middle(F.col("low"), F.col("high")), F.col("_fine")))
    reason = F.when(F.col("kinds") == 0, "no delay").when((F.col("kinds") > 2) | ((F.col("kinds") == 2) & ~near), "several delays").when(delay.isNull(), "not settled")
    return s.select("match", "ignored", delay.alias("delay_ms"), reason.alias("reason"), "low", "high")


def rechecked(start: DataFrame, second: DataFrame, third: DataFrame | None, checked: DataFrame | None = None) -> DataFrame:
    """Tests 2 and 3: match, delay_ms (null where incompatible), test (the last one looked at), more (what test 2 adds).

    start: match, ignored, delay_ms, as of `combined`. second: rows measured with that delay applied; third: with the
    delay that test 2 adds applied too (None: none is). Of several delays in test 2 the least is added. checked: what
    `stage_check` says of second, if known and second has no other rows than those of matches and pairs in use.
    """
    begun = start.where("delay_ms is not null")
    keep = lambda rows: rows.join(begun.select("match", "ignored"), "match").where(~F.array_contains("ignored", F.col("pair"))).drop("ignored")
    two = (stage_check(keep(second), keys=PAIR) if checked is None else checked).groupBy("match").agg(F.bool_or(F.col("verdict") == "incompatible").alias("bad"), F.countDistinct("delay_ms").alias("kinds"), F.min("delay_ms").alias("more"))
    none = start.select("match", *(F.lit(None).cast(t).alias(c) for c, t in (("verdict", "string"), ("delay_ms", "long"), ("distinct", "long"), ("low", "long"), ("high", "long"), ("mean_fidelity", "double"), ("pair", "string")))).limit(0)
    three = (none if third is None else stage_check(keep(third), True, PAIR, "match")).groupBy("match").agg(
        F.bool_or(F.col("verdict") == "incompatible").alias("bad3"), F.bool_and(F.col("delay_ms") == 0).alias("still"),
        F.bool_and((F.col("distinct") <= 2) & (F.abs("low") < CHECK_MS) & (F.abs("high") < CHECK_MS)).alias("small"), F.max_by("mean_fidelity", "pair").alias("mean"))
    s = begun.join(two, "match", "left").join(three, "match", "left")
    done = (F.col("kinds") == 1) & (F.col("more") == 0)
    good = ~F.coalesce("bad3", F.lit(True)) & (F.col("still") | (F.col("small") & (F.col("mean") >= SECOND_MEAN)))
    delay = F.when(F.coalesce("bad", F.lit(True)), None).when(done, F.col("delay_ms")).when(good, F.col("delay_ms") + F.col("more"))
    return s.select("match", delay.alias("delay_ms"), F.when(F.coalesce("bad", F.lit(True)) | done, 2).otherwise(3).alias("test"), "more")


def agreed(first_ms, second_s):
    """The total delay if both stages agree within half a second, else null."""
    total = first_ms + second_s * 1000
    return F.when(F.abs(total - first_ms) < AGREE_MS, total)
