"""A whole merge, from tracks and their sound to what is taken from which file at which delay.

1. The language to compare by; files without a track of it are rejected, and merges where no two files share one.
2. Files with the same sounds in that language and one delay each are a group: its first file (or the forced one) stands for it,
   the others follow at a constant delay.
3. The representatives meet in knockout rounds, or a forced one meets all others. Only pairs that meet are measured
   (`measuring.decided`), each once; all merges go through a round at once.
4. Files that fit nothing are rejected; probes find the step between two offsets against the one that stays, if asked to.
5. Delays add up from the root down, those of the groups included.
6. Of kept tracks equal hashes go, then of tracks that sound alike at these delays the dominated ones; subtitles are pruned
   to the budget. What is left is put in order.

Each table that is read again is written once (`tables.cut`). A merge is a few files; the sound of those that meet in a round is what
a round reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators import measuring, merging, probes
from tracklake.operators.subtitles import pruned
from tracklake.operators.tracks import tree_delays
from tracklake.sources.tables import cut

PAIR = ["grp", "a", "b"]


@dataclass(frozen=True)
class Sounds:
    """words and samples: grp, file, ord, n (from 0), value; grid: grp, segment, begin_s, length_s; places a second of each."""

    words: DataFrame
    samples: DataFrame
    grid: DataFrame
    word_rate: float
    sample_rate: float


@dataclass(frozen=True)
class Merged:
    """plan: tracks with action, place, delay_ms, is_default and reason (of a removed one); rejected: grp, file, reason;
    edges: grp, winner, loser, round; cuts(), measured when asked for: grp, file, root and what `probes.step` says."""

    plan: DataFrame
    rejected: DataFrame
    edges: DataFrame
    cuts: Callable[[], DataFrame]


def same_sound(tracks: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """grp, file, representative, delay_ms: files whose tracks (grp, file, md5, delay_s) have the same hashes and one delay each.

    A file with several delays, or without a hash on every track, stands for itself. delay_ms: the representative's delay less the file's.
    """
    s = tracks.groupBy("grp", "file").agg(F.array_join(F.array_sort(F.collect_set("md5")), "").alias("_own"), F.bool_and(F.coalesce(F.col("md5") != "", F.lit(False))).alias("_all"), F.countDistinct(F.coalesce("delay_s", F.lit(0.0))).alias("_n"), F.min(F.coalesce("delay_s", F.lit(0.0))).alias("_d"))
    s = s.join(forced.withColumn("_first", F.lit(0)), ["grp", "file"], "left") if forced is not None else s.withColumn("_first", F.lit(None).cast("int"))
    alone = (F.col("_n") > 1) | ~F.col("_all")
    key = F.when(alone, F.concat(F.lit("file "), F.col("file").cast("string"))).otherwise(F.concat(F.lit("md5 "), F.col("_own")))
    w = Window.partitionBy("grp", "_key").orderBy(F.coalesce("_first", F.lit(1)), "file")
    placed = s.withColumn("_key", key).withColumns({"representative": F.first("file").over(w), "_r": F.first("_d").over(w)})
    return placed.select("grp", "file", "representative", F.bround((F.col("_r") - F.col("_d")) * 1000, 0).cast("long").alias("delay_ms"))


def heard(sounds: Sounds, pairs: DataFrame, tracks: DataFrame, all_: bool = False) -> measuring.Tracks:
    """The sound of pairs (match, grp, a, b) of files, by the tracks (grp, file, ord) that count; without the places that
    `measuring.decided` can't read, unless all are wanted."""
    sides = pairs.select("match", "grp", F.col("a").alias("file"), F.lit(1).alias("side")).unionByName(pairs.select("match", "grp", F.col("b").alias("file"), F.lit(2).alias("side")))
    grid = cut(pairs.select("match", "grp").join(sounds.grid, "grp").select("match", "segment", "begin_s", "length_s"))
    wanted, on = sides.join(tracks, ["grp", "file"]), ["grp", "file", "ord"]
    wanted = cut(wanted if all_ else wanted.join(measuring.reach(grid), "match"))
    near = lambda rows, rate: rows.join(wanted, on) if all_ else measuring.within(rows, wanted, on, rate)
    own = lambda rows, rate: cut(near(rows, rate).select("match", "side", F.col("ord").cast("string").alias("track"), "n", "value"))
    return measuring.Tracks(own(sounds.words, sounds.word_rate), own(sounds.samples, sounds.sample_rate), grid, sounds.word_rate, sounds.sample_rate)


def compared(sounds: Sounds, tracks: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function of pairs (grp, a, b): them with delay_ms (how much later b is; null where they don't fit) and reason."""

    def measure(pairs: DataFrame) -> DataFrame:
        p = cut(pairs.select(*PAIR).withColumn("match", F.monotonically_increasing_id()))
        found = measuring.decided(heard(sounds, p, tracks))
        fits = F.col("found") & F.col("total_ms").isNotNull()
        out = p.join(found.withColumn("found", F.lit(True)), "match", "left")
        return cut(out.select(*PAIR, F.when(fits, F.bround("total_ms", 0).cast("long")).alias("delay_ms"), F.when(fits, None).otherwise(F.coalesce("reason", F.lit("no sound"))).alias("reason")))

    return measure


def knockout(files: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`merging.knockout` with pairs measured when they meet: edges (grp, winner, loser, round), all pairs measured (with
    delay_ms and reason), and who stands at the end (grp, name).

    files: grp, name, score; a file with the smaller name wins if its score isn't less. Places go by name. A merge ends when
    one file stands or all standing pairs have been measured in vain.
    """
    order = lambda df, by: df.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(by)) - 1)
    standing = cut(order(files.select("grp", "name", "score"), "name"))
    kind = f"grp {files.schema['grp'].dataType.simpleString()}, "
    name = files.schema["name"].dataType.simpleString()
    spark = files.sparkSession
    tried = spark.createDataFrame([], f"{kind}a {name}, b {name}, delay_ms long, reason string")
    edges = spark.createDataFrame([], f"{kind}winner {name}, loser {name}, round int")
    done, round_ = spark.createDataFrame([], f"{kind}name {name}"), 0
    while True:
        there = lambda c: standing.select("grp", F.col("name").alias(c))  # noqa: B023, E731
        vain = tried.where("delay_ms is null").join(there("a"), ["grp", "a"], "left_semi").join(there("b"), ["grp", "b"], "left_semi").groupBy("grp").agg(F.count("*").alias("_vain"))
        n = standing.groupBy("grp").agg(F.count("*").alias("n")).join(vain, "grp", "left")
        going = n.where(F.col("n") * (F.col("n") - 1) / 2 > F.coalesce("_vain", F.lit(0))).select("grp", "n")
        done = done.unionByName(standing.join(going, "grp", "left_anti").select("grp", "name"))
        now = cut(standing.join(going, "grp").withColumn("other", F.pmod(F.lit(round_) - F.col("place"), F.col("n"))))
        if not now.limit(1).count():
            return edges, tried, done
        met = now.where("place < other").select("grp", "other", F.col("name").alias("a"), F.col("score").alias("_a"))
        met = met.join(now.select("grp", F.col("place").alias("other"), F.col("name").alias("b"), F.col("score").alias("_b")), ["grp", "other"])
        met = cut(met.join(tried.select(*PAIR), PAIR, "left_anti"))
        if met.limit(1).count():
            found = measure(met)
            tried = tried.unionByName(found.select(*tried.columns))
            a_wins = F.coalesce(F.col("_a") >= F.col("_b"), F.lit(True))
            won = met.join(found.where("delay_ms is not null"), PAIR).select("grp", F.when(a_wins, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(a_wins, F.col("b")).otherwise(F.col("a")).alias("loser"), F.lit(round_).alias("round"))
            won = cut(won)
            edges = edges.unionByName(won)
            now = now.join(won.select("grp", F.col("loser").alias("name")), ["grp", "name"], "left_anti")
        standing = cut(order(now.select("grp", "name", "score", F.col("place").alias("_p")), "_p").drop("_p"))
        round_ += 1


def star(files: DataFrame, forced: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As `knockout`, with one forced winner (grp, file) a merge: it meets all others once, and stands alone."""
    pairs = files.select("grp", "name").join(forced.select("grp", F.col("file").alias("winner")), "grp").where("name <> winner")
    tried = measure(pairs.select("grp", F.least("name", "winner").alias("a"), F.greatest("name", "winner").alias("b")))
    edges = tried.where("delay_ms is not null").join(forced.select("grp", F.col("file").alias("winner")), "grp")
    edges = edges.select("grp", "winner", F.when(F.col("winner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("loser"), F.lit(0).alias("round"))
    return edges, tried, files.select("grp", "name").join(edges.select("grp", F.col("loser").alias("name")), ["grp", "name"], "left_anti")


def alike(sounds: Sounds, kept: DataFrame, delays: DataFrame) -> DataFrame:
    """grp (merge and language), i, j: pairs of kept sound tracks of a language that agree at the delays of their files."""
    at = cut(kept.where("kind <> 'subtitle'").join(delays, ["grp", "file"]).select("grp", "file", "language", "ord", "delay_ms"))
    i, j = (at.select("grp", "language", F.col("ord").alias(o), F.col("delay_ms").alias(f"_{o}")) for o in ("i", "j"))
    match = cut(at.select("grp").distinct().withColumn("match", F.monotonically_increasing_id()))
    pairs = cut(i.join(j, ["grp", "language"]).where("i < j").join(match, "grp"))
    # the second track of a pair is read at the difference of two delays
    apart = at.groupBy("grp").agg(((F.max("delay_ms") - F.min("delay_ms")) / 1000 + 1).alias("_d"))
    bounds = sounds.grid.groupBy("grp").agg(F.min("begin_s").alias("_b"), F.max(F.col("begin_s") + F.col("length_s")).alias("_e")).join(apart, "grp")
    bounds = bounds.select("grp", (F.col("_b") - F.col("_d")).alias("low_s"), (F.col("_e") + F.col("_d")).alias("high_s"))
    there = cut(at.select("grp", "file", "ord").join(match, "grp").join(bounds, "grp"))
    own = measuring.within(sounds.words, there, ["grp", "file", "ord"], sounds.word_rate).select("match", F.col("ord").cast("string").alias("track"), "n", "value")
    words = cut(own.withColumn("side", F.explode(F.array(F.lit(1), F.lit(2)))))
    t = measuring.Tracks(words, words, cut(match.join(sounds.grid, "grp").select("match", "segment", "begin_s", "length_s")), sounds.word_rate, sounds.sample_rate)
    pair = F.concat_ws("-", "i", "j")
    asked = pairs.select("match", pair.alias("pair"), F.col("i").cast("string").alias("i"), F.col("j").cast("string").alias("j"), (F.col("_i") - F.col("_j")).cast("double").alias("delay_ms"))
    found = measuring.coarse(t, asked).join(pairs.select("match", pair.alias("pair"), F.concat_ws("/", "grp", "language").alias("grp"), "i", "j"), ["match", "pair"])
    return merging.compatible_pairs(found)


def merged(tracks: DataFrame, scores: DataFrame, sounds: Sounds, original: str, rule_text: str, most: int, synonyms: DataFrame, keep_languages: list[str], try_languages: list[str], forced: DataFrame | None = None) -> Merged:
    """tracks: grp, file, kind, language, ord (unique in the merge), key, md5, delay_s, format, channels, rate, bitrate, title,
    hearing, class, keep. scores: grp, file, score. forced: grp, file, for merges that are told who wins; then every merge is.

    The default of a kind is the first one taken. A file alone in its merge is its own root, at delay 0.
    """
    tracks = cut(tracks)
    language = merging.merge_language(tracks.where("kind <> 'subtitle'").select("grp", "file", "language"), original)
    spoken = tracks.where("kind <> 'subtitle'").join(language.select("grp", "language"), ["grp", "language"], "left_semi")
    spoken = spoken.select("grp", "file", "ord", "md5", "delay_s").withColumn("_n", F.size(F.collect_set("file").over(Window.partitionBy("grp"))))
    able = cut(spoken.where("_n > 1").drop("_n"))
    files = tracks.select("grp", "file").distinct()
    unable = files.join(able.select("grp", "file"), ["grp", "file"], "left_anti").withColumn("reason", F.lit("no common language"))

    groups = cut(same_sound(able, forced))
    first = groups.where("file = representative").join(scores, ["grp", "file"], "left").select("grp", F.col("file").alias("name"), "score")
    measure = compared(sounds, able.select("grp", "file", "ord"))
    edges, tried, done = knockout(first, measure) if forced is None else star(first, forced, measure)
    edges, tried, done = cut(edges), cut(tried), cut(done)
    out = merging.left_over(done, edges) if forced is None else done.join(forced.select("grp", F.col("file").alias("name")), ["grp", "name"], "left_anti")
    follow = groups.join(out.select("grp", F.col("name").alias("representative")), ["grp", "representative"], "left_semi")
    rejected = cut(unable.unionByName(follow.select("grp", "file", F.lit("not compatible").alias("reason"))))

    # the loser's delay: measured is how much later the second file is
    way = edges.join(tried, (edges["grp"] == tried["grp"]) & (F.least("winner", "loser") == tried["a"]) & (F.greatest("winner", "loser") == tried["b"]))
    way = way.select(edges["grp"], "winner", "loser", F.when(F.col("winner") == F.col("a"), -F.col("delay_ms")).otherwise(F.col("delay_ms")).alias("delay"))
    way = way.unionByName(groups.where("file <> representative").select("grp", F.col("representative").alias("winner"), F.col("file").alias("loser"), F.col("delay_ms").alias("delay")))
    node = lambda c: F.struct("grp", F.col(c).alias("name")).alias(c)
    found = tree_delays(way.select(node("winner"), node("loser"), "delay")).select("node.grp", F.col("node.name").alias("file"), F.col("delay").alias("delay_ms"))
    left = files.join(rejected, ["grp", "file"], "left_anti")
    at = cut(left.join(found, ["grp", "file"], "left").select("grp", "file", F.coalesce("delay_ms", F.lit(0).cast("long")).alias("delay_ms")))

    mine = tracks.join(at.select("grp", "file"), ["grp", "file"], "left_semi").withColumn("reason", F.when(~F.coalesce("keep", F.lit(False)), "not kept"))
    scope = F.when(F.col("kind") == "subtitle", "subtitle").otherwise("sound")
    w = Window.partitionBy("grp", scope, "md5", F.col("reason").isNull()).orderBy("ord")
    again = (F.col("md5") != "") & (F.row_number().over(w) > 1)
    mine = cut(mine.withColumn("reason", F.coalesce("reason", F.when(again & (F.col("kind") != "subtitle"), "same hash"))))
    sound_ = mine.where("kind = 'audio' and reason is null").withColumns({"_grp": F.col("grp"), "grp": F.concat_ws("/", "grp", "language"), "member": F.col("ord")})
    pairs = alike(sounds, mine.where("kind = 'audio' and reason is null"), at)
    best = merging.best_per_clique(sound_.select("grp", "member", "_grp", "format", "channels", "rate", "bitrate"), pairs, rule_text)
    lost = best.where("not keep").select(F.col("_grp").alias("grp"), F.col("member").alias("ord"), F.lit("dominated").alias("_why"))
    subs = mine.where("kind = 'subtitle'").withColumn("keep", F.col("reason").isNull())
    after = pruned(subs.select("grp", "language", "ord", "title", "hearing", "class", "md5", "keep"), F.lit(most), synonyms, keep_languages, try_languages)
    lost = lost.unionByName(after.where("not keep").select("grp", "ord", F.when(F.col("step").isNull(), "same hash").otherwise("over the budget").alias("_why")))
    final = mine.join(lost, ["grp", "ord"], "left").withColumn("reason", F.coalesce("reason", "_why")).drop("_why").withColumn("keep", F.col("reason").isNull())
    plan = merging.commands(cut(final), at)

    return Merged(plan, rejected, edges, lambda: torn(sounds, able, rejected, done, out))


def torn(sounds: Sounds, able: DataFrame, rejected: DataFrame, done: DataFrame, out: DataFrame) -> DataFrame:
    """grp, file, root and the step between two offsets of each file that wasn't compatible, against the one that stays."""
    root = done.join(out, ["grp", "name"], "left_anti").select("grp", F.col("name").alias("root"))
    pairs = rejected.where("reason = 'not compatible'").join(root, "grp").select("grp", F.col("root").alias("a"), F.col("file").alias("b"))
    p = cut(pairs.withColumn("match", F.monotonically_increasing_id()))
    t = heard(sounds, p, able.select("grp", "file", "ord"), True)
    length = t.samples.groupBy("match", "side").agg((F.max("n") + 1).alias("_n")).groupBy("match").agg((F.min("_n") / t.sample_rate).alias("duration_s"))
    fit = probes.step(probes.measured(t, cut(probes.spread_over(length))), "match", "center_s", "delay_s")
    return p.join(fit, "match").select("grp", F.col("b").alias("file"), F.col("a").alias("root"), "kind", "at", "before", "after")
