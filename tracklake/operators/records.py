"""Further predicates and aggregates on track records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codec classes and the words that log lines are kept for.
PICTURE_CODECS = ("hdmv_pgs_subtitle", "dvd_subtitle", "dvb_subtitle", "xsub")
PLAIN_CODECS = ("subrip", "srt", "text", "mov_text")
EXACT = 9  # digits of a mean that count when it is compared with a bound
LOG_WORDS = ("error", "warning", "failed", "invalid", "missing", "corrupt", "attachment", "uid")


def codec_class(codec: Column) -> Column:
    """picture, plain or styled."""
    low = F.lower(codec)
    return F.when(low.isin(*PICTURE_CODECS), "picture").when(low.isin(*PLAIN_CODECS), "plain").otherwise("styled")


def incompatible(properties: Column, stream: Column, format_: Column, bad: list[str]) -> Column:
    """Whether the first known name of the codec is a bad one."""
    return F.coalesce(F.lower(F.coalesce(properties, stream, format_)).isin(*bad), F.lit(False))


def empty_track(size: Column, duration: Column) -> Column:
    """A track without bytes or time; what is unknown counts as present."""
    return (F.coalesce(size, F.lit(1)) == 0) | (F.coalesce(duration, F.lit(1.0)) == 0)


def keep_at_first(role: Column, no_commentary: bool, no_description: bool) -> Column:
    return F.when(role == "commentary", F.lit(not no_commentary)).when(role == "audiodesc", F.lit(not no_description)).otherwise(F.lit(True))


def default_language(language: Column, wanted: str, present: Column) -> Column:
    """und stands for the wanted language where no track has that."""
    return F.when((language == "und") & ~present, wanted).otherwise(language)


def forced_winner(files: DataFrame, part: str, order: str) -> DataFrame:
    """The last file whose name contains the part."""
    return files.where(F.contains("name", F.lit(part))).orderBy(F.desc(order)).limit(1)


def forced_winner_named(files: DataFrame, name: str, order: str) -> DataFrame:
    """The last file whose name or path is the given one."""
    return files.where((F.col("name") == name) | (F.col("path") == name)).orderBy(F.desc(order)).limit(1)


def log_lines(logs: DataFrame, text: str) -> DataFrame:
    """Lines with one of the words, except that no attachment was found; tolerable: only uid warnings."""
    keep = [c for c in logs.columns if c != text]
    lines = logs.select(*keep, F.explode(F.split(text, "\n")).alias("line")).withColumn("_l", F.lower("line"))
    found = lines.where(F.col("_l").rlike("|".join(LOG_WORDS)) & ~F.contains("_l", F.lit("attachment: none")))
    return found.withColumn("tolerable", F.contains("_l", F.lit("warning")) & F.contains("_l", F.lit("uid"))).drop("_l")


def failed_paths(message: Column) -> Column:
    """The quoted paths of a message that a list of files is not compatible."""
    return F.regexp_extract_all(F.regexp_extract(message, r"\[([^\]]*)\] not (?:compatible|have the language)", 1), F.lit("'([^']*)'"), 1)


def retained(tag: Column, delay: Column) -> Column:
    """Whether the delay stored in a JSON tag is the new one, as decimals."""
    return F.coalesce(F.get_json_object(tag, "$.delay").try_cast("decimal(20,9)") == delay.cast("decimal(20,9)"), F.lit(False))


def bitrate(stream: Column, own: Column, nominal: Column) -> Column:
    return F.coalesce(stream.try_cast("long"), own.try_cast("long"), nominal.try_cast("long"))


def needed_bitrate(stream: Column, own: Column, nominal: Column) -> Column:
    """The same, but an error where none of the three is a number."""
    found = bitrate(stream, own, nominal)
    return F.when(found.isNull(), F.raise_error(F.lit("no bit rate")).cast("long")).otherwise(found)


def comparable(fingerprint: Column) -> Column:
    """Whether a track can be compared by its fingerprint at all."""
    return F.coalesce(F.size(fingerprint) > 0, F.lit(False))


def duration(frames: Column, rate: Column, seconds: Column) -> Column:
    return F.coalesce(seconds.try_cast("double"), F.try_divide(frames.try_cast("double"), rate.try_cast("double")))


def relative_id(order: Column) -> Column:
    return F.coalesce(order.try_cast("long") - 1, F.lit(0).cast("long"))


def weakest(tracks: DataFrame, group: str) -> DataFrame:
    """Least duration, channels (2 if unknown) and rate (44100) of a group; texts that aren't numbers don't count."""
    return tracks.groupBy(group).agg(F.min(F.col("duration").try_cast("double")).alias("duration"), F.coalesce(F.min(F.col("channels").try_cast("int")), F.lit(2)).alias("channels"), F.coalesce(F.min(F.col("rate").try_cast("int")), F.lit(44100)).alias("rate"))


def keep_plain_of_equal(subtitles: DataFrame, group: list[str], order: str) -> DataFrame:
    """Of equal hashes the first plain one stays, or the first of all; styled ones go where there is a plain one."""
    w = Window.partitionBy(*group, "hash").orderBy((F.col("kind") != "plain").cast("int"), order)
    return subtitles.withColumn("keep", (F.row_number().over(w) == 1) | (F.coalesce(F.col("hash"), F.lit("")) == ""))


def best_shift(scores: DataFrame) -> DataFrame:
    """The shift with the largest mean score of each pair, the last of equals."""
    mean = scores.groupBy("pair", "shift").agg(F.avg("score").alias("mean"))
    return mean.groupBy("pair").agg(F.max_by("shift", F.struct("mean", "shift")).alias("shift"), F.max("mean").alias("mean"))


def style_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.lower(x).startswith("style:"))).cast("long")


def fan_out(tracks: DataFrame, group: str, order: str, begin: Column, length: Column, n: int) -> DataFrame:
    """A row for each compatible track and segment, with the track's dense place from 0 in its group."""
    placed = tracks.withColumns({"place": F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long") - 1, "_b": begin, "_l": length})
    return placed.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("begin_s", F.col("_b") + F.col("segment") * F.col("_l")).drop("_b").withColumnRenamed("_l", "length_s")


def first_success(candidates: DataFrame, group: list[str], ok: Column) -> DataFrame:
    """Of ordered candidates (heaviest first, then larger files) the first that succeeds."""
    return candidates.where(ok).groupBy(*group).agg(F.max_by(F.struct("file", "weight", "size"), F.struct("weight", "size", "file")).alias("w")).select(*group, "w.*")


def constant_delays(members: DataFrame) -> DataFrame:
    """Delay in ms of each file to the first one of equal signature: owner, signature, delay_s."""
    first = members.groupBy("signature").agg(F.min_by("delay_s", "owner").alias("_d"), F.min("owner").alias("representative"))
    return members.join(first, "signature").select("owner", "representative", ((F.col("_d") - F.col("delay_s")) * 1000).alias("delay_ms"))


def result_line(file: Column, seconds: Column) -> Column:
    return F.to_json(F.struct(file.alias("file"), seconds.alias("offset_seconds")))


def compatible_globally(rows: DataFrame, group: str, least: float = 0.85) -> DataFrame:
    """Groups whose mean fidelity suffices; all_torn: each segment has several offsets.

    A mean at the bound suffices, in whatever order its values are added up: what addition rounds is not counted.
    """
    return rows.groupBy(group).agg((F.round(F.avg("fidelity"), EXACT) >= least).alias("compatible"), F.bool_and(F.col("offsets") > 1).alias("all_torn"))


def strategy(left: Column, right: Column, memory: float) -> Column:
    """full where both signals' padded transforms fit the memory (18 bytes an element), else blocks of the longer one."""
    n = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(left + right - 1, F.lit(1)))))
    return F.when(n * 18 <= memory, "full").otherwise("blocks")
