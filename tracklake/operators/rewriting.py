"""The rewriting of a file's tracks in two passes, as rows: which tracks stay, their places, codecs, tags and times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.records import codec_class, empty_track


def selection(tracks: DataFrame, without: list[str]) -> DataFrame:
    """Adds kept and reason. Of equal hashes the first track that may stay is kept, by file and stream order.

    tracks: grp, file, kind, stream_order, language, keep, md5, stream_size, duration_s. Subtitles and sound have
    hashes of their own; an empty or unknown hash is never a duplicate. Unknown sizes and times count as present.
    """
    t = tracks.withColumns({"scope": F.when(F.col("kind") == "subtitle", "subtitle").otherwise("audio"), "_h": F.nullif("md5", F.lit(""))})
    early = (
        F.when(F.coalesce(F.col("language").isin(*without), F.lit(False)), "language")
        .when(~F.coalesce("keep", F.lit(False)), "not kept")
        .when(empty_track(F.col("stream_size"), F.col("duration_s")), "empty")
    )
    t = t.withColumn("_early", early)
    w = Window.partitionBy("grp", "scope", "_h", F.col("_early").isNull()).orderBy("file", F.col("stream_order").cast("int"), "kind")
    again = F.col("_early").isNull() & F.col("_h").isNotNull() & (F.row_number().over(w) > 1)
    return t.withColumn("reason", F.coalesce("_early", F.when(again, "same hash"))).withColumn("kept", F.col("reason").isNull()).drop("_h", "_early")


def first_pass(selected: DataFrame) -> DataFrame:
    """Kept tracks with their place among those of their kind, target codec and the tag that remembers their origin.

    selected: rows of `selection` with format and delay. Picture subtitles and sound are copied.
    """
    w = Window.partitionBy("grp", "file", "scope").orderBy(F.col("stream_order").cast("int"), "kind")
    kind = codec_class(F.col("format"))
    codec = F.when(F.col("scope") == "audio", "copy").when(kind == "picture", "copy").when(kind == "plain", "srt").otherwise("ass")
    tag = F.to_json(F.struct(F.col("stream_order").cast("int").alias("original_position"), F.coalesce(F.col("delay").cast("double"), F.lit(0.0)).alias("original_delay")))
    return selected.where("kept").withColumns({"place": (F.row_number().over(w) - 1).cast("long"), "codec": codec, "tag": tag})


def times(files: DataFrame) -> DataFrame:
    """Adds first_length_s, offset_s and seek_s: a delay puts the start off, a negative one skips into the file.

    files: delay_ms, duration_s (of the best video).
    """
    delay = F.coalesce("delay_ms", F.lit(0)) / 1000
    return files.withColumns({"first_length_s": F.col("duration_s") - delay, "offset_s": F.greatest(delay, F.lit(0.0)), "seek_s": F.greatest(-delay, F.lit(0.0))})
