"""Parsing of media metadata documents, fingerprints and sample blocks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTAINER = "media STRUCT<track: ARRAY<MAP<STRING, STRING>>>"
PROPERTIES = "tracks ARRAY<STRUCT<id: INT, properties: STRUCT<codec: STRING, flag_commentary: BOOLEAN, flag_visual_impaired: BOOLEAN, flag_hearing_impaired: BOOLEAN>>>"
STREAMS = "streams ARRAY<STRUCT<index: INT, codec_name: STRING, bit_rate: STRING>>"


def container_tracks(files: DataFrame, text: str = "json") -> DataFrame:
    """One row a track of each file's container document."""
    keep = [c for c in files.columns if c != text]
    t = F.col("t")
    return files.select(*keep, F.explode(F.from_json(text, CONTAINER)["media"]["track"]).alias("t")).select(
        *keep, t["@type"].alias("type"), t["StreamOrder"].try_cast("int").alias("stream_order"), t["Title"].alias("title"), t["Language"].alias("language"), t["Format"].alias("format"),
        F.coalesce(t["Channels"].try_cast("double"), F.lit(2.0)).alias("channels"), F.coalesce(t["SamplingRate"].try_cast("int"), F.lit(44100)).alias("sampling_rate"),
        F.coalesce(t["BitRate"].try_cast("long"), t["BitRate_Nominal"].try_cast("long")).alias("bitrate"), t["Duration"].try_cast("double").alias("duration_s"), F.coalesce(t["StreamSize"].try_cast("long"), F.lit(1)).alias("stream_size"))


def property_tracks(files: DataFrame, text: str = "json") -> DataFrame:
    """One row a track of each properties document; repeated: an id that comes twice."""
    keep = [c for c in files.columns if c != text]
    rows = files.select(*keep, F.explode(F.from_json(text, PROPERTIES)["tracks"]).alias("t")).select(*keep, "t.id", "t.properties.*")
    return rows.join(rows.groupBy(*keep, "id").agg((F.count("*") > 1).alias("repeated")), [*keep, "id"])


def stream_tracks(files: DataFrame, text: str = "json") -> DataFrame:
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.explode(F.from_json(text, STREAMS)["streams"]).alias("t")).select(*keep, "t.*")


def fingerprint(text: Column) -> Column:
    """The words of a FINGERPRINT=a,b,c line as longs (they are unsigned 32-bit)."""
    found = F.nullif(F.regexp_extract(text, "FINGERPRINT=([0-9,]+)", 1), F.lit(""))
    return F.transform(F.split(found, ","), lambda x: x.try_cast("long"))


def scene_times(log: Column) -> Column:
    return F.transform(F.regexp_extract_all(log, F.lit("pts_time:([0-9.]+)"), 1), lambda x: x.try_cast("double"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pcm(raw: pd.Series) -> pd.Series:
    """Little-endian 32-bit float samples of a binary column; a partial last sample is left out."""
    return pd.Series([None if x is None else np.frombuffer(x[: len(x) // 4 * 4], "<f4") for x in raw])


SOUND = T.StructType([T.StructField("rate", T.IntegerType()), T.StructField("samples", T.ArrayType(T.DoubleType()))])


@F.pandas_udf(SOUND)
def wav(raw: pd.Series) -> pd.DataFrame:
    """Rate and first channel of a WAV file's bytes (8, 16 or 32 bits whole, or 32 bits float); null if it isn't one.

    Chunks are walked, so that others than format and data may stand anywhere; a cut data chunk gives what is there.
    """

    def one(x):
        x = bytes(x) if x is not None else b""
        if x[:4] != b"RIFF" or x[8:12] != b"WAVE":
            return None, None
        at, form = 12, None
        while at + 8 <= len(x):
            kind, size = x[at : at + 4], int.from_bytes(x[at + 4 : at + 8], "little")
            if kind == b"fmt ":
                form = struct.unpack_from("<HHIIHH", x, at + 8)
            elif kind == b"data" and form:
                code, channels, rate, _, _, bits = form
                read = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}.get((code, bits))
                if read is None:
                    return None, None
                width = channels * bits // 8
                data = x[at + 8 : at + 8 + size]
                return rate, np.frombuffer(data[: len(data) // width * width], read).reshape(-1, channels)[:, 0].astype(float)
            at += 8 + size + size % 2
        return None, None

    return pd.DataFrame([one(x) for x in raw], columns=["rate", "samples"])


def probed(text: Column) -> tuple[Column, Column]:
    """Rate and seconds from a probe's lines: the first line of digits alone, the first other number; 44100 and 0 by default."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    whole = F.filter(lines, lambda x: x.rlike("^[0-9]+$"))
    other = F.filter(lines, lambda x: ~x.rlike("^[0-9]+$") & x.try_cast("double").isNotNull())
    return F.coalesce(F.get(whole, F.lit(0)).try_cast("int"), F.lit(44100)), F.coalesce(F.get(other, F.lit(0)).try_cast("double"), F.lit(0.0))


def overridden(folders: DataFrame, text: str, defaults: dict[str, str]) -> DataFrame:
    """Settings of each folder: those of its JSON document (null without one), else the defaults, all as text."""
    own = F.from_json(text, "MAP<STRING, STRING>")
    return folders.withColumns({k: F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(v)) for k, v in defaults.items()}).drop(text)


def directive(folder: Column) -> tuple[Column, Column]:
    """Whether a folder name asks for grouping, and for merging without synchronisation."""
    return folder.rlike(r"\[grouping\]"), folder.rlike(r"\[merge\]")


def media_file(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(mkv|mp4|avi)$")
