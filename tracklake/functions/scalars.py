"""Column functions on names, times, titles and bit words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "{<episode>}"


def java_pattern(text: str) -> str:
    """A pattern with Python's named groups in the form that Spark reads."""
    return re.sub(r"\(\?P<", "(?<", text)


def episode_group(pattern: Column) -> Column:
    """The number of a pattern's group named episode, else 1; null if it has no group."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[[^\]]*\]", "")  # without escapes and classes
    opening = r"\((?!\?)|\(\?P?<(?![=!])"
    before = F.regexp_extract(bare, r"^(.*?)\(\?P?<episode>", 1)
    named = F.contains(bare, F.lit("?<episode>")) | F.contains(bare, F.lit("?P<episode>"))
    group = F.when(named, F.regexp_count(before, F.lit(opening)) + 1).otherwise(F.lit(1))
    return F.when(F.regexp_count(bare, F.lit(opening)) > 0, group)


def episode_text(name: Column, pattern: Column, group: Column | None = None) -> Column:
    """What the group named episode of the pattern matches, else its first group; null without a match or a group.

    group: the group's number, where it is known already (`episode_group`).
    """
    group = episode_group(pattern) if group is None else group
    found = F.call_function("regexp_extract", name, F.regexp_replace(pattern, r"\(\?P<", "(?<"), group)
    return F.nullif(found, F.lit(""))


def valid_episode(text: Column) -> Column:
    """Digits only, and more than zero."""
    return F.coalesce(text.rlike("^[0-9]+$") & (text.try_cast("long") > 0), F.lit(False))


def renamed(template: Column, number: Column) -> Column:
    """The template with its token replaced by the number, two digits at least; null if it has no token."""
    return F.when(F.contains(template, F.lit(TOKEN)), F.replace(template, F.lit(TOKEN), F.format_string("%02d", number)))


def clock(seconds: Column) -> Column:
    """HH:MM:SS.mmm of a time below a day; longer ones wrap."""
    ms = F.floor(seconds * 1000).cast("long") % 86400000
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def seconds_of(text: Column) -> Column:
    part = F.split(text, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def base_name(path: Column) -> Column:
    """What stands after the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a name that only starts with a dot has none."""
    return F.regexp_replace(base_name(path), r"(?<=[^.])\.[^.]*$", "")


def joined_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def quality_window(length: Column) -> Column:
    """Seconds of a segment that picture quality is compared over: a quarter, and one more."""
    return (length * 25 / 100).cast("long") + 1


def grid_begin(duration: Column) -> Column:
    """Where the first of the compared segments begins; null for five seconds and less."""
    return F.when(duration > 540, 120).when(duration > 60, 30).when(duration > 5, 0).cast("long")


def grid_length(duration: Column, n: int) -> Column:
    """Length of each of n segments. The short case takes only its margin over the parts, as the original rule does."""
    whole = F.when(duration > 540, (duration - 240) / (n + 1)).when(duration > 60, (duration - 45) / (n + 1)).when(duration > 5, duration - 2 / (n + 1))
    return whole.cast("long")


def shifted_begin(begin: Column, delay_ms: Column) -> tuple[Column, Column]:
    """Second and millisecond of begin plus a signed delay; null where that is before the start."""
    total = begin * 1000 + delay_ms
    return F.when(total >= 0, F.floor(total / 1000).cast("long")), F.when(total >= 0, total % 1000)


def frame_aligned(delay_ms: Column, fps: Column, constant: Column) -> Column:
    """The delay as a whole number of frames (half to even) where the frame rate is constant."""
    return F.when(constant, F.bround(delay_ms / (1000 / fps), 0) * (1000 / fps)).otherwise(delay_ms)


def tempo(slope: Column, coherent: Column) -> Column:
    return F.when((F.abs(slope) > 0.005) & coherent, 1 / (1 + slope)).otherwise(F.lit(1.0))


def tempo_chain(rate: Column) -> Column:
    """Equal factors within 0.5 .. 2 whose product is the rate."""
    steps = F.greatest(F.lit(1), F.ceil(F.abs(F.log2(rate)))).cast("int")
    return F.array_repeat(F.pow(rate, 1 / steps), steps)


def bit_similarity(x: Column, y: Column) -> Column:
    """Share of equal bits of the common prefix of two arrays of 32-bit words; null if there is none."""
    n = F.least(F.size(x), F.size(y))
    same = F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda a, b: F.lit(32) - F.bit_count(a.bitwiseXOR(b))), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when(n > 0, same / n / 32)


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*(\S+)", 1)


def normal_language(code: Column, known: Column, macro: Column | None = None) -> Column:
    """The known two-letter code, else the macrolanguage, else what stands before a dash, else und.

    known and macro come from lookup tables of the caller, joined by the code.
    """
    return F.coalesce(known, *([] if macro is None else [macro]), F.nullif(F.split(code, "-")[0], F.lit("")), F.lit("und"))


def clean_title(title: Column, marker: str) -> Column:
    """The title in lower case without a role marker and outer white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(title), marker, ""), r"^\s+|\s+$", "")


def subtitle_text(text: Column) -> Column:
    """The spoken lines alone: no blank, number or time lines, no tags; null if none are left."""
    lines = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike("^[0-9]+$") & ~F.contains(x, F.lit("-->")))
    return F.nullif(F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "<[^>]*>", "")), "\n"), F.lit(""))


def gain(measured: Column) -> Column:
    """Decibels up to -23, nothing for less than half a decibel."""
    g = F.lit(-23.0) - measured
    return F.coalesce(F.when(F.abs(g) < 0.5, 0.0).otherwise(F.round(g, 2)), F.lit(0.0))
