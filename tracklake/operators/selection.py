"""Choosing tracks: pairwise dominance in the order of streams, group by group."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.rules import better_entry, parse


def beaten(a: dict, b: dict, rules: dict) -> str | None:
    """Which of two tracks goes: "a", "b" or none. Tracks: format, channels, rate, bitrate."""
    if a["format"] == b["format"]:
        if a["channels"] == b["channels"]:
            if a["rate"] >= b["rate"] and a["bitrate"] >= b["bitrate"]:
                return "b"
            return "a" if b["rate"] >= a["rate"] and b["bitrate"] >= a["bitrate"] else None
        more, less, loser = (a, b, "b") if a["channels"] > b["channels"] else (b, a, "a")
        wide = more["rate"] >= less["rate"] and more["bitrate"] / more["channels"] > 0.9 * less["bitrate"] / less["channels"]
        return loser if wide else None
    for winner, other, loser in ((a, b, "b"), (b, a, "a")):
        by = rules.get((winner["format"].lower(), other["format"].lower()))
        if by and winner["rate"] >= other["rate"] and winner["channels"] >= other["channels"] and (by is True or winner["bitrate"] > other["bitrate"] * by):
            return loser
    return None


def dominant(tracks: DataFrame, group: str, order: str, rule_text: str) -> DataFrame:
    """Adds keep to tracks (group, order, format, channels, rate, bitrate): sequential elimination in each group.

    A group is one file's tracks of a language, a handful of rows; a task goes through its groups in one sorted pass.
    """
    rules = parse(rule_text)

    def decide(rows: list[dict], code: list[int]) -> list[bool]:
        keep = [True] * len(rows)
        for i in range(len(rows)):
            j = i + 1
            while keep[i] and j < len(rows) and code[j] == code[i]:
                if keep[j]:
                    out = beaten(rows[i], rows[j], rules)
                    if out:
                        keep[i if out == "a" else j] = False
                j += 1
        return keep

    return group_by_group(tracks, group, order, ["format", "channels", "rate", "bitrate"], decide, "keep")


def worst(tracks: DataFrame, group: str, order: str, rule_text: str) -> DataFrame:
    """Adds is_worst to tracks (group, order, format, bitrate): the one that no other in turn is worse than.

    The first track is held; one that the held track is better than by the rules takes its place.
    """
    rules = parse(rule_text)

    def decide(rows: list[dict], code: list[int]) -> list[bool]:
        held = {}
        for i, c in enumerate(code):
            if c not in held or not better_entry(rules, (rows[i]["format"], rows[i]["bitrate"]), (rows[held[c]]["format"], rows[held[c]]["bitrate"])):
                held[c] = i
        return [held[c] == i for i, c in enumerate(code)]

    return group_by_group(tracks, group, order, ["format", "bitrate"], decide, "is_worst")


def group_by_group(tracks: DataFrame, group: str, order: str, read: list[str], decide, name: str) -> DataFrame:
    """Adds a boolean column by a function of rows and group codes; whole groups in order, one sorted pass a task.

    Ties of the order go by the columns read, so that rows which share a place give the same result in every run.
    """
    columns = tracks.columns

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            code = pd.factorize(pdf[group], use_na_sentinel=False)[0]
            ready = code != code[-1] if len(code) else code == 0
            held = pdf[~ready]  # the last group may go on in the next batch
            if ready.any():
                yield flagged(pdf[ready])
        if held is not None and len(held):
            yield flagged(held)

    def flagged(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pd.factorize(pdf[group], use_na_sentinel=False)[0].tolist()
        return pdf.assign(**{name: decide(pdf[read].to_dict("records"), code)})[[*columns, name]]

    schema = tracks.withColumn(name, F.lit(True)).schema
    return tracks.repartition(group).sortWithinPartitions(group, order, *read).mapInPandas(run, schema)


def better_video(scores: DataFrame) -> DataFrame:
    """a_wins for each pair: its mean score is not below the other's. scores: pair, score_a, score_b."""
    return scores.groupBy("pair").agg((F.avg("score_a") >= F.avg("score_b")).alias("a_wins"), F.avg("score_a").alias("mean_a"), F.avg("score_b").alias("mean_b"))
