"""The preference-rule language: chains of formats, `a*1.1>b=c>d`, rules separated by commas.

A level's members beat those of all later levels: without a factor always, with one by that factor
(factors along a chain multiply, and a level without one makes the earlier ones unconditional).
Where the level just before has no factor, what a weaker format beats always or by more than 5 is beaten by the
better one too. Members joined by `=` have no relation, whatever else gave them one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

ALWAYS = True


def parse(text: str) -> dict[tuple[str, str], bool | float]:
    """(winner, loser) to True, False or a factor."""
    found: dict[tuple[str, str], bool | float] = {}
    equal: set[tuple[str, str]] = set()
    closing: list[tuple[str, str]] = []
    for chain in filter(None, (c.strip() for c in text.lower().split(","))):
        earlier: list[tuple[list[str], bool | float]] = []
        for level in chain.split(">"):
            body, _, factor = level.strip().partition("*")
            names = [n.strip() for n in body.split("=") if n.strip()]
            equal |= {(a, b) for a in names for b in names if a != b}
            for members, by in earlier:
                for strong in members:
                    for weak in names:
                        if strong != weak:
                            relate(found, strong, weak, by)
            if earlier and earlier[-1][1] is ALWAYS:
                closing += [(s, w) for s in earlier[-1][0] for w in names if s != w]
            own = float(factor) if factor.strip() else ALWAYS
            earlier = [(m, ALWAYS if own is ALWAYS or by is ALWAYS else by * own) for m, by in earlier]
            earlier.append((names, own))
    for best, weak in closing:
        inherit(found, best, weak, {best, weak})
        found[best, weak], found[weak, best] = True, False
    for pair in equal:
        found.pop(pair, None)
    return found


def relate(found: dict, strong: str, weak: str, by: bool | float) -> None:
    if by is ALWAYS:
        found[strong, weak], found[weak, strong] = True, False
        return
    back = found.get((weak, strong))
    if (strong, weak) not in found and back is None:
        found[strong, weak], found[weak, strong] = by, False
    elif found.get((strong, weak)) is False and isinstance(back, float) and back >= 1 and by >= 1:
        found[strong, weak] = by  # only what the other direction had ruled out; a factor that is there stays


def inherit(found: dict, best: str, weak: str, seen: set[str]) -> None:
    """What weak surely beats, best beats; seen holds the formats on the way, so that cycles end."""
    for (winner, loser), by in list(found.items()):
        if winner == weak and loser not in seen and (by is True or (by is not False and by > 5)):
            found[best, loser], found[loser, best] = True, False
            inherit(found, best, loser, seen | {loser})


def relation(spark: SparkSession, text: str) -> DataFrame:
    """winner, loser, unconditional and factor (null where unconditional), without the reversed entries."""
    rows = [(a, b, by is True, None if by is True else float(by)) for (a, b), by in sorted(parse(text).items()) if by is not False]
    return spark.createDataFrame(rows, "winner string, loser string, unconditional boolean, factor double")


def relations(texts: DataFrame) -> DataFrame:
    """key, winner, loser, unconditional and factor of the rules of each row (key, text); a null text has none."""

    def run(batches):
        for b in batches:
            rows = [(k, w, v, by is True, None if by is True else float(by)) for k, t in zip(b["key"], b["text"], strict=True) for (w, v), by in sorted(parse(t or "").items()) if by is not False]
            yield pd.DataFrame(rows, columns=["key", "winner", "loser", "unconditional", "factor"])

    return texts.select("key", "text").mapInPandas(run, f"key {texts.schema['key'].dataType.simpleString()}, winner string, loser string, unconditional boolean, factor double")


def compare(rules: dict, challenger: tuple[str, float], base: tuple[str, float]) -> int:
    """1 if the challenger's rate times its factor is above the base's, 0 if below, 2 where both are good."""
    by = rules.get((challenger[0].lower(), base[0].lower()))
    if by is None:
        return 2
    if isinstance(by, bool):
        return int(by)
    return 2 if challenger[1] * by == base[1] else int(challenger[1] * by > base[1])


def better_entry(rules: dict, challenger: tuple[str, float], base: tuple[str, float]) -> bool:
    """Whether a track takes the place of another: by rate among equal formats, else by the rules, the base on a tie."""
    if challenger[0] == base[0]:
        return base[1] < challenger[1]
    return compare(rules, challenger, base) == 1


def better_encoding(base_rate: float, base_level: float, rate: float, level: float) -> bool:
    """Whether an encoding by the same encoder is better: a twentieth of its rate more for each level above the other's."""
    return base_rate < rate * (1 + 0.05 * (level - base_level))
