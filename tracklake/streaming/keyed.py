"""Arriving files with keyed state: each (folder, episode) remembers its winner and tells when it changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WINNER = "nom string, weight int, id long, version long"
CHANGE = "folder_id int, episode long, " + WINNER


def keep_winner(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The heaviest file, ties to the smaller id, with the number of batches that changed it; one row if this batch does."""
    held = state.get if state.exists else None
    best = held
    for frame in frames:
        top = frame.sort_values(["weight", "id"], ascending=[False, True]).iloc[0]
        found = (str(top["nom"]), int(top["weight"]), int(top["id"]))
        if best is None or (-found[1], found[2]) < (-best[1], best[2]):
            best = (*found, 1 if held is None else held[3] + 1)
    if best is not held:
        state.update(tuple(best))
        yield pd.DataFrame([(*key, *best)], columns=["folder_id", "episode", "nom", "weight", "id", "version"])


def changes(files: DataFrame) -> DataFrame:
    """A stream of (folder_id, episode, nom, weight, id) as a stream of winners that changed.

    The state holds one row a key, whatever the number of arrivals, in the checkpointed store of the query.
    """
    return files.select("folder_id", "episode", "nom", "weight", "id").groupBy("folder_id", "episode").applyInPandasWithState(keep_winner, CHANGE, WINNER, "update", GroupStateTimeout.NoTimeout)
