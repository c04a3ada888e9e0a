"""Files that fitted nothing so far, kept by episode in a table of each batch; arriving ones try them in turn.

An arriving file is tried with the candidates of its (folder, episode), heaviest first. The first one that fits is merged with it:
the candidate's row then carries the name, weight and size of the better file (the heavier, of equal weights the larger, of equal
sizes the arriving one) and what both hold. Each candidate tried in vain before is a row of the error log. A file that fits none
becomes a candidate itself.

What files hold is a number of bits (languages, say); two files fit if they share one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.sources.tables import shared_dir

KEY = ["folder_id", "episode"]
# kind: candidate (the row at place is now this file), merged (nom went into other), failed (nom doesn't fit other), held (in the log
# alone: a candidate after the batch)
EVENT = "folder_id int, episode long, step long, kind string, place long, nom string, weight int, size long, holds long, other string, reason string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
MISSING = "nothing in common"
FOLD, ROWS, AT_ONCE = 50, 1 << 20, 8192  # batches until all candidates are written again, rows of a task, events of a batch


def tried(held: list[tuple], file: tuple) -> tuple[list[tuple], list[tuple]]:
    """held (place, nom, weight, size, holds) after a file (nom, weight, size, holds) has tried them, and what happened:
    (kind, place, nom, weight, size, holds, other, reason). Of equal weights the earlier place is tried first."""
    nom, weight, size, holds = file
    events = []
    for row in sorted(held, key=lambda r: (-r[2], r[0])):
        place, other = row[0], row[1]
        if not row[4] & holds:
            events.append(("failed", place, *file, other, MISSING))
            continue
        ahead = (weight, size) >= (row[2], row[3])
        best = (nom, weight, size) if ahead else row[1:4]
        now = (place, *best, row[4] | holds)
        events += [("merged", place, *file, other, None), ("candidate", *now, None, None)]
        return [now if r[0] == place else r for r in held], events
    new = (len(held), *file)
    return [*held, new], [*events, ("candidate", *new, None, None)]


def trials(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
    """EVENT rows from rows of TRIED, sorted by key, the candidates of an episode before its arrivals, latest batch first.

    Rows go one by one, so that a task holds an episode's candidates but not its arrivals. Episodes with arrivals (every: all)
    end with their candidates, as rows of kind held with the number of events so far; that number orders the events.
    """
    schema = pa.schema([("folder_id", pa.int32()), ("episode", pa.int64()), ("step", pa.int64()), ("kind", pa.string()), ("place", pa.int64()), ("nom", pa.string()), ("weight", pa.int32()), ("size", pa.int64()), ("holds", pa.int64()), ("other", pa.string()), ("reason", pa.string())])
    key, held, n, epoch, touched, out = None, [], 0, None, False, []
    ended = lambda: [(*key, n, "held", *row, None, None) for row in held] if key and (touched or every) else []
    packed = lambda: pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for batch in batches:
        for folder, number, late, before, place, nom, weight, size, holds, step in zip(*(batch.column(c).to_pylist() for c in ("folder_id", "episode", "late", "epoch", "place", "nom", "weight", "size", "holds", "step")), strict=True):
            if (folder, number) != key:
                out += ended()
                key, held, n, epoch, touched = (folder, number), [], 0, before, False
            if late:
                held, events = tried(held, (nom, weight, size, holds))
                out += [(*key, n + i, *e) for i, e in enumerate(events)]
                n, touched = n + len(events), True
            elif before == epoch:  # what it held in earlier batches is outdated
                held.append((place, nom, weight, size, holds))
                n = step
            if len(out) >= AT_ONCE:
                yield packed()
                out = []
    out += ended()
    if out:
        yield packed()


def standing(log: DataFrame) -> DataFrame:
    """The candidates as they are after all events: folder_id, episode, place, nom, weight, size, holds."""
    last = log.where("kind = 'candidate'").groupBy(*KEY, "place").agg(F.max_by(F.struct("nom", "weight", "size", "holds"), "step").alias("w"))
    return last.select(*KEY, "place", "w.*")


class Candidates:
    """Arrivals and events in a folder. A new object on the folder goes on where the old one stopped.

    A batch that comes again rewrites its own events alone, from the candidates before it. Each batch writes the candidates
    of the episodes that it touched, every FOLD-th one those of all, so a batch reads what has changed since.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_dir(spark)}/candidates-{uuid.uuid4().hex}"

    def add(self, files: DataFrame) -> None:
        """Arrivals (folder_id, episode, id, nom, weight, size, holds) of one batch; they are tried by the next `run`."""
        types = {"folder_id": "int", "episode": "long", "id": "long", "nom": "string", "weight": "int", "size": "long", "holds": "long"}
        files.select(*(F.col(c).cast(t).alias(c) for c, t in types.items())).write.mode("append").parquet(f"{self.folder}/arrived")

    def run(self) -> None:
        """Tries what has arrived since the last run, as one batch."""
        arrived = self.spark.readStream.schema("folder_id int, episode long, id long, nom string, weight int, size long, holds long").parquet(f"{self.folder}/arrived")

        def keep(batch: DataFrame, epoch: int) -> None:
            every = epoch % FOLD == FOLD - 1
            rows = batch.select(*KEY, F.lit(True).alias("late"), F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("place"), "nom", "weight", "size", "holds", "id", F.lit(0).cast("long").alias("step"))
            if epoch:
                held = self.log().where((F.col("kind") == "held") & (F.col("epoch") >= epoch // FOLD * FOLD - 1) & (F.col("epoch") < epoch))
                rows = rows.unionByName(held.select(*KEY, F.lit(False).alias("late"), "epoch", "place", "nom", "weight", "size", "holds", F.lit(None).cast("long").alias("id"), "step"))
            n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // ROWS + 1)
            rows = rows.repartition(n, *KEY).sortWithinPartitions(*KEY, "late", F.desc("epoch"), "id", "place", "nom")
            rows.mapInArrow(lambda b: trials(b, every), EVENT).write.mode("overwrite").partitionBy("kind").parquet(f"{self.folder}/events/epoch={epoch}")

        arrived.writeStream.foreachBatch(keep).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start().awaitTermination()

    def log(self) -> DataFrame:
        return self.spark.read.schema(f"{EVENT}, epoch int").parquet(f"{self.folder}/events")

    def events(self) -> DataFrame:
        return self.log().where("kind <> 'held'").select(*COLUMNS)

    def errors(self) -> DataFrame:
        """Each candidate that a file tried in vain: folder_id, episode, step, nom, other, reason."""
        return self.events().where("kind = 'failed'").select(*KEY, "step", "nom", "other", "reason")


def tried_in_turn(spark: SparkSession, batches: Iterable[DataFrame]) -> Candidates:
    """The candidates after several batches, one run of the stream each."""
    state = Candidates(spark)
    for files in batches:
        state.add(files)
        state.run()
    return state
