"""Arriving files as a stream: micro-batches that keep one winner for each (folder, episode)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracklake.operators.routing import episodes_of, winners, with_rejects
from tracklake.sources.tables import remove, shared_dir

STATE = "folder_id int, episode long, nom string, weight int, id long, size long, signature string"
KEEP = ["folder_id", "episode", "nom", "weight", "id"]
EVERY = [c.split()[0] for c in STATE.split(", ")]
CLASS = ["folder_id", "episode", "signature"]
FOLDS = "through int, parts array<int>"


class EpisodeState:
    """The winners as a log in a folder: each batch adds the files that beat what was there before, under its own number.

    Files may bring a signature (equal ones merge) and a size; the winner of each signature is kept, so that files which
    don't merge with the primary one are told by `incompatible`.

    All there is to know lies in the folder, so a new object on it goes on where the old one stopped. A batch that comes
    again compares with the batches before it and rewrites its own part alone. Each part holds at most one row a key,
    and a key comes again only with a better file.

    Before the first batch that finds `fold` parts since the last fold, they are folded with it into one table, so what a
    batch reads grows with the keys and not with the batches. A fold counts once its line in the list of folds is there
    (one file, moved into place at once); one cut short is done again. What a fold has replaced goes at the next one, so
    readers that began before it end well. A batch that is folded already changes nothing when it comes again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, fold: int = 50):
        self.spark, self.fold = spark, fold
        self.folder = folder or f"{shared_dir(spark)}/episodes-{uuid.uuid4().hex}"
        self.path = f"{self.folder}/state"
        spark.createDataFrame([], STATE).write.mode("overwrite").parquet(f"{self.path}/epoch=-1")
        spark.createDataFrame([], FOLDS).write.mode("append").parquet(f"{self.folder}/folds")

    def read(self, spark: SparkSession | None = None, before: int | None = None) -> DataFrame:
        """The winners, of all batches or of those before one."""
        return winners(self.classes(spark, before).select(*KEEP)).select(*KEEP)

    def classes(self, spark: SparkSession | None = None, before: int | None = None) -> DataFrame:
        """The best file of each signature."""
        spark = spark or self.spark
        folds = self.folds(spark)
        through = folds[0].through if folds else None
        if through is not None and before is not None and before <= through:
            raise ValueError(f"the batches up to {through} are folded into one")
        log = self.log(spark)
        log = log if before is None else log.where(F.col("epoch") < before)
        log = (log if through is None else log.where(F.col("epoch") > through)).drop("epoch")
        return self.best(log if through is None else log.unionByName(spark.read.schema(STATE).parquet(self.folded(through))))

    def log(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"{STATE}, epoch int").parquet(self.path)

    def folded(self, through: int) -> str:
        return f"{self.folder}/folded/through-{through}"

    def folds(self, spark: SparkSession) -> list:
        """The last two folds, the latest first: the last batch in each, and the parts that it replaced."""
        return spark.read.schema(FOLDS).parquet(f"{self.folder}/folds").orderBy(F.desc("through")).limit(2).collect()

    def compact(self, before: int, spark: SparkSession | None = None) -> bool:
        """Folds the parts of the batches before one, if there are `fold` of them since the last fold."""
        spark = spark or self.spark
        folds = self.folds(spark)
        since = folds[0].through if folds else -1
        # numbers of batches, at most twice `fold` of them are left in the log
        parts = [r.epoch for r in self.log(spark).where((F.col("epoch") > since) & (F.col("epoch") < before)).select("epoch").distinct().collect()]
        if len(parts) < self.fold:
            return False
        through = max(parts)
        self.classes(spark, before).write.mode("overwrite").parquet(self.folded(through))
        spark.createDataFrame([(through, sorted(parts))], FOLDS).coalesce(1).write.mode("append").parquet(f"{self.folder}/folds")
        if folds:
            remove(spark, [f"{self.path}/epoch={e}" for e in folds[0].parts])
        if len(folds) > 1:
            remove(spark, [self.folded(folds[1].through)])
        return True

    def incompatible(self) -> DataFrame:
        """The best file of each signature that isn't the primary one's."""
        return with_rejects(self.classes()).where("role = 'incompatible'").drop("role", "files")

    @staticmethod
    def best(files: DataFrame) -> DataFrame:
        rest = [c for c in EVERY if c not in CLASS]
        return files.groupBy(*CLASS).agg(F.min_by(F.struct(*rest), F.struct(-F.col("weight"), F.col("id"))).alias("w")).select(*CLASS, "w.*").select(*EVERY)

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Adds a batch of files: the columns of KEEP, and size and signature if there are any."""
        self.compact(epoch, batch.sparkSession)
        folds = self.folds(batch.sparkSession)
        if folds and epoch <= folds[0].through:
            return
        added = {c: F.lit(None) for c in ("size", "signature") if c not in batch.columns}
        new = self.best(batch.withColumns({c: v.cast("long" if c == "size" else "string") for c, v in added.items()}))
        held = self.classes(batch.sparkSession, epoch).select(*(F.col(c).alias(f"_{c}") for c in (*CLASS, "weight", "id")))
        same = F.lit(True)
        for c in CLASS:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        better = F.col("_weight").isNull() | (F.col("weight") > F.col("_weight")) | ((F.col("weight") == F.col("_weight")) & (F.col("id") < F.col("_id")))
        new.join(held, same, "left").where(better).select(*EVERY).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")


def watch(names: DataFrame, rules: DataFrame, state: EpisodeState, **trigger) -> StreamingQuery:
    """Routes a stream of names (id, nom) and merges each micro-batch into the state."""

    def each(batch: DataFrame, epoch: int) -> None:
        state.merge(episodes_of(batch, rules).where("episode is not null"), epoch)

    return names.writeStream.foreachBatch(each).option("checkpointLocation", f"{state.folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
