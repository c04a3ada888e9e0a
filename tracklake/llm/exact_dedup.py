"""Exact duplicates as a stream: keyed state on disk, without expiry, and a check of full bytes on every hit.

Three streaming queries follow one another over whatever has arrived; each has its own checkpoint, so each can be
stopped and started again anywhere, and what it writes for an epoch is overwritten when the epoch is run again.

1. `arrive` reads new rows and notes digest, identifier, length and content locator (file, and row in it) of each.
2. `remember` keeps for every digest, in state that never expires (RocksDB, in the checkpoint's folder), the first row seen
   under it (identifier and locator, which never change), the row that stays, and the number of rows; each epoch
   gives the digests that changed. Rows are aggregated before they are shuffled, so a digest may have any number of them.
3. `confirm` looks up the rows that hit a digest of another row, reads both contents by their locators, and compares
   all bytes. The rows of a digest are dealt by slots of about `SLOT`; the first row's content is copied once a slot.

Digests under which unequal contents were met are told apart by the contents themselves (`duplicates`), so the result
is exact for any digest; `width` shortens it, for tests. Nothing runs outside the JVM: no Python worker takes part.

Texts are equal when they are after deleting every character of [\\x20\\x09-\\x0D]; of equal ones the row with the most code
points in its original text, then the smallest identifier, then the first by locator stays. Defined cases: a null text is
empty, and equal to other empty ones; a null identifier takes part and comes after all others; repeated rows are rows
of their own, one of which stays; texts of any length are compared as a whole; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.llm.common import looked_up_by_size
from tracklake.sources.tables import shared_dir

SLOT, FILES, BATCH = 256, 1000, 1 << 38
ARRIVAL = "doc_id long, n_chars int, sha string, digest string, file string, row long, epoch int"
CHANGE = "digest string, n long, first struct<doc_id:long,file:string,row:long>, best struct<fewer:int,missing:boolean,doc_id:long,file:string,row:long>, epoch int"
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space ahead of need
}


def normal(text: Column) -> Column:
    """The text without white space."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def pattern(path: str) -> str:
    """The path as a pattern that matches it alone: a stream can then read a single file as well as a folder."""
    return f"{path[:-1]}[{path[-1]}]"


class ExactDedup:
    """Deduplication of the rows (doc_id, text) that arrive as Parquet under a path; its state lives under `home`."""

    def __init__(self, spark: SparkSession, source: str, home: str | None = None, width: int = 64, files: int | None = None):
        self.spark, self.source, self.width, self.files = spark, source.rstrip("/"), width, files
        self.home = home or f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
        self.schema = spark.read.parquet(self.source).select("doc_id", "text").schema

    def _run(self, rows: DataFrame, name: str, each, mode: str = "append") -> None:
        """Runs the query on all that has arrived, with the state's settings, and puts the session's own back."""
        before = {k: self.spark.conf.get(k, None) for k in STATE}
        for k, v in STATE.items():
            self.spark.conf.set(k, v)
        try:
            query = rows.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{self.home}/checkpoints/{name}").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def _log(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.home}/{name}")

    def _write(self, rows: DataFrame, name: str, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.home}/{name}/epoch={epoch}")

    def _arrivals(self) -> DataFrame:
        return self.spark.readStream.schema(ARRIVAL).parquet(f"{self.home}/arrivals")

    def arrive(self) -> None:
        reader = self.spark.readStream.schema(self.schema)
        reader = reader.option("maxFilesPerTrigger", self.files) if self.files else reader.option("maxBytesPerTrigger", BATCH)
        text, sha = F.coalesce("text", F.lit("")), F.sha2(normal(F.col("text")), 256)
        rows = reader.parquet(pattern(self.source)).select(
            F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("n_chars"), sha.alias("sha"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
        digest = F.substring("sha", 1, self.width).alias("digest")
        self._run(rows, "arrive", lambda batch, epoch: self._write(batch.select("doc_id", "n_chars", "sha", digest, "file", "row"), "arrivals", epoch))

    def remember(self) -> None:
        here = ("doc_id", "file", "row")
        best = F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("missing"), *here)).alias("best")
        state = self._arrivals().groupBy("digest").agg(F.count("*").alias("n"), F.first(F.struct(*here)).alias("first"), best)
        self._run(state, "remember", lambda batch, epoch: self._write(batch, "changes", epoch), "update")

    def known(self) -> DataFrame:
        """The state as of the last epoch: digest, n, first, best."""
        return self._log("changes", CHANGE).groupBy("digest").agg(F.max_by(F.struct("n", "first", "best"), "epoch").alias("s")).select("digest", "s.*")

    def contents(self, places: DataFrame) -> DataFrame:
        """places (file, row and others) with the normalised text found there."""
        files = [r.file for r in places.select("file").distinct().limit(FILES + 1).collect()]
        own = self.spark.read.schema(self.schema).parquet(self.source).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normal(F.col("text")).alias("content"))
        return (own.where(F.col("file").isin(files)) if len(files) <= FILES else own).join(places, ["file", "row"])

    def confirm(self) -> None:
        def check(batch: DataFrame, epoch: int) -> None:
            known = self.known().where("n > 1").select("digest", "n", "first")
            seen = looked_up_by_size(batch.select("digest", "doc_id", "file", "row"), "digest", known, "n")
            slots = F.ceil(F.col("n") / SLOT).cast("int")
            hits = seen.where("file <> first.file or row <> first.row").select(
                "digest", "file", "row", F.array(F.pmod(F.xxhash64("file", "row"), slots).cast("int")).alias("slots"), F.lit(False).alias("is_first")
            )
            # each digest's first row, for as many slots as it has; of digests without new hits it meets no row
            firsts = known.select("digest", "first.file", "first.row", F.sequence(F.lit(0), slots - 1).alias("slots"), F.lit(True).alias("is_first"))
            touched = firsts.join(batch.select("digest").distinct(), "digest", "left_semi")
            dealt = self.contents(hits.unionByName(touched)).withColumn("slot", F.explode("slots"))
            slot = Window.partitionBy("digest", "slot").orderBy(F.desc("is_first")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            compared = dealt.withColumn("other", F.first("content").over(slot))
            self._write(compared.where("content <> other").select("digest").distinct(), "unequal", epoch)

        self._run(self._arrivals(), "confirm", check)

    def advance(self) -> None:
        """Takes in all that has arrived since the last call."""
        self.arrive()
        self.remember()
        self.confirm()

    def duplicates(self) -> DataFrame:
        """One row for each row that arrived: doc_id, keep_id, group_size, kept, text_sha256."""
        rows, known = self._log("arrivals", ARRIVAL).drop("epoch"), self.known()
        unequal = self._log("unequal", "digest string, epoch int").select("digest").distinct()
        stays = (F.col("best.file") == F.col("file")) & (F.col("best.row") == F.col("row"))
        out = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), F.col("sha").alias("text_sha256"))
        plain = out(looked_up_by_size(rows, "digest", known.join(unequal, "digest", "left_anti").select("digest", "n", "best"), "n"))
        if unequal.isEmpty():
            return plain
        # digests that stand for several contents: the contents themselves are the keys
        apart = self.contents(rows.join(unequal, "digest", "left_semi").select("doc_id", "n_chars", "sha", "file", "row"))
        best = F.min(F.struct((-F.col("n_chars")).alias("fewer"), F.col("doc_id").isNull().alias("missing"), "doc_id", "file", "row")).alias("best")
        groups = apart.groupBy("content").agg(F.count("*").alias("n"), best)
        return plain.unionByName(out(looked_up_by_size(apart, "content", groups, "n")))


def exact_duplicates(spark: SparkSession, source: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of the table under a path, taken in as a stream."""
    dedup = ExactDedup(spark, source)
    dedup.advance()
    return dedup.duplicates()
