"""Queries for refined cuts, spliced tracks, rewritten tracks and keyed streaming state."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracklake.operators import refine, rewriting, routing
from tracklake.operators.spread import numbered
from tracklake.plans.queries import ROUTED_SQL, rule_table
from tracklake.plans.registry import query
from tracklake.sources.tables import shared_dir, table
from tracklake.streaming.keyed import CHANGE, changes

RANGES_SQL = """r AS (SELECT l_orderkey, l_linenumber, l_linenumber * 10.0::DOUBLE AS b, l_linenumber * 10.0::DOUBLE + l_quantity / 8 AS e, CASE WHEN l_linenumber <> 5 THEN 25.0::DOUBLE END AS main, CASE WHEN l_suppkey % 2 = 0 THEN 25.0::DOUBLE ELSE 24.0 END AS target,
 CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 40 END AS g0, CASE WHEN l_partkey % 3 <> 0 THEN l_partkey % 40 + 9 END AS g1, list_transform(range(1, l_partkey % 4 + 1), lambda k: l_linenumber * 10.0::DOUBLE + k * 0.25::DOUBLE) AS scenes,
 CASE WHEN l_linenumber < 3 THEN (l_suppkey % 5) / 8.0::DOUBLE END AS lag FROM lineitem),
w AS (SELECT *, greatest(0.5, e - b) AS len, CASE WHEN main = target AND g0 IS NOT NULL THEN 'frames' WHEN len(scenes) > 0 THEN 'scene' ELSE 'sound' END AS method, scenes[len(scenes) // 2 + 1] AS c FROM r),
v AS (SELECT *, greatest(0.2, least(2.0, len * 0.2)) AS band, greatest(0.0, b - least(4.0, len / 2)) AS padded FROM w),
t AS (SELECT *, CASE method WHEN 'frames' THEN padded + g0 / round_even(target, 0) WHEN 'scene' THEN greatest(b, c - band) ELSE b + coalesce(lag, 0) END AS s, CASE method WHEN 'frames' THEN padded + g1 / round_even(target, 0) WHEN 'scene' THEN least(e, c + band) ELSE e + coalesce(lag, 0) END AS f FROM v)"""


def ranges(spark, d):
    n, p = F.col("l_linenumber"), F.col("l_partkey")
    gap = p % 40
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (n * 10.0).alias("begin_s"), (n * 10.0 + F.col("l_quantity") / 8).alias("end_s"), F.when(n != 5, 25.0).alias("fps_main"), F.when(F.col("l_suppkey") % 2 == 0, 25.0).otherwise(24.0).alias("fps_target"),
        F.when(p % 3 != 0, gap).alias("gap_begin"), F.when(p % 3 != 0, gap + 9).alias("gap_end"), F.when(p % 4 > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), p % 4), lambda k: n * 10.0 + k * 0.25)).otherwise(F.array().cast("array<double>")).alias("scene_s"),
        F.when(n < 3, (F.col("l_suppkey") % 5) / 8.0).alias("lag_s"))


@query(f"WITH {RANGES_SQL} SELECT l_orderkey, l_linenumber, method, round(s, 6) AS start_s, round(f, 6) AS end_s FROM t")
def cut_refinement(spark, d):
    return refine.refined(ranges(spark, d)).select("l_orderkey", "l_linenumber", "method", F.round("start_s", 6).alias("start_s"), F.round("end_at_s", 6).alias("end_s"))


@query(f"""WITH {RANGES_SQL}, seg AS (SELECT l_orderkey, avg(0.75 + (l_partkey % 25) / 100.0::DOUBLE) AS mean, bool_and(l_suppkey % 3 > 0) AS torn FROM lineitem GROUP BY l_orderkey),
cut AS (SELECT l_orderkey, count(*) AS n, count_if(l_quantity > 49) AS open, var_pop(lag) AS spread FROM t JOIN lineitem USING (l_orderkey, l_linenumber) GROUP BY l_orderkey),
j AS (SELECT l_orderkey, mean, coalesce(n, 0) AS cuts, CASE WHEN mean IS NULL THEN 'no measurement' WHEN coalesce(n, 0) = 0 THEN NULL WHEN torn AND NOT coalesce(spread <= 0.12, false) THEN 'conflicting offsets' WHEN open > 0 THEN 'range not refined' WHEN mean < 0.85 THEN 'low fidelity' END AS reason FROM seg FULL JOIN cut USING (l_orderkey))
SELECT l_orderkey, round(mean, 6) AS mean_fidelity, cuts, reason IS NOT NULL AS incompatible, reason FROM j""")
def cut_verdict(spark, d):
    lines = table(spark, d, "lineitem")
    segments = lines.select("l_orderkey", (F.lit(0.75) + (F.col("l_partkey") % 25) / 100.0).alias("fidelity"), F.when(F.col("l_suppkey") % 3 > 0, 2).otherwise(1).alias("offsets"))
    found = refine.refined(ranges(spark, d)).join(lines.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])
    found = found.select("l_orderkey", F.when(F.col("l_quantity") <= 49, F.col("method")).alias("method"), "lag_s")
    return refine.verdict(segments, found, "l_orderkey").withColumn("mean_fidelity", F.round("mean_fidelity", 6))


@query("""WITH b AS (SELECT label AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS block, embedding FROM embeddings), x AS (SELECT file, block * 64 + i AS pos, embedding[i + 1]::DOUBLE AS v FROM b, (SELECT unnest(range(0, 64)) AS i)),
c AS (SELECT * FROM (SELECT DISTINCT label AS file FROM embeddings), (VALUES (0, 0.0::DOUBLE, 0.7::DOUBLE), (1, 1.25, 1.5), (2, 4.0, 6.3)) k(cut, s, e)),
p AS (SELECT file, cut, 0 AS piece, round(greatest(0, s - 0.5) * 100) AS a, round((s + 0.05) * 100) AS z FROM c WHERE s - 0.05 > 0.005 UNION ALL SELECT file, cut, 1, round((e + 0.01) * 100), round((e + 0.01 + 5.0) * 100) FROM c)
SELECT file, cut, row_number() OVER (PARTITION BY file, cut ORDER BY piece, pos) - 1 AS pos, v FROM p JOIN x USING (file) WHERE pos >= a AND pos < z""")
def splice_samples(spark, d):
    rows = table(spark, d, "embeddings")
    blocks = rows.select(F.col("label").alias("file"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    blocks = numbered(blocks, ["file"], "vec_id", "block").withColumn("block", F.col("block") - 1)
    at = spark.createDataFrame([(0, 0.0, 0.7), (1, 1.25, 1.5), (2, 4.0, 6.3)], "cut int, start_s double, end_s double")
    cuts = rows.select(F.col("label").alias("file")).distinct().join(F.broadcast(at))  # three rows
    return refine.spliced(blocks, cuts, 100, 64).select("file", "cut", F.posexplode("samples").alias("pos", "v")).withColumn("pos", F.col("pos").cast("long"))


TRACKS_SQL = """t AS (SELECT conv_id AS grp, turn % 2 AS file, turn, CASE WHEN role = 'user' THEN 'subtitle' WHEN length(text) % 2 = 0 THEN 'audio' ELSE 'commentary' END AS kind, CASE WHEN length(text) % 7 = 0 THEN 'xx' ELSE 'en' END AS language, length(text) % 5 > 0 AS keep,
 CASE WHEN length(text) % 3 = 0 THEN 'a' WHEN length(text) % 3 = 1 THEN '' ELSE 'b' END AS md5, CASE WHEN turn % 4 = 3 THEN length(text) % 2 END AS size FROM conversations),
e AS (SELECT *, CASE WHEN kind = 'subtitle' THEN 'subtitle' ELSE 'audio' END AS scope, CASE WHEN language = 'xx' THEN 'language' WHEN NOT keep THEN 'not kept' WHEN coalesce(size, 1) = 0 THEN 'empty' END AS early FROM t),
k AS (SELECT *, coalesce(early, CASE WHEN md5 <> '' AND row_number() OVER (PARTITION BY grp, scope, md5, early IS NULL ORDER BY file, turn, kind) > 1 THEN 'same hash' END) AS reason FROM e)"""


def tracks(spark, d):
    n = F.length("text")
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("grp"), (F.col("turn") % 2).alias("file"), F.col("turn").cast("string").alias("stream_order"), F.when(F.col("role") == "user", "subtitle").when(n % 2 == 0, "audio").otherwise("commentary").alias("kind"),
        F.when(n % 7 == 0, "xx").otherwise("en").alias("language"), (n % 5 > 0).alias("keep"), F.when(n % 3 == 0, "a").when(n % 3 == 1, "").otherwise("b").alias("md5"), F.when(F.col("turn") % 4 == 3, n % 2).alias("stream_size"),
        F.lit(None).cast("double").alias("duration_s"), F.element_at(F.array(*map(F.lit, ("SRT", "ass", "xsub"))), (n % 3 + 1).cast("int")).alias("format"), (F.col("turn") / 2).alias("delay"))


@query(f"WITH {TRACKS_SQL} SELECT grp, file, turn, scope, reason IS NULL AS kept, reason FROM k")
def rewrite_selection(spark, d):
    return rewriting.selection(tracks(spark, d), ["xx"]).select("grp", "file", F.col("stream_order").cast("long").alias("turn"), "scope", "kept", "reason")


@query(f"""WITH {TRACKS_SQL} SELECT k.grp, k.file, k.turn, k.scope, row_number() OVER (PARTITION BY k.grp, k.file, k.scope ORDER BY k.turn, k.kind) - 1 AS place,
 CASE WHEN k.scope = 'audio' OR length(c.text) % 3 = 2 THEN 'copy' WHEN length(c.text) % 3 = 0 THEN 'srt' ELSE 'ass' END AS codec, '{{"original_position":' || k.turn || ',"original_delay":' || (k.turn / 2)::VARCHAR || '}}' AS tag
 FROM k JOIN conversations c ON c.conv_id = k.grp AND c.turn = k.turn WHERE reason IS NULL""")
def rewrite_first_pass(spark, d):
    chosen = rewriting.selection(tracks(spark, d), ["xx"])
    return rewriting.first_pass(chosen).select("grp", "file", F.col("stream_order").cast("long").alias("turn"), "scope", "place", "codec", "tag")


@query("SELECT o_orderkey, round(o_totalprice - delay / 1000.0::DOUBLE, 6) AS first_length_s, greatest(delay, 0) / 1000.0::DOUBLE AS offset_s, greatest(-delay, 0) / 1000.0::DOUBLE AS seek_s FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 4001 - 2000 AS delay FROM orders)")
def rewrite_times(spark, d):
    files = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("duration_s"), (F.col("o_orderkey") % 4001 - 2000).alias("delay_ms"))
    return rewriting.times(files).select("o_orderkey", F.round("first_length_s", 6).alias("first_length_s"), "offset_s", "seek_s")


@query(f"WITH {ROUTED_SQL} SELECT folder_id, episode, nom, weight, id FROM (SELECT *, row_number() OVER (PARTITION BY folder_id, episode ORDER BY weight DESC, id) AS rn FROM episodes WHERE episode IS NOT NULL) WHERE rn = 1")
def stream_keyed_state(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    named = stream.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("_E"), (F.col("event_id") % 30).cast("string"), F.lit(".mkv")).alias("nom"))
    folder = f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}"

    def each(batch, epoch):
        found = routing.episodes_of(batch, rule_table(spark)).where("episode is not null")
        found.select("folder_id", "episode", "nom", "weight", "id").write.mode("overwrite").parquet(f"{folder}/arrived/batch={epoch}")

    named.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/routed").trigger(availableNow=True).start().awaitTermination()
    arrived = spark.readStream.schema("folder_id int, episode long, nom string, weight int, id long").parquet(f"{folder}/arrived")

    def keep(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/changed/epoch={epoch}")

    changes(arrived).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/kept").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema(CHANGE).parquet(f"{folder}/changed")
    return log.groupBy("folder_id", "episode").agg(F.max_by(F.struct("nom", "weight", "id"), "version").alias("w")).select("folder_id", "episode", "w.nom", "w.weight", "w.id")
