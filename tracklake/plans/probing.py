"""Queries for files of samples, probed offsets, cascades of deletes, candidates tried in turn, and whole merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tracklake.operators import catalog, measuring, probes, whole
from tracklake.operators.catalog import Link
from tracklake.operators.spread import numbered
from tracklake.plans.queries import RULE_TEXT, sounded, words_of
from tracklake.plans.registry import query
from tracklake.sources import sound
from tracklake.sources.tables import cut, shared_dir, table
from tracklake.streaming import candidates


@query("""WITH x AS (SELECT vec_id // 256 AS f, unnest(embedding)::DOUBLE AS v, vec_id, generate_subscripts(embedding, 1) AS i FROM embeddings),
n AS (SELECT f, coalesce(v, 0) AS v, row_number() OVER (PARTITION BY f ORDER BY vec_id, i) - 1 AS p FROM x)
SELECT 'f' || f || CASE WHEN f % 2 = 0 THEN '.wav' ELSE '.f32' END AS file, (CASE WHEN f % 2 = 0 THEN 8000 ELSE 44100 END)::INTEGER AS rate, p // 1000 AS block, count(*) AS samples, arg_min(v, p) AS first, arg_max(v, p) AS last, round(sum(v * (p % 1000 + 1)), 4) AS weighed FROM n GROUP BY ALL""")
def sound_blocks(spark, d):
    """The vectors as files of samples, 256 vectors a file, written and read back in ranges of 16 KB."""
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 256).alias("f"), "vec_id", F.expr("transform(embedding, x -> coalesce(cast(x as double), 0))").alias("samples")).where(F.size("samples") > 0)
    name = F.concat(F.lit("f"), F.col("f").cast("string"), F.when(F.col("f") % 2 == 0, ".wav").otherwise(".f32"))
    total = rows.groupBy("f").agg(F.sum(F.size("samples")).alias("total"))
    folder = f"{shared_dir(spark)}/sound-{uuid.uuid4().hex}"
    sound.stored(rows.join(total, "f").select(name.alias("file"), F.col("vec_id").alias("block"), "samples", F.lit(8000).alias("rate"), "total"), folder).write.format("noop").mode("overwrite").save()
    sound.register(spark)
    found = spark.read.format("samples").option("block", 1000).option("bytes", 16_384).load(folder)
    weighed = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return found.select("file", "rate", "block", F.size("samples").cast("long").alias("samples"), F.col("samples")[0].alias("first"), F.element_at("samples", -1).alias("last"), F.round(weighed, 4).alias("weighed"))


def torn(spark, d):
    """Recordings of 64 samples a second, every fourth torn in the middle by a second and a half."""
    some, samples = sounded(spark, d, F.when((F.col("match") % 4 == 3) & (F.col("n") >= F.col("c") * 32), 96).otherwise(0))
    return some, measuring.Tracks(samples, samples, samples.limit(0), 8.0, 64.0)


TORN_SQL = "m AS (SELECT label::BIGINT AS match, count(*) AS c, label % 4 = 3 AS torn, label % 5 * 40 / 64.0::DOUBLE AS d FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 45)"


@query(f"""WITH {TORN_SQL}, p AS (SELECT *, (k + 1) * c::DOUBLE / 6 AS x, d + CASE WHEN torn AND k >= 3 THEN 1.5 ELSE 0 END AS y FROM m, (SELECT unnest(range(0, 5)) AS k))
SELECT match, round(regr_slope(y, x), 6) + 0 AS slope, count(*) AS n, CASE WHEN torn THEN 'step' ELSE 'constant' END AS kind, CASE WHEN torn THEN round(c::DOUBLE / 2, 6) END AS "at", d AS "before", CASE WHEN torn THEN d + 1.5 END AS "after" FROM p GROUP BY match, torn, c, d""")
def offset_probes(spark, d):
    """Five probes over each recording, the drift of their offsets, and the step that explains them."""
    some, t = torn(spark, d)
    probed = cut(probes.measured(t, probes.spread_over(some.select("match", F.col("c").cast("double").alias("duration_s")))))
    line = probes.drifting(probed).select("match", (F.round("slope", 6) + 0).alias("slope"))
    fit = probes.step(probed, "match", "center_s", "delay_s")
    return line.join(fit, "match").select("match", "slope", "n", "kind", F.round("at", 6).alias("at"), F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query(f"WITH {TORN_SQL} SELECT match, r AS range_, CASE WHEN torn AND r = 1 THEN 0.5 ELSE 0 END::DOUBLE AS spread, NOT (torn AND r = 1) AS agrees, NOT torn AS settled FROM m, (SELECT unnest([0, 1])::BIGINT AS r)")
def conflict_probes(spark, d):
    """Two ranges of each recording, the second about its middle, with three probes each."""
    some, t = torn(spark, d)
    middle = F.col("c") / 2
    at = F.array(F.struct(F.lit(0).cast("long").alias("range_"), F.lit(2.0).alias("start_s"), F.lit(14.0).alias("end_s")), F.struct(F.lit(1).cast("long").alias("range_"), (middle - 20).alias("start_s"), (middle + 20).alias("end_s")))
    grid = probes.within(some.select("match", F.inline(at)))
    found = cut(probes.agreeing(probes.measured(t, grid)))
    verdict = probes.settled(some.select("match", F.lit(True).alias("all_torn")), found)
    return found.join(verdict, "match").select("match", "range_", F.round("spread", 6).alias("spread"), "agrees", "settled")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS x FROM events),
y AS (SELECT user_id, x, user_id % 7 / 4.0::DOUBLE + CASE WHEN user_id % 3 = 0 AND x > 3 + user_id % 4 THEN 2.0::DOUBLE WHEN user_id % 3 = 1 AND x % 2 = 0 THEN 3.0 ELSE 0 END + event_id % 5 / 64.0::DOUBLE AS y FROM r),
s AS (SELECT user_id, x, count(*) OVER a AS k, avg(y) OVER a AS m1, avg(y) OVER z AS m2, count(*) OVER a * var_pop(y) OVER a AS c1, coalesce(count(*) OVER z * var_pop(y) OVER z, 0) AS c2 FROM y
 WINDOW a AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY user_id ORDER BY x ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(c1 + c2, 9), x) AS rn FROM s WHERE m2 IS NOT NULL) WHERE rn = 1),
w AS (SELECT user_id, count(*) AS n, avg(y) AS m, var_pop(y) AS v FROM y GROUP BY user_id),
j AS (SELECT w.*, b.x, m1, m2, c1 + c2 AS c, CASE WHEN v <= 0.12 THEN 'constant' WHEN (c1 + c2) / n <= 0.12 THEN 'step' ELSE 'unsettled' END AS kind FROM w LEFT JOIN b USING (user_id))
SELECT user_id, n, kind, CASE WHEN kind = 'step' THEN x END AS "at", round(CASE WHEN kind = 'step' THEN m1 ELSE m END, 6) AS "before", round(CASE WHEN kind = 'step' THEN m2 END, 6) AS "after", round(CASE WHEN kind = 'step' THEN c / n ELSE v END, 6) AS mse FROM j""")
def offset_step(spark, d):
    """Offsets of each user's segments with a step planted in a third of them; in another third they change to and fro."""
    rows = numbered(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "x")
    u = F.col("user_id")
    jump = F.when((u % 3 == 0) & (F.col("x") > 3 + u % 4), 2.0).when((u % 3 == 1) & (F.col("x") % 2 == 0), 3.0).otherwise(0.0)
    fit = probes.step(rows.select("user_id", "x", (u % 7 / 4.0 + jump + F.col("event_id") % 5 / 64.0).alias("y")), "user_id", "x", "y")
    return fit.withColumns({c: F.round(c, 6) for c in ("before", "after", "mse")})


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal > 9000 THEN NULL ELSE c_nationkey END AS nk, c_acctbal FROM customer),
n1 AS (SELECT n_nationkey AS id, CASE WHEN n_regionkey = 3 THEN 'deleted' END AS reason FROM nation),
c1 AS (SELECT c_custkey AS id, CASE WHEN c_acctbal < -900 THEN 'deleted' WHEN n1.id IS NULL THEN 'orphan' WHEN n1.reason IS NOT NULL THEN 'cascade' END AS reason FROM c LEFT JOIN n1 ON nk = n1.id),
o1 AS (SELECT o_orderkey AS id, CASE WHEN c1.id IS NULL THEN 'orphan' WHEN c1.reason IS NOT NULL THEN 'cascade' END AS reason FROM orders LEFT JOIN c1 ON o_custkey = c1.id),
l1 AS (SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN o1.id IS NULL THEN 'orphan' WHEN o1.reason IS NOT NULL THEN 'cascade' END AS reason FROM lineitem LEFT JOIN o1 ON l_orderkey = o1.id)
SELECT 'nation' AS level, id::BIGINT AS id, NULL::INTEGER AS line, reason FROM n1 UNION ALL SELECT 'customer', id, NULL, reason FROM c1 UNION ALL SELECT 'orders', id, NULL, reason FROM o1 UNION ALL SELECT 'lineitem', id, line, reason FROM l1""")
def delete_cascade(spark, d):
    """Deleted nations and customers, and what goes with them down to the lines of orders; each row with its reason, if it goes."""
    t = {n: table(spark, d, n) for n in ("nation", "customer", "orders", "lineitem")}
    lost_key = (F.col("c_mktsegment") == "BUILDING") & (F.col("c_acctbal") > 9000)
    t = {
        "nation": t["nation"].select("n_nationkey", "n_regionkey"), "customer": t["customer"].select("c_custkey", F.when(~lost_key, F.col("c_nationkey")).alias("c_nationkey"), "c_acctbal"),
        "orders": t["orders"].select("o_orderkey", "o_custkey"), "lineitem": t["lineitem"].select("l_orderkey", "l_linenumber")}
    links = [Link("nation", "n_nationkey", "customer", "c_nationkey"), Link("customer", "c_custkey", "orders", "o_custkey"), Link("orders", "o_orderkey", "lineitem", "l_orderkey")]
    doomed = {"nation": t["nation"].where("n_regionkey = 3").select("n_nationkey"), "customer": t["customer"].where("c_acctbal < -900").select("c_custkey")}
    kept, lost = catalog.cascade(t, links, doomed)
    ids = {"nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    rows = None
    for level, key in ids.items():
        line = F.col("l_linenumber") if level == "lineitem" else F.lit(None).cast("int")
        for df, reason in ((kept[level], F.lit(None).cast("string")), (lost[level], F.col("reason"))):
            one = df.select(F.lit(level).alias("level"), F.col(key).cast("long").alias("id"), line.alias("line"), reason.alias("reason"))
            rows = one if rows is None else rows.unionByName(one)
    return rows


@query("""WITH RECURSIVE a AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS i, 'f' || o_orderkey AS nom, (o_orderkey % 4)::INTEGER AS weight, floor(o_totalprice)::BIGINT AS size, (1::BIGINT << (o_orderkey % 7)::INTEGER) AS holds FROM orders),
r AS (SELECT k, i, [struct_pack(place := 0::BIGINT, nom := nom, weight := weight, size := size, holds := holds)] AS held, 0::BIGINT AS failed FROM a WHERE i = 1
UNION ALL SELECT k, i + 1, CASE WHEN best IS NULL THEN list_append(held, struct_pack(place := len(held)::BIGINT, nom := nom, weight := weight, size := size, holds := holds))
 ELSE list_transform(held, lambda x: CASE WHEN x.place <> best.p THEN x WHEN weight > x.weight OR (weight = x.weight AND size >= x.size) THEN struct_pack(place := x.place, nom := nom, weight := weight, size := size, holds := x.holds | holds)
 ELSE struct_pack(place := x.place, nom := x.nom, weight := x.weight, size := x.size, holds := x.holds | holds) END) END,
 failed + len(list_filter(held, lambda x: best IS NULL OR -x.weight < best.w OR (-x.weight = best.w AND x.place < best.p)))
FROM (SELECT r.*, a.nom, a.weight, a.size, a.holds, list_sort(list_transform(list_filter(r.held, lambda x: (x.holds & a.holds) <> 0), lambda x: struct_pack(w := -x.weight, p := x.place)))[1] AS best FROM r JOIN a ON a.k = r.k AND a.i = r.i + 1)),
f AS (SELECT k, failed, unnest(held) AS h FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS rn FROM r) WHERE rn = 1)
SELECT (k % 50)::INTEGER AS folder_id, k AS episode, h.place AS place, h.nom AS nom, h.weight AS weight, h.size AS size, h.holds AS holds, failed AS failures FROM f""")
def candidates_tried(spark, d):
    """Orders are files that arrive in three batches, customers are episodes: candidates left, and how many trials failed."""
    o = table(spark, d, "orders")
    key = F.col("o_orderkey")
    files = o.select(
        (F.col("o_custkey") % 50).cast("int").alias("folder_id"), F.col("o_custkey").alias("episode"), key.alias("id"), F.concat(F.lit("f"), key.cast("string")).alias("nom"), (key % 4).cast("int").alias("weight"),
        F.floor("o_totalprice").alias("size"), F.expr("shiftleft(1L, cast(o_orderkey % 7 as int))").alias("holds"), "o_orderstatus")
    state = candidates.tried_in_turn(spark, [files.where(F.col("o_orderstatus") == s) for s in ("F", "O", "P")])
    failed = state.errors().groupBy(*candidates.KEY).agg(F.count("*").alias("failures"))
    return candidates.standing(state.events()).join(failed, candidates.KEY, "left").withColumn("failures", F.coalesce("failures", F.lit(0).cast("long")))


def whole_merge(spark, d) -> whole.Merged:
    """Five files a label: its vectors as sound, torn; whole; later; the third one's sound again, later by a tag; another language."""
    some, sides = sounded(spark, d, None)
    one = sides.select(F.col("match").alias("grp"), "n", "value")
    later = F.col("grp") % 5 * 40
    make = lambda file, by: one.select("grp", F.lit(file).cast("long").alias("file"), F.lit(file * 10 + 1).cast("long").alias("ord"), (F.col("n") + by).alias("n"), "value")
    tear = F.when(F.col("n") >= 22 * 64, 96).otherwise(0)
    samples = cut(make(1, tear).unionByName(make(2, F.lit(0))).unionByName(make(3, later)).unionByName(make(4, later)).unionByName(make(5, F.lit(0))))
    grid = some.select(F.col("match").alias("grp"), F.posexplode(F.array(*(F.lit(float(x)) for x in (5, 14, 23, 32)))).alias("segment", "begin_s"), F.lit(8.0).alias("length_s")).withColumn("segment", F.col("segment").cast("long"))
    heard = whole.Sounds(cut(words_of(samples, ["grp", "file", "ord"])), samples, cut(grid), 8.0, 64.0)
    files = some.select(F.col("match").alias("grp"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long"))).alias("file"))
    f = F.col("file")
    both = files.withColumn("kind", F.explode(F.array(F.lit("audio"), F.lit("subtitle"))))
    same = F.when(f == 4, 3).otherwise(f).cast("string")
    tracks = both.select(
        "grp", "file", "kind", F.when(f == 5, "fr").otherwise("en").alias("language"), (f * 10 + F.when(F.col("kind") == "audio", 1).otherwise(2)).alias("ord"), F.col("kind").alias("key"), F.concat("kind", same).alias("md5"),
        F.when(f == 3, 0.5).when(f == 4, 0.46).alias("delay_s"), F.when(f == 2, "flac").otherwise("ac3").alias("format"), F.lit(2.0).alias("channels"), F.lit(48000).alias("rate"), F.when(f == 2, 1000.0 * (F.col("grp") % 2 + 1)).otherwise(1000.0).alias("bitrate"),
        F.lit("plain").alias("title"), F.lit(False).alias("hearing"), F.lit("plain").alias("class"), F.lit(True).alias("keep"))
    scores = files.select("grp", "file", F.when(f == 2, F.col("grp") % 3).otherwise(1).cast("double").alias("score"))
    synonyms = spark.createDataFrame([], "language string, group long, title string")
    return whole.merged(tracks, scores, heard, "en", RULE_TEXT, 1, synonyms, ["en"], ["fr"])


MERGES_SQL = "m AS (SELECT label::BIGINT AS grp, label % 5 * 625 AS d, label % 3 >= 1 AS first, label % 2 = 1 AS richer FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 45)"


@query(f"""WITH {MERGES_SQL}, t AS (SELECT m.*, file, ord, kind, CASE WHEN ord = 31 AND richer THEN 'dominated' ELSE reason END AS reason FROM m,
 (VALUES (2, 21, 'audio', NULL), (2, 22, 'subtitle', NULL), (3, 31, 'audio', NULL), (3, 32, 'subtitle', 'over the budget'), (4, 41, 'audio', 'same hash'), (4, 42, 'subtitle', 'same hash')) v(file, ord, kind, reason))
SELECT grp, file::BIGINT AS file, ord::BIGINT AS ord, kind, CASE WHEN reason IS NULL THEN 'take' ELSE 'remove' END AS action, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY grp, reason IS NULL ORDER BY kind, ord) END AS place,
CASE WHEN reason IS NULL THEN CASE file WHEN 2 THEN CASE WHEN first THEN 0 ELSE d END WHEN 3 THEN CASE WHEN first THEN -d ELSE 0 END END END::BIGINT AS delay_ms, ord = 21 AS is_default, reason FROM t
UNION ALL SELECT grp, file, NULL, NULL, 'reject', NULL, NULL, NULL, reason FROM m, (VALUES (1, 'not compatible'), (5, 'no common language')) v(file, reason)""")
def merge_of_sounds(spark, d):
    """Whole merges from sounds to plans and rejected files; no comparison or delay is handed in."""
    found = whole_merge(spark, d)
    plan = found.plan.select("grp", "file", "ord", "kind", "action", "place", F.col("delay_ms").cast("long").alias("delay_ms"), "is_default", "reason")
    return plan.unionByName(found.rejected.withColumn("action", F.lit("reject")), allowMissingColumns=True)
