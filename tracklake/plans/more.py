"""More queries over the supplied tables: record predicates, merge plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import scalars
from tracklake.operators import merging, records
from tracklake.operators.spread import dealt
from tracklake.plans.registry import query
from tracklake.sources.tables import table


@query("SELECT p_partkey, CASE WHEN c IN ('hdmv_pgs_subtitle', 'dvd_subtitle', 'dvb_subtitle', 'xsub') THEN 'picture' WHEN c IN ('subrip', 'srt', 'text', 'mov_text') THEN 'plain' ELSE 'styled' END AS class, coalesce(CASE WHEN p_partkey % 3 = 0 THEN 'SRT' END, CASE WHEN p_partkey % 3 = 1 THEN 'ass' END, 'xsub') IN ('xsub', 'x') AS bad FROM (SELECT p_partkey, ['srt', 'ass', 'xsub', 'subrip'][p_partkey % 4 + 1] AS c FROM part)")
def codec_class(spark, d):
    k = F.col("p_partkey")
    codec = F.element_at(F.array(*map(F.lit, ("SRT", "ass", "XSUB", "subrip"))), (k % 4 + 1).cast("int"))
    bad = records.incompatible(F.when(k % 3 == 0, "SRT"), F.when(k % 3 == 1, "ass"), F.lit("xsub"), ["xsub", "x"])
    return table(spark, d, "part").select(k, records.codec_class(codec).alias("class"), bad.alias("bad"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (coalesce(CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS INTEGER) % 5 END, 1) = 0 OR l_discount = 0)")
def empty_track_filter(spark, d):
    size = F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("int") % 5)
    return table(spark, d, "lineitem").where(~records.empty_track(size, F.col("l_discount"))).select("l_orderkey", "l_linenumber")


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN false ELSE true END AS keep, CASE WHEN role = 'assistant' AND NOT any_user THEN 'en' ELSE role END AS language FROM (SELECT *, bool_or(role = 'user') OVER (PARTITION BY conv_id) AS any_user FROM conversations)")
def keep_flag_init(spark, d):
    from pyspark.sql import Window

    role = F.when(F.col("role") == "user", "commentary").otherwise("main")
    present = F.bool_or(F.col("role") == "user").over(Window.partitionBy("conv_id"))
    und = F.when(F.col("role") == "assistant", "und").otherwise(F.col("role"))
    back = records.default_language(und, "en", present)
    return table(spark, d, "conversations").select("conv_id", "turn", records.keep_at_first(role, True, False).alias("keep"), F.when(back == "und", "assistant").otherwise(back).alias("language"))


@query("SELECT doc_id, source FROM documents WHERE source LIKE '%src1%' ORDER BY doc_id DESC LIMIT 1")
def forced_winner(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.col("source").alias("name"))
    return records.forced_winner(docs, "src1", "doc_id").select("doc_id", "source")


@query("SELECT page_id, line, contains(lower(line), 'warning') AND contains(lower(line), 'uid') AS tolerable FROM (SELECT page_id, unnest(string_split(replace(replace(replace(replace(html, chr(10), ' '), 'class', 'Warning: UID'), 'href', 'Attachment: none'), 'div', 'ERROR'), '>')) AS line FROM pages) WHERE regexp_matches(lower(line), 'error|warning|failed|invalid|missing|corrupt|attachment|uid') AND NOT contains(lower(line), 'attachment: none')")
def log_line_filter(spark, d):
    cut_at = F.replace("html", F.lit("\n"), F.lit(" "))
    for word, other in (("class", "Warning: UID"), ("href", "Attachment: none"), ("div", "ERROR"), (">", "\n")):
        cut_at = F.replace(cut_at, F.lit(word), F.lit(other))
    return records.log_lines(table(spark, d, "pages").select("page_id", cut_at.alias("text")), "text")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DECIMAL(20, 9)) IS NOT DISTINCT FROM CAST(event_id % 100 AS DECIMAL(20, 9)) AS retained FROM events")
def delay_retention(spark, d):
    tag = F.replace("props", F.lit('"k"'), F.lit('"delay"'))
    return table(spark, d, "events").select("event_id", records.retained(tag, F.col("event_id") % 100).alias("retained"))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_suppkey END, CASE WHEN l_linenumber % 3 = 1 THEN l_partkey END, 7) AS bitrate, greatest(l_linenumber - 1, 0)::BIGINT AS relative FROM lineitem")
def bitrate_fallback(spark, d):
    n = F.col("l_linenumber")
    text = lambda c, k: F.when(n % 3 == k, F.col(c).cast("string")).otherwise("N/A")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", records.bitrate(text("l_suppkey", 0), text("l_partkey", 1), F.lit("7")).alias("bitrate"), records.relative_id(n.cast("string")).alias("relative"))


@query("SELECT l_orderkey, min(l_extendedprice) AS duration, coalesce(min(CASE WHEN l_linenumber > 2 THEN l_linenumber END), 2)::INTEGER AS channels, coalesce(min(CASE WHEN l_linenumber > 3 THEN l_suppkey END), 44100)::INTEGER AS rate FROM lineitem GROUP BY l_orderkey")
def weakest_audio(spark, d):
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("duration"), F.when(n > 2, n.cast("string")).otherwise("?").alias("channels"), F.when(n > 3, F.col("l_suppkey").cast("string")).otherwise("").alias("rate"))
    return records.weakest(rows, "l_orderkey")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, h ORDER BY k, turn) = 1 AS keep FROM (SELECT conv_id, turn, md5(role) AS h, CASE WHEN length(text) % 2 = 0 THEN 0 ELSE 1 END AS k FROM conversations)")
def md5_multiset(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.md5("role").alias("hash"), F.when(F.length("text") % 2 == 0, "plain").otherwise("styled").alias("kind"))
    return records.keep_plain_of_equal(rows, ["conv_id"], "turn").select("conv_id", "turn", "keep")


@query("SELECT pair, shift, round(m, 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY m DESC, shift DESC) AS rn FROM (SELECT user_id AS pair, event_id % 5 - 2 AS shift, avg(event_id % 3) AS m FROM events GROUP BY ALL)) WHERE rn = 1")
def best_frame_shift(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("pair"), (F.col("event_id") % 5 - 2).alias("shift"), (F.col("event_id") % 3).alias("score"))
    return records.best_shift(rows).withColumn("mean", F.round("mean", 6))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(lower(replace(x, 'The', 'Style:')), 'style:')))::BIGINT AS styles FROM documents")
def style_count(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars_style(F.col("text")).alias("styles"))


def scalars_style(text):
    return records.style_lines(F.replace(text, F.lit("The"), F.lit("Style:")))


@query("WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_totalprice / 100 AS s FROM orders), g AS (SELECT *, CASE WHEN s > 540 THEN 120 WHEN s > 60 THEN 30 WHEN s > 5 THEN 0 END::BIGINT AS b, trunc(CASE WHEN s > 540 THEN (s - 240) / 5 WHEN s > 60 THEN (s - 45) / 5 WHEN s > 5 THEN s - 2 / 5 END)::BIGINT AS l FROM t) SELECT o_custkey, o_orderkey, place, segment::INTEGER AS segment, b + segment * l AS begin_s, l AS length_s FROM g, (SELECT unnest(range(0, 4)) AS segment)")
def segment_fan_out(spark, d):
    s = F.col("o_totalprice") / 100
    rows = table(spark, d, "orders")
    return records.fan_out(rows, "o_custkey", "o_orderkey", scalars.grid_begin(s), scalars.grid_length(s, 4), 4).select("o_custkey", "o_orderkey", "place", "segment", "begin_s", "length_s")


@query("SELECT l_suppkey, file, weight, size FROM (SELECT l_suppkey, l_orderkey AS file, l_linenumber AS weight, l_quantity AS size, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_linenumber DESC, l_quantity DESC, l_orderkey DESC) AS rn FROM lineitem WHERE l_returnflag = 'R') WHERE rn = 1")
def first_success(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("weight"), F.col("l_quantity").alias("size"), "l_returnflag")
    return records.first_success(rows, ["l_suppkey"], F.col("l_returnflag") == "R")


@query("SELECT event_id, '{\"file\":\"' || event_type || '\",\"offset_seconds\":' || (event_id % 9) || '}' AS line FROM events")
def result_line(spark, d):
    return table(spark, d, "events").select("event_id", records.result_line(F.col("event_type"), F.col("event_id") % 9).alias("line"))


@query("SELECT user_id, avg(0.7 + (event_id % 31) / 100.0::DOUBLE + (user_id % 2) * 0.1) >= 0.85 AS compatible, bool_and(user_id % 3 = 0) AS all_torn FROM events GROUP BY user_id")
def global_compatibility(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.lit(0.7) + (F.col("event_id") % 31) / 100.0 + (F.col("user_id") % 2) * F.lit(0.1)).alias("fidelity"), F.when(F.col("user_id") % 3 == 0, 2).otherwise(1).alias("offsets"))
    return records.compatible_globally(rows, "user_id")


@query("SELECT o_custkey AS grp, o_orderkey AS name, row_number() OVER w AS rank, first(o_orderkey) OVER w AS winner FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def tournament(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name"), F.col("o_totalprice").alias("score"))
    return merging.tournament(files).drop("score")


@query("SELECT o_custkey AS grp, o_orderkey AS name, count(*) OVER (PARTITION BY o_custkey) >= 2 AS enough FROM orders WHERE o_orderstatus <> 'F'")
def merge_survivors(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name"), "o_orderstatus")
    return merging.survivors(orders.drop("o_orderstatus"), orders.where("o_orderstatus = 'F'"))


@query("""WITH t AS (SELECT conv_id AS grp, turn AS file, CASE WHEN length(text) % 3 = 0 THEN 'en' WHEN length(text) % 3 = 1 THEN 'fr' ELSE 'de' END AS language FROM conversations UNION ALL SELECT conv_id, turn, 'en' FROM conversations WHERE conv_id % 2 = 0),
c AS (SELECT grp, language, count(DISTINCT file) AS n FROM t GROUP BY ALL), a AS (SELECT grp, count(DISTINCT file) AS total FROM t GROUP BY grp)
SELECT grp, language, n = total AS is_common FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY (n = total) DESC, CASE WHEN n = total THEN 0 ELSE n END DESC, (language = 'en') DESC, language) AS rn FROM c JOIN a USING (grp)) WHERE rn = 1""")
def merge_language(spark, d):
    c = table(spark, d, "conversations")
    n = F.length("text") % 3
    rows = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("file"), F.when(n == 0, "en").when(n == 1, "fr").otherwise("de").alias("language"))
    return merging.merge_language(rows.union(c.where("conv_id % 2 = 0").select("conv_id", "turn", F.lit("en"))), "en")


@query("""WITH t AS (SELECT o_custkey AS grp, o_orderkey AS file, o_orderpriority AS key, o_orderkey AS ord FROM orders WHERE o_orderstatus <> 'F')
SELECT grp, file, key, ord, CASE WHEN file % 3 = 0 THEN file % 50 ELSE 0 END AS delay_ms, row_number() OVER (PARTITION BY grp ORDER BY key, ord) AS place FROM t""")
def merge_plan(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") != "F").alias("keep"))
    delays = o.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 50).alias("delay_ms"))
    return merging.plan(rows, delays).drop("keep")


@query("SELECT DISTINCT l_orderkey AS grp, l_linenumber::BIGINT AS member, min(l_linenumber) OVER (PARTITION BY l_orderkey, (l_orderkey + l_linenumber * l_linenumber) % 3)::BIGINT AS clique FROM lineitem")
def audio_cliques(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("member"), ((F.col("l_orderkey") + F.col("l_linenumber") * F.col("l_linenumber")) % 3).alias("k"))
    lines = lines.repartition(dealt(lines), "grp").distinct()
    a, b = lines.select("grp", F.col("member").alias("i"), F.col("k").alias("x")), lines.select("grp", F.col("member").alias("j"), F.col("k").alias("y"))
    measured = a.join(b, "grp").where("i < j").select("grp", "i", "j", F.when(F.col("x") == F.col("y"), 0.95).otherwise(0.5).alias("fidelity"), F.lit(0).alias("delay_ms"))
    return merging.cliques(lines.select("grp", "member"), merging.compatible_pairs(measured))
