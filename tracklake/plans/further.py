"""Queries of whole procedures: measurement joins, delay decisions, subtitle rules, knockouts, sources and blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracklake.functions import scalars, signals
from tracklake.operators import catalog, cuts, delays, merging, records, refine, routing, selection, subtitles, tracks
from tracklake.operators.rules import compare, parse
from tracklake.operators.spread import dealt, numbered
from tracklake.plans.queries import BEATEN_SQL, FACTORS_SQL, ROUTED_SQL, RULE_TEXT, SOUNDS_SQL, WORDS_SQL, aligned, episodes, names, rule_table, series
from tracklake.plans.registry import ORACLE, query
from tracklake.sources import metadata
from tracklake.sources.tables import cut, table


# ---- measurements and delay decisions: customers are matches, line numbers are tracks and segments

SIDES_SQL = """sides AS (SELECT o_custkey AS match, l_orderkey % 2 AS side, l_linenumber AS track, (l_partkey + k) % 3 AS segment, min(l_suppkey * 2654435761 % 4294967296) AS words
FROM lineitem JOIN orders ON l_orderkey = o_orderkey, (SELECT unnest(range(0, 2)) AS k) GROUP BY ALL)"""


def sides(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("match")), "l_orderkey")
    lines = lines.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return lines.groupBy("match", (F.col("l_orderkey") % 2).alias("side"), F.col("l_linenumber").alias("track"), ((F.col("l_partkey") + F.col("k")) % 3).alias("segment")).agg(F.min(F.col("l_suppkey") * 2654435761 % 4294967296).alias("words"))


@query(f"""WITH {SIDES_SQL} SELECT a.match, a.track AS i, b.track AS j, a.segment, (32 - bit_count(xor(a.words, b.words))) / 32.0::DOUBLE AS fidelity FROM sides a JOIN sides b USING (match, segment)
WHERE a.side = 0 AND b.side = 1 AND NOT (a.track = b.track AND a.match % 2 = 0)""")
def pair_segment_measurements(spark, d):
    every = sides(spark, d)
    ignored = every.where("match % 2 = 0").select("match", F.col("track").alias("i"), F.col("track").alias("j")).distinct()
    met = delays.measured_pairs(every.where("side = 0"), every.where("side = 1"), ignored)
    same = (F.lit(32) - F.bit_count(F.col("x").bitwiseXOR(F.col("y")))) / F.lit(32.0)
    return met.select("match", "i", "j", "segment", same.alias("fidelity"))


# measurement rows of every event: pairs are users, matches are groups of three users
ROWS_SQL = """e AS (SELECT user_id // 3 AS match, user_id % 3 AS pair, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events),
first AS (SELECT match, pair, segment, 0.75 + (event_id % 21) / 100.0::DOUBLE AS fidelity, CAST(CASE match % 6 WHEN 0 THEN 40 WHEN 1 THEN CASE WHEN segment = 1 THEN 0 ELSE segment % 2 * 125 END WHEN 2 THEN pair * 60 WHEN 3 THEN CASE WHEN pair = 0 THEN segment % 3 * 400 ELSE 40 END WHEN 4 THEN CASE WHEN pair = 2 THEN segment % 2 * 100 ELSE 40 END ELSE event_id % 5 * 300 END AS BIGINT) AS delay FROM e),
fine AS (SELECT match, pair, CASE WHEN pair = 1 THEN 0.5 ELSE 0.02 END::DOUBLE AS fine FROM (SELECT DISTINCT match, pair FROM e)), whole AS (SELECT match, CASE WHEN match % 4 = 0 THEN 0.3 ELSE 0.01 END::DOUBLE AS fine FROM (SELECT DISTINCT match FROM e))"""


def event_rows(spark, d):
    rows = numbered(table(spark, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "segment")
    return cut(rows.select(F.floor(F.col("user_id") / 3).alias("match"), (F.col("user_id") % 3).alias("pair"), "segment", "event_id", "value"))  # numbered once, read many times


def first_rows(rows):
    m, p, s = F.col("match") % 6, F.col("pair"), F.col("segment")
    delay = F.when(m == 0, 40).when(m == 1, F.when(s == 1, 0).otherwise(s % 2 * 125)).when(m == 2, p * 60).when(m == 3, F.when(p == 0, s % 3 * 400).otherwise(40)).when(m == 4, F.when(p == 2, s % 2 * 100).otherwise(40)).otherwise(F.col("event_id") % 5 * 300)
    return rows.select("match", "pair", "segment", (F.lit(0.75) + (F.col("event_id") % 21) / 100.0).alias("fidelity"), delay.cast("long").alias("delay_ms"))


def started(rows):
    first = first_rows(rows)
    fine = first.select("match", "pair").distinct().withColumn("delay_s", F.when(F.col("pair") == 1, 0.5).otherwise(0.02))
    whole = first.select("match").distinct().withColumn("delay_s", F.when(F.col("match") % 4 == 0, 0.3).otherwise(0.01))
    return delays.combined(first, fine, whole).drop("low", "high")


COMBINED_SQL = f"""{ROWS_SQL}, s AS (SELECT match, pair, count(DISTINCT delay) AS n, min(delay) AS low, max(delay) AS high, avg(fidelity) AS mean, arg_min(delay, segment) AS head, arg_max(delay, segment) AS tail FROM first GROUP BY ALL),
b AS (SELECT f.match, f.pair, avg(CASE WHEN f.delay <> s.head OR fidelity < 0.85 THEN 1.0 ELSE 0.0 END) AS bad FROM first f JOIN s USING (match, pair) GROUP BY ALL),
v AS (SELECT *, CASE WHEN n = 1 OR near AND head = tail AND bad <= 0.25 THEN 'accept' WHEN near THEN 'adjust' ELSE 'ignore' END AS verdict FROM (SELECT *, n = 2 AND high - low < 127 AND mean >= 0.7 AS near FROM s JOIN b USING (match, pair))),
u AS (SELECT *, CASE WHEN verdict = 'adjust' AND abs(fine) < 0.125 THEN CAST(round_even((low + high) / 2, 0) AS BIGINT) + CAST(round_even(fine * 1000, 0) AS BIGINT) END AS found, CASE verdict WHEN 'accept' THEN head WHEN 'adjust' THEN low + CAST(round_even((high - low) / 2, 0) AS BIGINT) END AS gives FROM v JOIN fine USING (match, pair)),
c AS (SELECT match, coalesce(list_sort(list(pair) FILTER (NOT (verdict = 'accept' OR found IS NOT NULL))), []) AS ignored, count(DISTINCT CASE WHEN verdict = 'accept' OR found IS NOT NULL THEN gives END) AS kinds, min(CASE WHEN verdict = 'accept' OR found IS NOT NULL THEN gives END) AS low,
 max(CASE WHEN verdict = 'accept' OR found IS NOT NULL THEN gives END) AS high, (arg_max(coalesce(found, -1000000), pair) FILTER (verdict = 'adjust')) AS last FROM u GROUP BY match),
combined AS (SELECT match, ignored, CASE WHEN kinds = 1 THEN coalesce(nullif(last, -1000000), low) WHEN kinds = 2 AND high - low < 127 AND abs(fine) < 0.125 THEN CAST(round_even((low + high) / 2, 0) AS BIGINT) + CAST(round_even(fine * 1000, 0) AS BIGINT) END AS delay_ms,
 CASE WHEN kinds = 0 THEN 'no delay' WHEN kinds > 2 OR kinds = 2 AND high - low >= 127 THEN 'several delays' WHEN kinds = 2 AND abs(fine) >= 0.125 THEN 'not settled' END AS reason FROM c JOIN whole USING (match))"""


@query(f"WITH {COMBINED_SQL} SELECT match, array_to_string(ignored, ',') AS ignored, delay_ms, reason FROM combined")
def delay_combined(spark, d):
    return started(event_rows(spark, d)).withColumn("ignored", F.array_join("ignored", ","))


@query(f"""WITH {COMBINED_SQL}, second AS (SELECT match, pair, segment, 0.8 + (event_id % 21) / 100.0::DOUBLE AS fidelity, CASE match % 4 WHEN 1 THEN 20 WHEN 2 THEN CASE WHEN segment % 7 = 3 THEN 100 ELSE 0 END WHEN 3 THEN segment % 3 * 90 ELSE 0 END AS delay FROM e),
s2 AS (SELECT match, pair, count(DISTINCT delay) AS n, min(delay) AS low, max(delay) AS high, avg(fidelity) AS mean, arg_min(delay, segment) AS head, arg_max(delay, segment) AS tail, max((fidelity > 0.9)::INT) AS good, max((fidelity < 0.75)::INT) AS poor FROM second GROUP BY ALL),
k2 AS (SELECT *, CASE WHEN delay <> lag(delay) OVER w THEN 1 ELSE 0 END AS changed, coalesce(least(fidelity, min(fidelity) OVER (PARTITION BY match, pair ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) < 0.9, false) AS weak FROM second WINDOW w AS (PARTITION BY match, pair ORDER BY segment)),
r2 AS (SELECT *, sum(changed) OVER (PARTITION BY match, pair ORDER BY segment) AS run FROM k2), m2 AS (SELECT match, pair, d AS majority FROM (SELECT match, pair, run, min(delay) AS d, row_number() OVER (PARTITION BY match, pair ORDER BY count(*) DESC, run) AS rn FROM r2 GROUP BY match, pair, run) WHERE rn = 1),
c2 AS (SELECT match, pair, sum(CASE WHEN changed = 1 AND weak THEN 1 ELSE 0 END) AS changes FROM r2 GROUP BY ALL),
v2 AS (SELECT match, pair, CASE WHEN n = 1 OR near AND head = tail THEN head WHEN near AND changes > 1 AND good = 1 AND poor = 1 THEN NULL WHEN near THEN majority WHEN n = 2 AND high - low < 128 AND mean >= 0.75 AND (low = 0 OR high = 0) THEN 0 END AS gives FROM (SELECT *, n = 2 AND high - low < 128 AND mean >= 0.9 AS near FROM s2 JOIN m2 USING (match, pair) JOIN c2 USING (match, pair))),
two AS (SELECT match, bool_or(gives IS NULL) AS bad, count(DISTINCT gives) AS kinds, min(gives) AS more FROM v2 JOIN combined USING (match) WHERE delay_ms IS NOT NULL AND NOT list_contains(ignored, pair) GROUP BY match)
SELECT match, CAST(CASE WHEN bad THEN NULL WHEN kinds = 1 AND more = 0 THEN delay_ms ELSE delay_ms + more END AS BIGINT) AS delay_ms, CASE WHEN bad OR kinds = 1 AND more = 0 THEN 2 ELSE 3 END AS test FROM two JOIN combined USING (match)""")
def delay_rechecked(spark, d):
    m, s = F.col("match") % 4, F.col("segment")
    delay = F.when(m == 1, 20).when(m == 2, F.when(s % 7 == 3, 100).otherwise(0)).when(m == 3, s % 3 * 90).otherwise(0).cast("long")
    rows = event_rows(spark, d)
    second = rows.select("match", "pair", "segment", (F.lit(0.8) + (F.col("event_id") % 21) / 100.0).alias("fidelity"), delay.alias("delay_ms"))
    third = rows.select("match", "pair", "segment", F.lit(0.95).alias("fidelity"), F.lit(0).cast("long").alias("delay_ms"))  # settled by then
    return delays.rechecked(started(rows), second, third).drop("more")


@query("""WITH e AS (SELECT user_id // 3 AS match, user_id % 3 AS pair, event_id AS segment, (event_id % 11) / 100.0::DOUBLE * (CASE WHEN user_id // 3 % 3 = 0 THEN 0 ELSE user_id % 3 END) + CASE WHEN user_id // 3 % 5 = 1 THEN user_id % 3 * 0.4 ELSE 0.01 END::DOUBLE AS d FROM events),
p AS (SELECT match, pair, count(*) AS n, var_samp(d) AS spread, arg_min(d, segment) AS head, arg_max(d, segment) AS tail FROM e GROUP BY ALL), k AS (SELECT match, pair, CASE WHEN n = 1 OR spread < 0.004 THEN 'all' WHEN abs(head - tail) < 0.004 THEN 'ends' ELSE 'fail' END AS v, head, tail FROM p),
g AS (SELECT DISTINCT match, d FROM (SELECT match, d FROM e JOIN k USING (match, pair) WHERE v = 'all' UNION ALL SELECT match, head FROM k WHERE v = 'ends' UNION ALL SELECT match, tail FROM k WHERE v = 'ends')), t AS (SELECT match, bool_or(v = 'fail') AS torn FROM k GROUP BY match),
m AS (SELECT match, torn, count(d) AS kinds, var_samp(d) AS spread FROM t LEFT JOIN g USING (match) GROUP BY ALL), a AS (SELECT match, avg(d) AS mean FROM e GROUP BY match),
r AS (SELECT match, CASE WHEN torn THEN 'a pair varies' WHEN kinds > 1 AND spread > 0.004 THEN 'pairs vary' END AS reason, CASE WHEN match % 2 = 0 THEN 0.25::DOUBLE ELSE mean END AS mean FROM m JOIN a USING (match))
SELECT match, round(CASE WHEN reason IS NULL THEN mean END, 9) AS delay_s, reason FROM r""")
def delay_fine(spark, d):
    e = table(spark, d, "events")
    match, pair = F.floor(F.col("user_id") / 3), F.col("user_id") % 3
    delay = (F.col("event_id") % 11) / 100.0 * F.when(match % 3 == 0, 0).otherwise(pair) + F.when(match % 5 == 1, pair * 0.4).otherwise(0.01)
    rows = e.select(match.alias("match"), pair.alias("pair"), F.col("event_id").alias("segment"), delay.alias("delay_s"))
    window = rows.where("match % 2 = 0").select("match").distinct().withColumn("delay_s", F.lit(0.25))
    return delays.fine_delay(rows, window).withColumn("delay_s", F.round("delay_s", 9))


@query("SELECT o_orderkey, CASE WHEN trunc(s * 11 / 2.5) < 2400 THEN CAST(least(trunc(s * 11 / 2.5), 1500) AS BIGINT) END AS window_s, CASE WHEN abs(o_orderkey % 400 - 200) < 125 THEN o_orderkey % 90 + CAST(o_orderkey % 400 - 200 AS BIGINT) END AS settled_ms, CAST(trunc(s * 25 / 100) AS BIGINT) + 1 AS quality_s FROM (SELECT *, o_totalprice / 100 AS s FROM orders)")
def delay_windows(spark, d):
    s = F.col("o_totalprice") / 100
    fine = (F.col("o_orderkey") % 400 - 200) / 1000.0
    return table(spark, d, "orders").select("o_orderkey", delays.long_window(s, 10).cast("long").alias("window_s"), delays.settled(F.col("o_orderkey") % 90, fine).alias("settled_ms"), scalars.quality_window(s).alias("quality_s"))


@query(f"""WITH n AS (SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id) SELECT a.key, CASE WHEN least(a.n, b.n) >= 32 THEN least(a.n, b.n) - 32 END AS span, CAST(trunc(120.0::DOUBLE / a.n * 1000) AS BIGINT) AS ms_per_word, -(a.key % 7) * CAST(trunc(120.0::DOUBLE / a.n * 1000) AS BIGINT) AS delay_ms FROM n a JOIN n b ON b.key = a.key + 1""")
def correlation_span(spark, d):
    n = series(spark, d).groupBy("key").agg(F.count("*").alias("n"))
    both = n.join(n.select((F.col("key") - 1).alias("key"), F.col("n").alias("m")), "key").withColumn("offset", F.col("key") % 7)
    return delays.located(both, F.lit(120.0), F.col("n")).select("key", delays.span_of(F.col("n"), F.col("m")).alias("span"), "ms_per_word", "delay_ms")


@query("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN -(event_id % 700) ELSE event_id % 700 END AS loser_delay_ms, CASE WHEN abs(event_id % 1400 - 700) < 500 THEN user_id + (event_id % 1400 - 700) END AS total_ms FROM events")
def delay_signed(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", (F.col("user_id") % 2 == 0).alias("a_wins"), (F.col("event_id") % 700).alias("delay_ms"))
    total = delays.agreed(F.col("user_id"), (F.col("event_id") % 1400 - 700).cast("decimal(20,3)") / 1000)
    return merging.signed(rows).select("event_id", "loser_delay_ms", total.cast("long").alias("total_ms"))


@query("""WITH m AS (SELECT label AS clip, min(vec_id) AS least, max(vec_id) AS most, arg_max(vec_id, (vec_id * 37 % 101) * 100000000 - vec_id) AS peak FROM embeddings GROUP BY label) SELECT clip, peak, greatest(peak - 15, least) AS "begin", least(peak + 15, most) AS "end" FROM m""")
def widest_gap(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("i"), (F.col("vec_id") * 37 % 101).alias("total"))
    return cuts.widest_gap(rows, 15)


@query(f"""WITH {WORDS_SQL}, near AS (SELECT a.label AS clip, a.vec_id AS i, b.vec_id AS j, bit_count(xor(a.x[1], b.x[1])) + bit_count(xor(a.x[2], b.x[2])) AS d FROM words a JOIN words b ON a.label = b.label AND b.vec_id BETWEEN a.vec_id - 20 AND a.vec_id + 20 AND a.vec_id <> b.vec_id),
t AS (SELECT clip, i, sum(d) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS total FROM (SELECT clip, i, min(d) AS d FROM near GROUP BY clip, i)),
g AS (SELECT clip, arg_max(i, total * 1000000000 - i) AS peak, min(i) AS least, max(i) AS most FROM t GROUP BY clip)
SELECT clip, 'frames' AS method, greatest(peak - 12, least) / 25.0::DOUBLE AS start_s, least(peak + 12, most) / 25.0::DOUBLE AS end_at_s FROM g""")
def gap_times(spark, d):
    """The widest gap of each clip's alignment in frames, as times within a range that begins a second in."""
    gaps = cuts.widest_gap(cuts.trailing_sum(aligned(spark, d), 8), 12)
    ranges = gaps.select("clip", F.lit(1.0).alias("begin_s"), F.lit(9.0).alias("end_s"), F.lit(25.0).alias("fps_main"), F.lit(25.0).alias("fps_target"), F.col("begin").alias("gap_begin"), F.col("end").alias("gap_end"), F.lit(None).cast("array<double>").alias("scene_s"), F.lit(None).cast("double").alias("lag_s"))
    return refine.refined(ranges).select("clip", "method", "start_s", "end_at_s")


# ---- subtitles: conversations are merges, turns are tracks

SUBS_SQL = """subs AS (SELECT conv_id AS grp, ['en', 'fr', 'de', 'it'][length(text) % 4 + 1] AS language, turn::BIGINT AS ord, ['Forced', 'English (SDH)', 'Fr (dubtitle)', ' CC ', 'plain', 'cc', 'x (cc) y', NULL][length(text) % 8 + 1] AS title, length(text) % 11 = 0 AS hearing,
['plain', 'styled', 'plain', 'styled', 'picture'][length(text) % 5 + 1] AS class, CASE WHEN length(text) % 3 = 0 THEN '' ELSE md5(role || (length(text) % 9)) END AS md5, length(text) % 13 > 0 AS keep, text FROM conversations)"""


def subs(spark, d):
    n = F.length("text")
    at = lambda values: F.get(F.array(*map(F.lit, values)), n % len(values))
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("grp"), at(("en", "fr", "de", "it")).alias("language"), F.col("turn").cast("long").alias("ord"), at(("Forced", "English (SDH)", "Fr (dubtitle)", " CC ", "plain", "cc", "x (cc) y", None)).alias("title"), (n % 11 == 0).alias("hearing"),
        at(("plain", "styled", "plain", "styled", "picture")).alias("class"), F.when(n % 3 == 0, "").otherwise(F.md5(F.concat("role", (n % 9).cast("string")))).alias("md5"), (n % 13 > 0).alias("keep"), "text")


CLEANED_SQL = r"""SELECT grp, ord, regexp_replace(coalesce(title, ''), '^\s+|\s+$', '', 'g') AS plain, regexp_replace(coalesce(regexp_replace(lower(title), '\s*\(?dubtitle\)?\s*', '', 'g'), ''), '^\s+|\s+$', '', 'g') AS dubbed,
regexp_replace(coalesce(CASE WHEN contains(lower(title), 'sdh') THEN regexp_replace(lower(title), '\s*\(?sdh\)?\s*', '', 'g') WHEN contains(lower(title), '(cc)') THEN regexp_replace(lower(title), '\s*\(cc\)\s*', '', 'g') WHEN lower(title) IN ('hi', 'cc') THEN '' ELSE lower(title) END, ''), '^\s+|\s+$', '', 'g') AS hearing,
regexp_replace(coalesce(regexp_replace(lower(title), '\s*\(?forced\)?\s*', '', 'g'), ''), '^\s+|\s+$', '', 'g') AS forced"""


@query(f"WITH {SUBS_SQL} {CLEANED_SQL} FROM subs")
def title_cleaners(spark, d):
    t = F.col("title")
    return subs(spark, d).select("grp", "ord", subtitles.title_plain(t).alias("plain"), subtitles.title_dubbed(t).alias("dubbed"), subtitles.title_hearing(t).alias("hearing"), subtitles.title_forced(t).alias("forced"))


SYNONYMS = [("en", 0, ""), ("en", 0, "english"), ("fr", 0, "fr"), ("fr", 0, ""), ("de", 0, "plain"), ("de", 1, "plain"), ("it", 0, "x")]


@query(f"""WITH {SUBS_SQL}, y(language, g, t) AS (VALUES {", ".join(map(str, SYNONYMS))}) SELECT grp, ord, coalesce('#' || (SELECT min(g) FROM y WHERE y.language = subs.language AND t = trim(coalesce(title, ''))), '=' || trim(coalesce(title, ''))) AS title_group FROM subs""")
def title_groups(spark, d):
    known = spark.createDataFrame(SYNONYMS, "language string, group int, title string")
    return subtitles.title_group(subs(spark, d), subtitles.title_plain(F.col("title")), known, "title_group").select("grp", "ord", "title_group")


@query(f"""WITH {SUBS_SQL}, h AS (SELECT *, md5(length(text) % 4 || '') AS h FROM subs) SELECT grp, ord, keep AND NOT (class = 'plain' AND EXISTS (SELECT 1 FROM h s WHERE s.grp = h.grp AND s.language = h.language AND s.h = h.h AND s.class = 'styled' AND s.keep)) AS keep FROM h""")
def unlike_styled(spark, d):
    rows = subs(spark, d).withColumn("h", F.md5((F.length("text") % 4).cast("string")))
    return subtitles.unlike_styled(rows, "h").select("grp", "ord", "keep")


@query(r"""WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 3 > 0 THEN repeat('Style: a' || chr(10), (doc_id % 3)::INT) || 'Dialogue: 0,0:00:01.00,0:00:02.00,' || text END AS ass FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, md5(CASE WHEN ass IS NULL THEN NULL WHEN doc_id % 3 > 1 THEN array_to_string(list_transform(list_filter(string_split(ass, chr(10)), lambda x: trim(x) <> ''), lambda x: regexp_replace(x, '^[^,
]+,\d[^,
]+,[^,
]+,', '')), chr(10))
ELSE nullif(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->')), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), chr(10)), '') END) AS text_md5 FROM d) SELECT * FROM f""")
def text_hash_styled(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    ass = F.when(F.col("doc_id") % 3 > 0, F.concat(F.repeat(F.lit("Style: a\n"), (F.col("doc_id") % 3).cast("int")), F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,"), "text"))
    return docs.select("doc_id", subtitles.text_hash(F.col("text"), ass).alias("text_md5"))


@query(rf"""WITH {SUBS_SQL}, y(language, g, t) AS (VALUES {", ".join(map(str, SYNONYMS))}),
a AS (SELECT *, keep AND NOT (md5 <> '' AND row_number() OVER (PARTITION BY grp, md5, keep ORDER BY language, ord) > 1) AS k, coalesce(regexp_matches(lower(title), 'forced|forcé'), false) AS fo, contains(lower(coalesce(title, '')), 'sdh') OR contains(lower(coalesce(title, '')), '(cc)') OR lower(coalesce(title, '')) IN ('cc', 'hi') OR hearing AS he, coalesce(contains(lower(title), 'dubtitle'), false) AS du FROM subs),
b AS (SELECT *, CASE WHEN he THEN 2 WHEN du THEN 3 WHEN NOT fo THEN 4 END AS kind, trim(regexp_replace(lower(coalesce(title, '')), '\s*\(?forced\)?\s*', '')) AS ft, trim(CASE WHEN he THEN CASE WHEN contains(lower(title), 'sdh') THEN regexp_replace(lower(title), '\s*\(?sdh\)?\s*', '') WHEN contains(lower(title), '(cc)') THEN regexp_replace(lower(title), '\s*\(cc\)\s*', '') WHEN lower(title) IN ('hi', 'cc') THEN '' ELSE lower(coalesce(title, '')) END
 WHEN du THEN regexp_replace(lower(title), '\s*\(?dubtitle\)?\s*', '') ELSE coalesce(title, '') END) AS tt FROM a),
c AS (SELECT *, coalesce('#' || (SELECT min(g) FROM y WHERE y.language = b.language AND t = ft), '=' || ft) AS fg, coalesce('#' || (SELECT min(g) FROM y WHERE y.language = b.language AND t = tt), '=' || tt) AS tg FROM b),
e AS (SELECT *, CASE WHEN k AND fo AND class = 'plain' THEN row_number() OVER (PARTITION BY grp, language, fg, k, fo, class ORDER BY ord) END AS fp, count_if(k AND class = 'styled') OVER (PARTITION BY grp, language, fg, fo) > 0 AS fs,
 count_if(k AND class = 'styled') OVER (PARTITION BY grp, language, tg, kind) > 0 AS ks, CASE WHEN k AND fo AND class = 'styled' THEN row_number() OVER (PARTITION BY grp, language, fg, k, fo, class ORDER BY ord) END AS fa, CASE WHEN k AND kind IS NOT NULL AND class = 'styled' THEN row_number() OVER (PARTITION BY grp, language, tg, kind, k, class ORDER BY ord) END AS ka,
 CASE language WHEN 'en' THEN 'keep' WHEN 'fr' THEN 'try' ELSE 'no' END AS li FROM c),
e1 AS (SELECT *, k AND coalesce(fp IS NOT NULL AND (fs OR fp > 1), false) AS one FROM e), e2 AS (SELECT *, k AND NOT one AS live FROM e1),
e3 AS (SELECT *, CASE WHEN live AND kind IS NOT NULL AND class = 'plain' THEN row_number() OVER (PARTITION BY grp, language, tg, kind, live, class ORDER BY ord) END AS kp FROM e2),
f AS (SELECT *, coalesce(fa > 1, false) AS xf, coalesce(ka > 1, false) AS xk, kp IS NOT NULL AND (ks OR kp > 1) AS pl FROM e3),
g AS (SELECT *, CASE WHEN NOT k THEN [] WHEN one THEN [100000000] WHEN pl AND li = 'no' THEN [200000000] WHEN pl AND li = 'try' THEN [300000000 + kind] WHEN (xf OR xk) AND li = 'no' THEN list_filter([CASE WHEN xf THEN 400000001 + ascii(language) * 10000 END, CASE WHEN xk THEN 400000000 + ascii(language) * 10000 + kind END], lambda v: v IS NOT NULL)
 WHEN pl AND li = 'keep' THEN [500000000 + kind] WHEN li = 'no' THEN [600000000 + ascii(language) * 10000 + ord] WHEN (xf OR xk) AND li = 'try' THEN list_filter([CASE WHEN xf THEN 700000001 END, CASE WHEN xk THEN 700000000 + kind END], lambda v: v IS NOT NULL) ELSE [] END AS steps FROM f),
h AS (SELECT grp, step, sum(count(*)) OVER (PARTITION BY grp ORDER BY step) - count(*) AS before FROM (SELECT grp, unnest(steps) AS step FROM g) GROUP BY grp, step),
n AS (SELECT grp, count_if(k) AS total FROM g GROUP BY grp), l AS (SELECT grp, max(step) AS last FROM h JOIN n USING (grp) WHERE total - before > 2 GROUP BY grp)
SELECT grp, ord, k AND NOT coalesce(list_min(steps) <= last, false) AS keep, CAST(list_min(steps) // 100000000 AS INTEGER) AS stage FROM g LEFT JOIN l USING (grp)""")
def subtitle_budget(spark, d):
    known = spark.createDataFrame(SYNONYMS, "language string, group int, title string")
    return subtitles.pruned(subs(spark, d), F.lit(2), known, ["en"], ["fr"]).select("grp", "ord", "keep", F.col("step.stage").alias("stage"))


# ---- episodes, knockouts and plans


@query(f"""WITH {ROUTED_SQL}, f AS (SELECT folder_id, episode, nom, weight, id, id % 1000 AS size, CASE WHEN id % 3 > 0 THEN 's' || (id % 3) END AS signature FROM episodes WHERE episode IS NOT NULL),
c AS (SELECT folder_id, episode, signature, count(*) AS files, arg_max(nom, weight * 10000000000 - id) AS first, max(weight * 10000000000 - id) AS top, arg_max(nom, weight * 100000000000000 + size * 10000000000 + id) AS held, max(weight) AS weight FROM f GROUP BY ALL)
SELECT folder_id, episode, signature, CASE WHEN top = best THEN 'primary' ELSE 'incompatible' END AS role, CASE WHEN top = best THEN first ELSE held END AS nom, weight, files FROM (SELECT *, max(top) OVER (PARTITION BY folder_id, episode) AS best FROM c)""")
def episode_rejects(spark, d):
    files = episodes(spark, d).where("episode is not null").select("folder_id", "episode", "nom", "weight", "id", (F.col("id") % 1000).alias("size"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("signature"))
    return routing.with_rejects(files)


@query("""SELECT * FROM (VALUES ('clip7', 'clip([0-9]+)', '7'), ('a_E3.mkv', '(?P<kind>[a-z])_E(?P<episode>[0-9]+)', '3'), ('x Ep12 y', 'Ep([0-9]+)', '12'), ('S01E05', 'S([0-9]+)E(?P<episode>[0-9]+)', '05'), ('show (3)', '\\(([0-9])\\)', '3'), ('[4] q', '[(]?q', NULL), ('none', 'no(x)?ne', NULL)) t(nom, regex_pattern, episode)""")
def episode_groups(spark, d):
    rows = [("clip7", "clip([0-9]+)"), ("a_E3.mkv", "(?P<kind>[a-z])_E(?P<episode>[0-9]+)"), ("x Ep12 y", "Ep([0-9]+)"), ("S01E05", "S([0-9]+)E(?P<episode>[0-9]+)"), ("show (3)", r"\(([0-9])\)"), ("[4] q", "[(]?q"), ("none", "no(x)?ne")]
    return spark.createDataFrame(rows, "nom string, regex_pattern string").withColumn("episode", scalars.episode_text(F.col("nom"), F.col("regex_pattern")))


@query(f"""WITH {ROUTED_SQL}, m AS (SELECT n.id, n.nom, r.folder_id, row_number() OVER (PARTITION BY n.id ORDER BY r.regex_pattern) AS rn FROM names n JOIN rules r ON regexp_matches(n.nom, r.regex_pattern)) SELECT id, nom, folder_id FROM m WHERE rn = 1""")
def route_table_order(spark, d):
    return routing.first_match(names(spark, d), rule_table(spark), by_weight=False).select("id", "nom", "folder_id")


KNOCK_SQL = "t AS (SELECT DISTINCT l_orderkey AS grp, l_linenumber::BIGINT AS name FROM lineitem)"


def compared(spark, d):
    """Comparisons of the lines of an order: the smaller remainder wins; lines whose numbers differ by three don't fit."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("name"))
    t = lines.repartition(dealt(lines), "grp").distinct()  # dealt once: what follows goes by grp
    a, b = t.withColumnRenamed("name", "a"), t.withColumnRenamed("name", "b")
    score = lambda c: (F.col(c) * 5 + F.col("grp")) % 7
    pairs = a.join(b, "grp").where("a < b").withColumn("a_wins", F.when(F.col("b") - F.col("a") != 3, score("a") < score("b")))
    return t, pairs


@query(f"WITH {KNOCK_SQL}, m AS (SELECT grp, max(name) AS winner FROM t WHERE name <= 4 GROUP BY grp) SELECT grp, winner, name AS loser, name > winner AND name - winner <> 3 AS compatible FROM m JOIN t USING (grp) WHERE name <> winner")
def forced_star(spark, d):
    t, pairs = compared(spark, d)
    best = t.where("name <= 4").groupBy("grp").agg(F.max("name").alias("best"))
    files = t.join(best, "grp").withColumn("forced", F.col("name") == F.col("best")).drop("best")
    return merging.star(files, pairs.withColumn("fits", F.col("a_wins").isNotNull()))


# the rounds of a knockout among the files of t (grp, name), as lists: who stands in each round, who meets, and whom each file ends under
ROUNDS_SQL = """s AS (SELECT grp, 0 AS round, list(name ORDER BY name) AS names FROM t GROUP BY grp UNION ALL
  SELECT grp, round + 1, list_filter(names, lambda x: NOT list_contains(list_transform(met, lambda p: p.loser), x)) FROM (SELECT *, {met} AS met FROM s WHERE {going})),
edges AS (SELECT grp, p.winner AS winner, p.loser AS loser, round FROM (SELECT grp, round, unnest({met}) AS p FROM s WHERE {going})),
under AS (SELECT grp, name AS top, name, 0::BIGINT AS delay FROM t UNION ALL SELECT e.grp, e.winner, u.name, u.delay + CASE WHEN e.winner < e.loser THEN 10 ELSE -10 END * e.winner FROM under u JOIN edges e ON e.grp = u.grp AND e.loser = u.top),
tops AS (SELECT u.* FROM under u ANTI JOIN edges e ON e.grp = u.grp AND e.loser = u.top), sizes AS (SELECT grp, top, count(*) AS n FROM tops GROUP BY grp, top),
best AS (SELECT grp, arg_max(top, n * 100 - top) AS top FROM sizes GROUP BY grp), out AS (SELECT tops.grp, tops.name FROM tops ANTI JOIN best ON best.grp = tops.grp AND best.top = tops.top)""".format(
    going="len(names) > 2 OR (len(names) = 2 AND names[2] - names[1] <> 3)",
    met="list_transform(list_filter(list_transform(range(len(names)), lambda i: {'i': i, 'j': ((round - i) % len(names) + len(names)) % len(names)}), lambda p: p.i < p.j AND abs(names[p.i + 1] - names[p.j + 1]) <> 3), "
    "lambda p: CASE WHEN (names[p.i + 1] * 5 + grp) % 7 < (names[p.j + 1] * 5 + grp) % 7 THEN {'winner': names[p.i + 1], 'loser': names[p.j + 1]} ELSE {'winner': names[p.j + 1], 'loser': names[p.i + 1]} END)",
)


@query(f"WITH RECURSIVE {KNOCK_SQL}, {ROUNDS_SQL} SELECT * FROM edges")
def knockout_edges(spark, d):
    t, pairs = compared(spark, d)
    return merging.knockout(t.withColumn("place", F.col("name")), pairs)[0]


@query(f"WITH RECURSIVE {KNOCK_SQL}, {ROUNDS_SQL} SELECT * FROM out")
def knockout_rejects(spark, d):
    t, pairs = compared(spark, d)
    return merging.knockout(t.withColumn("place", F.col("name")), pairs)[1]


@query(f"""WITH RECURSIVE a AS (SELECT DISTINCT l_orderkey AS grp, l_linenumber::BIGINT AS file, CASE WHEN l_linenumber % 4 = 3 THEN 'fr' ELSE 'en' END AS language FROM lineitem),
v AS (SELECT grp, language, n = sum(n) OVER (PARTITION BY grp) AS everywhere, n FROM (SELECT grp, language, count(*) AS n FROM a GROUP BY ALL)),
chosen AS (SELECT grp, language FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY everywhere DESC, n DESC, language = 'en' DESC, language) AS rn FROM v) WHERE rn = 1),
t AS (SELECT grp, file AS name FROM a JOIN chosen USING (grp, language)), {ROUNDS_SQL},
x AS (SELECT a.grp, file, language, CASE WHEN file % 2 = 0 THEN 'audio' ELSE 'subtitle' END AS kind, 'k' || (file % 3) AS key, file AS ord, file % 5 > 0 AS keep, tops.delay AS delay_ms FROM a JOIN tops ON tops.grp = a.grp AND tops.name = file ANTI JOIN out ON out.grp = a.grp AND out.name = file),
y AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key, ord) AS place FROM x WHERE keep)
SELECT grp, file, language, kind, key, ord, keep, 'take' AS action, place, CAST(delay_ms AS INTEGER) AS delay_ms, kind <> 'subtitle' AND row_number() OVER (PARTITION BY grp, kind ORDER BY place) = 1 AS is_default FROM y
UNION ALL SELECT grp, file, language, kind, key, ord, keep, 'remove', NULL, NULL, false FROM x WHERE NOT keep""")
def sync_plan(spark, d):
    t, pairs = compared(spark, d)
    n = F.col("name")
    rows = t.select("grp", n.alias("file"), F.when(n % 4 == 3, "fr").otherwise("en").alias("language"), F.when(n % 2 == 0, "audio").otherwise("subtitle").alias("kind"), F.concat(F.lit("k"), (n % 3).cast("string")).alias("key"), n.alias("ord"), (n % 5 > 0).alias("keep"))
    between = pairs.select("grp", F.col("a").alias("winner"), F.col("b").alias("loser"), (F.col("a") * 10).alias("delay_ms")).unionByName(pairs.select("grp", F.col("b").alias("winner"), F.col("a").alias("loser"), (F.col("b") * -10).alias("delay_ms")))
    return merging.sync_plan(rows, pairs, between, "en")[0]


@query("""WITH t AS (SELECT conv_id AS grp, turn AS file, role AS kind, length(text) % 3 AS key, turn AS ord, length(text) % 4 > 0 AS keep FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY key, ord) AS place FROM t WHERE keep)
SELECT grp, file, kind, 'take' AS action, place, CAST(file * 10 AS INTEGER) AS delay_ms, kind <> 'subtitle' AND row_number() OVER (PARTITION BY grp, kind ORDER BY place) = 1 AS is_default FROM k UNION ALL SELECT grp, file, kind, 'remove', NULL, NULL, false FROM t WHERE NOT keep""")
def merge_commands(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("file"), F.col("role").alias("kind"), (F.length("text") % 3).alias("key"), F.col("turn").alias("ord"), (F.length("text") % 4 > 0).alias("keep"))
    at = c.select(F.col("conv_id").alias("grp"), F.col("turn").alias("file"), (F.col("turn") * 10).cast("int").alias("delay_ms")).distinct()
    return merging.commands(rows, at).select("grp", "file", "kind", "action", "place", F.col("delay_ms").cast("int").alias("delay_ms"), "is_default")


@query("SELECT o_custkey AS grp, CAST(min(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END) AS INTEGER) AS channels, CAST(CASE WHEN min(o_totalprice) > 540 THEN 120 WHEN min(o_totalprice) > 60 THEN 30 WHEN min(o_totalprice) > 5 THEN 0 END AS BIGINT) AS begin_s, CAST(trunc(CASE WHEN min(o_totalprice) > 540 THEN (min(o_totalprice) - 240) / 11 WHEN min(o_totalprice) > 60 THEN (min(o_totalprice) - 45) / 11 WHEN min(o_totalprice) > 5 THEN min(o_totalprice) - 2 / 11 END) AS BIGINT) AS length_s FROM orders GROUP BY o_custkey")
def merge_grid(spark, d):
    files = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_totalprice").alias("duration_s"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2).alias("channels"))
    return merging.segment_grid(files, 10)


@query("SELECT o_custkey AS grp, o_orderkey AS name FROM orders WHERE o_orderkey % 4 <> 1")
def not_compatible(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name"))
    return merging.not_compatible(o, o.where("name % 4 = 1"))


# ---- sources and scalars


@query("SELECT p_partkey, p_partkey % 2 = 0 AS grouping, p_partkey % 3 = 0 AS merge, p_partkey % 4 < 2 AS is_media, CASE WHEN p_partkey % 5 = 0 THEN '7' ELSE '5' END AS number_cut, 'x' AS mode FROM part")
def folder_directives(spark, d):
    k = F.col("p_partkey")
    folder = F.concat("p_name", F.when(k % 2 == 0, " [grouping]").otherwise(""), F.when(k % 3 == 0, " [merge]").otherwise(""))
    name = F.concat(F.lit("clip."), F.get(F.array(*map(F.lit, ("MKV", "mp4", "srt", "avi.part"))), k % 4))
    grouping, merge = metadata.directive(folder)
    rows = table(spark, d, "part").select(k, grouping.alias("grouping"), merge.alias("merge"), metadata.media_file(name).alias("is_media"), F.when(k % 5 == 0, '{"number_cut": 7}').when(k % 5 == 1, "no json").alias("json"))
    return metadata.overridden(rows, "json", {"number_cut": "5", "mode": "x"})


@query("SELECT doc_id, i AS \"index\", ['srt', 'ass'][i + 1] AS codec_name, CASE WHEN i = 0 THEN '128000' END AS bit_rate FROM documents, (SELECT unnest(range(0, 2)) AS i)")
def stream_documents(spark, d):
    json = F.lit('{"streams": [{"index": 0, "codec_name": "srt", "bit_rate": "128000", "other": 1}, {"index": 1, "codec_name": "ass"}]}')
    return metadata.stream_tracks(table(spark, d, "documents").select("doc_id", json.alias("json"))).withColumn("index", F.col("index").cast("long"))


@query("SELECT l_orderkey, l_linenumber, l_orderkey AS id, l_linenumber::VARCHAR AS codec, l_linenumber = 1 AS repeated FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_orderkey, 'twice', true FROM lineitem WHERE l_linenumber = 1")
def property_documents(spark, d):
    n = F.col("l_linenumber").cast("string")
    one = F.concat(F.lit('{"id": '), F.col("l_orderkey").cast("string"), F.lit(', "properties": {"codec": "'), n, F.lit('"}}'))
    again = F.when(F.col("l_linenumber") == 1, F.concat(F.lit(', {"id": '), F.col("l_orderkey").cast("string"), F.lit(', "properties": {"codec": "twice"}}'))).otherwise("")
    rows = table(spark, d, "lineitem").withColumn("_row", F.monotonically_increasing_id()).select("l_orderkey", "l_linenumber", "_row", F.concat(F.lit('{"tracks": ['), one, again, F.lit("]}")).alias("json"))
    return metadata.property_tracks(rows).select("l_orderkey", "l_linenumber", F.col("id").cast("long").alias("id"), "codec", "repeated")


@query("SELECT p_partkey, p_name AS title, p_size::DOUBLE AS channels, CASE WHEN p_partkey % 2 = 0 THEN 48000 ELSE 44100 END AS sampling_rate, p_partkey * 100 AS bitrate FROM part")
def container_documents(spark, d):
    text = F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("Audio").alias("@type"), F.col("p_name").alias("Title"), F.col("p_size").cast("string").alias("Channels"), F.when(F.col("p_partkey") % 2 == 0, "48000").alias("SamplingRate"), (F.col("p_partkey") * 100).cast("string").alias("BitRate_Nominal"))).alias("track")).alias("media")))
    rows = metadata.container_tracks(table(spark, d, "part").select("p_partkey", text.alias("json")))
    return rows.select("p_partkey", "title", "channels", "sampling_rate", "bitrate")


@query("SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 44100 ELSE event_id END AS INTEGER) AS rate, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1.5 + event_id % 7 END::DOUBLE AS seconds, list_transform(range(0, event_id % 3), lambda i: i + 0.25::DOUBLE) AS scenes FROM events")
def probe_text(spark, d):
    e = F.col("event_id")
    text = F.concat_ws("\n", F.when(e % 3 > 0, e.cast("string")).otherwise("N/A"), F.when(e % 2 > 0, (e % 7 + 1.5).cast("string")).otherwise("-"), F.lit("12"))
    text = F.when(e % 3 > 0, text).otherwise(F.replace(text, F.lit("\n12"), F.lit("")))
    log = F.concat_ws(" ", F.lit("x"), F.array_join(F.transform(F.slice(F.array(F.lit(0.25), F.lit(1.25)), 1, (e % 3).cast("int")), lambda x: F.concat(F.lit("pts_time:"), x.cast("string"))), " "))
    rate, seconds = metadata.probed(text)
    return table(spark, d, "events").select(e, rate.alias("rate"), seconds.alias("seconds"), metadata.scene_times(log).alias("scenes"))


@query("SELECT event_id, event_id % 86400 + event_id % 1000 / 1000.0::DOUBLE AS seconds, event_type AS first, CASE WHEN abs(-23 - (event_id % 5 / 4.0 - 24)) < 0.5 THEN 0 ELSE round(-23 - (event_id % 5 / 4.0 - 24), 2) END::DOUBLE AS gain FROM events")
def clock_and_gain(spark, d):
    e = F.col("event_id")
    text = scalars.clock(e % 86400 + F.lit(0.0005) + (e % 1000) / 1000.0)
    measured = F.when(e >= 0, (e % 5) / 4.0 - 24)
    return table(spark, d, "events").select(e, F.round(scalars.seconds_of(text), 3).alias("seconds"), scalars.first_word(F.concat(F.lit("  "), "event_type", F.lit(" rest"))).alias("first"), scalars.gain(measured).cast("double").alias("gain"))


@query("SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, 'out/' || page_id || '/x' AS path FROM pages WHERE NOT starts_with(string_split(url, '/')[-1], '.')")
def path_parts(spark, d):
    return table(spark, d, "pages").where(~scalars.base_name(F.col("url")).startswith(".")).select("page_id", scalars.base_name(F.col("url")).alias("base"), scalars.stem(F.col("url")).alias("stem"), scalars.joined_path(F.lit("out"), F.col("page_id").cast("string"), F.lit("x")).alias("path"))


@query("SELECT event_id, (CASE WHEN event_id % 2 = 0 THEN event_id / 25.0 ELSE event_id % 9 END)::DOUBLE AS duration, event_id % 4 > 0 AS comparable, 'full' AS strategy FROM events")
def duration_and_strategy(spark, d):
    e = F.col("event_id")
    seconds = F.when(e % 2 > 0, (e % 9).cast("string"))
    print_ = F.when(e % 4 > 0, F.array(e))
    return table(spark, d, "events").select(e, records.duration(e.cast("string"), F.lit("25"), seconds).alias("duration"), records.comparable(print_).alias("comparable"), records.strategy(e % 100 + 1, F.lit(10), 1e9).alias("strategy"))


@query("SELECT doc_id, ['a.mkv', 'b/c.mkv'][1:(doc_id % 3)::INT] AS paths FROM documents")
def failed_files(spark, d):
    k = (F.col("doc_id") % 3).cast("int")
    message = F.when(k == 0, "all well").when(k == 1, "['a.mkv'] not compatible with the others").otherwise("['a.mkv', 'b/c.mkv'] not have the language")
    return table(spark, d, "documents").select("doc_id", records.failed_paths(F.replace(message, F.lit("not have"), F.lit("not have"))).alias("paths"))


@query("SELECT l_orderkey, l_linenumber, CAST(min(l_linenumber) OVER w AS INTEGER) AS representative, (first(l_linenumber / 8.0::DOUBLE) OVER w - l_linenumber / 8.0::DOUBLE) * 1000 AS delay_ms FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
def same_sound_delays(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    out = records.constant_delays(rows.select(F.struct("l_orderkey", "l_linenumber").alias("owner"), F.col("l_orderkey").alias("signature"), (F.col("l_linenumber") / 8.0).alias("delay_s")))
    return out.select("owner.l_orderkey", "owner.l_linenumber", F.col("representative.l_linenumber").alias("representative"), "delay_ms")


@query("SELECT l_orderkey, l_linenumber, l_quantity, place FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem) WHERE place <= 3")
def first_within_budget(spark, d):
    rows = table(spark, d, "lineitem")
    return tracks.within_budget(rows, "l_orderkey", [F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "l_quantity", F.col("place").cast("long").alias("place"))


@query("SELECT lang FROM documents WHERE lang IS NOT NULL UNION SELECT lower(n_name) FROM nation")
def accumulated_set(spark, d):
    return tracks.accumulated(table(spark, d, "documents").select("lang").where("lang is not null"), table(spark, d, "nation").select(F.lower("n_name").alias("lang")))


@query("SELECT conv_id, count(DISTINCT nullif(h, '')) + count_if(h = '') AS tracks FROM (SELECT conv_id, CASE WHEN length(text) % 3 = 0 THEN '' ELSE role END AS h FROM conversations) GROUP BY conv_id")
def unique_tracks(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.length("text") % 3 == 0, "").otherwise(F.col("role")).alias("h"))
    return tracks.unique_tracks(rows, "conv_id", "h")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_name")
def catalog_listing(spark, d):
    return catalog.listing(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name")


@query("SELECT doc_id, coalesce(k.code, m.code, nullif(split_part(x, '-', 1), ''), 'und') AS language FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'cmn' WHEN doc_id % 5 = 1 THEN lang || '-XX' ELSE lang END AS x FROM documents) LEFT JOIN (VALUES ('en', 'en'), ('de', 'de'), ('eng', 'en')) k(c, code) ON k.c = x LEFT JOIN (VALUES ('cmn', 'zh')) m(c, code) ON m.c = x")
def lang_macro(spark, d):
    code = F.when(F.col("doc_id") % 5 == 0, "cmn").when(F.col("doc_id") % 5 == 1, F.concat("lang", F.lit("-XX"))).otherwise(F.col("lang"))
    known = spark.createDataFrame([("en", "en"), ("de", "de"), ("eng", "en")], "x string, known string")
    macro = spark.createDataFrame([("cmn", "zh")], "x string, macro string")
    rows = table(spark, d, "documents").select("doc_id", code.alias("x")).join(F.broadcast(known), "x", "left").join(F.broadcast(macro), "x", "left")
    return rows.select("doc_id", scalars.normal_language(F.col("x"), F.col("known"), F.col("macro")).alias("language"))


@query("SELECT doc_id, source FROM documents WHERE source = 'src1' OR 'dir/' || doc_id = 'src1' ORDER BY doc_id DESC LIMIT 1")
def forced_winner_named(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("name"), F.concat(F.lit("dir/"), F.col("doc_id").cast("string")).alias("path"))
    return records.forced_winner_named(docs, "src1", "doc_id").select("doc_id", F.col("name").alias("source"))


@query(f"""WITH RECURSIVE {FACTORS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, format, bitrate) AS n FROM (SELECT {SOUNDS_SQL} FROM lineitem)),
held AS (SELECT l_orderkey, n, n AS place, format, bitrate FROM l WHERE n = 1 UNION ALL SELECT l_orderkey, n, CASE WHEN stays THEN since ELSE n END, CASE WHEN stays THEN had ELSE format END, CASE WHEN stays THEN rate ELSE bitrate END
  FROM (SELECT l.l_orderkey, l.n, l.format, l.bitrate, h.place AS since, h.format AS had, h.bitrate AS rate, CASE WHEN l.format = h.format THEN h.bitrate < l.bitrate ELSE coalesce(l.bitrate * factor > h.bitrate, false) END AS stays
  FROM held h JOIN l ON l.l_orderkey = h.l_orderkey AND l.n = h.n + 1 LEFT JOIN f ON f.strong = l.format AND f.weak = h.format))
SELECT l_orderkey, l_linenumber, format, bitrate, l.n = w.place AS is_worst FROM l JOIN (SELECT l_orderkey, arg_max(place, n) AS place FROM held GROUP BY l_orderkey) w USING (l_orderkey)""")
def worst_track(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, ("flac", "ac3", "mp3", "dts"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("format"), F.col("l_extendedprice").alias("bitrate"))
    return selection.worst(lines, "l_orderkey", "l_linenumber", RULE_TEXT)


COMPARED = [("ac3", 10.0, "mp3", 10.0), ("mp3", 10.0, "ac3", 10.0), ("flac", 10.0, "ac3", 11.0), ("flac", 10.0, "ac3", 12.0), ("FLAC", 9.0, "ac3", 9.0), ("opus", 1.0, "ac3", 1.0), ("dts", 1.0, "aac", 500.0), ("aac", 500.0, "dts", 1.0)]


@query("SELECT * FROM (VALUES ('ac3', 10.0::DOUBLE, 'mp3', 10.0::DOUBLE, 1), ('mp3', 10.0, 'ac3', 10.0, 0), ('flac', 10.0, 'ac3', 11.0, 2), ('flac', 10.0, 'ac3', 12.0, 0), ('FLAC', 9.0, 'ac3', 9.0, 1), ('opus', 1.0, 'ac3', 1.0, 2), ('dts', 1.0, 'aac', 500.0, 1), ('aac', 500.0, 'dts', 1.0, 0)) t(challenger, rate, base, base_rate, verdict)")
def rules_comparator(spark, d):
    rules = parse(RULE_TEXT)
    return spark.createDataFrame([(*x, compare(rules, x[:2], x[2:])) for x in COMPARED], "challenger string, rate double, base string, base_rate double, verdict int")


@query("SELECT label AS file, CAST(40 AS BIGINT) AS lag FROM embeddings GROUP BY label HAVING count(*) > 2")
def overlap_save_blocks(spark, d):
    """Each label's vectors as one signal in blocks, and 48 samples of it from the fortieth on: the lag to find."""
    rows = table(spark, d, "embeddings").select(F.col("label").alias("file"), "vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    some = rows.groupBy("file").count().where("count > 2").select("file")
    blocks = numbered(rows.join(some, "file", "left_semi"), ["file"], "vec_id", "block").withColumn("block", F.col("block") - 1)
    two = blocks.where("block < 2").groupBy("file").agg(F.flatten(F.array_sort(F.collect_list(F.struct("block", "samples")))["samples"]).alias("x"))
    return signals.lag_by_blocks(blocks, two.select("file", F.slice("x", 41, 48).alias("y")), 64).select("file", "lag")


# ---- catalog changes, keys and remaining functions


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 3 > 0 UNION ALL SELECT p_partkey, 'new', p_size FROM part WHERE p_partkey % 3 = 0")
def catalog_insert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return catalog.insert(part.where("p_partkey % 3 > 0"), part.withColumn("p_name", F.lit("new")), ["p_partkey"])


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'changed' ELSE p_name END AS p_name, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END::INTEGER AS p_size FROM part")
def catalog_update(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", F.col("p_size").cast("int").alias("p_size"))
    changes = part.where("p_partkey % 4 = 0").select("p_partkey", F.lit("changed").alias("p_name"), F.when(F.col("p_partkey") % 8 == 0, 0).cast("int").alias("p_size"))
    return catalog.update(part, changes, ["p_partkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def catalog_by_key(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = orders.agg(F.min("o_custkey").alias("c")).first().c
    return catalog.matching(orders, o_custkey=first)


@query("SELECT event_id, CASE WHEN t >= 0 THEN t // 1000 END AS second, CASE WHEN t >= 0 THEN t % 1000 END AS ms FROM (SELECT event_id, event_id % 120 * 1000 + event_id % 90001 - 45000 AS t FROM events)")
def begin_with_delay(spark, d):
    e = F.col("event_id")
    second, ms = scalars.shifted_begin(e % 120, e % 90001 - 45000)
    return table(spark, d, "events").select(e, second.alias("second"), ms.alias("ms"))


@query("SELECT event_id, CAST(greatest(1, ceil(abs(log2(r)))) AS INTEGER) AS steps, round(r ** (1 / greatest(1, ceil(abs(log2(r))))), 9) AS factor FROM (SELECT event_id, 0.1::DOUBLE + event_id % 97 / 10.0::DOUBLE AS r FROM events)")
def tempo_factors(spark, d):
    chain = scalars.tempo_chain(F.lit(0.1) + (F.col("event_id") % 97) / 10.0)
    return table(spark, d, "events").select("event_id", F.size(chain).alias("steps"), F.round(chain[0], 9).alias("factor"))


@query("SELECT conv_id, turn, role AS kind, CASE WHEN role = 'system' THEN NULL ELSE substr(md5(text), 1, 16) END AS short_hash FROM conversations")
def track_hashes(spark, d):
    return tracks.hashed(table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("kind"), F.col("text").alias("content")), {"user": F.col("content"), "assistant": F.col("content")}).select("conv_id", "turn", "kind", F.substring("hash", 1, 16).alias("short_hash"))


@query("""SELECT p_partkey, l || CASE WHEN p_size % 4 = 0 THEN '_forced' WHEN p_size % 4 = 1 THEN '_hearing' WHEN p_size % 4 = 2 THEN '_dubtitle' ELSE '_aa' END || CASE p_partkey % 3 WHEN 0 THEN '_uncodable' WHEN 1 THEN '_srt' ELSE '_all' END AS subtitle_key, l || CASE p_size % 3 WHEN 0 THEN '_com' WHEN 1 THEN '_visuali' ELSE '' END AS audio_key FROM (SELECT *, ['en', 'fr'][p_partkey % 2 + 1] AS l FROM part)""")
def output_keys(spark, d):
    size, k = F.col("p_size"), F.col("p_partkey")
    language = F.when(k % 2 == 0, "en").otherwise("fr")
    role = F.when(size % 4 == 0, "forced").when(size % 4 == 1, "hearing").when(size % 4 == 2, "dubtitle").otherwise("plain")
    class_ = F.when(k % 3 == 0, "picture").when(k % 3 == 1, "plain").otherwise("styled")
    sound = F.when(size % 3 == 0, "commentary").when(size % 3 == 1, "audiodesc").otherwise("main")
    return table(spark, d, "part").select(k, tracks.subtitle_key(language, role, class_).alias("subtitle_key"), tracks.audio_key(language, sound).alias("audio_key"))


@query(f"""WITH RECURSIVE d AS (SELECT l_orderkey AS grp, l_linenumber::BIGINT AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)),
c AS (SELECT grp, n, [member] AS members, [member] AS cliques FROM d WHERE n = 1 UNION ALL
  SELECT grp, n, list_append(members, member), list_append(cliques, coalesce(list_min(list_filter(cliques, lambda q: len(list_filter(range(len(members)), lambda k: cliques[k + 1] = q AND (members[k + 1] + member + grp) % 2 <> 0)) = 0)), member))
  FROM (SELECT d.grp, d.n, d.member, c.members, c.cliques FROM c JOIN d ON d.grp = c.grp AND d.n = c.n + 1)),
e AS (SELECT grp, unnest(members) AS member, unnest(cliques) AS clique FROM (SELECT grp, arg_max(members, n) AS members, arg_max(cliques, n) AS cliques FROM c GROUP BY grp)),
sounds AS (SELECT s.*, e.clique, l_orderkey || '/' || e.clique AS one, e.member AS place FROM (SELECT {SOUNDS_SQL} FROM lineitem) s JOIN e ON e.grp = l_orderkey AND e.member = l_linenumber), {BEATEN_SQL}
SELECT l_orderkey AS grp, l_linenumber::BIGINT AS member, format, channels, rate, bitrate, clique, keep FROM k""")
def clique_winners(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_linenumber").cast("long").alias("member"), F.element_at(F.array(*map(F.lit, ("flac", "ac3", "mp3", "dts"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("format"), (F.col("l_suppkey") % 3 + 1).cast("double").alias("channels"), F.lit(48000).alias("rate"), F.col("l_extendedprice").alias("bitrate"))
    both = lines.select("grp", F.col("member").alias("i")).distinct().join(lines.select("grp", F.col("member").alias("j")).distinct(), "grp").where("i < j and (i + j + grp) % 2 = 0")
    return merging.best_per_clique(lines, both, RULE_TEXT)


@query("""WITH rows AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS segment, 0.8 + (event_id % 21) / 100.0::DOUBLE AS fidelity, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS offsets FROM events),
lim AS (SELECT user_id, least(greatest(avg(fidelity) - 0.75 * (max(fidelity) - min(fidelity)), 0.85), 0.95) AS lim, min(segment) AS lo, max(segment) AS hi, avg(fidelity) AS mean, bool_and(offsets > 1) AS torn FROM rows GROUP BY user_id),
marked AS (SELECT *, fidelity < lim OR offsets > 1 AS bad FROM rows JOIN lim USING (user_id)), islands AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY segment) AS island FROM marked),
r AS (SELECT user_id, greatest(min(segment) - 1, min(lo)) AS b FROM islands WHERE bad GROUP BY user_id, island), c AS (SELECT user_id, count(*) AS cuts, count_if(b % 7 = 0) AS open, var_pop(CASE WHEN b % 7 > 0 THEN b % 3 * 0.1 END) AS spread FROM r GROUP BY user_id)
SELECT user_id, round(mean, 6) AS mean_fidelity, coalesce(cuts, 0) AS cuts, CASE WHEN coalesce(cuts, 0) = 0 THEN NULL WHEN torn AND NOT coalesce(spread <= 0.12, false) THEN 'conflicting offsets' WHEN open > 0 THEN 'range not refined' WHEN mean < 0.85 THEN 'low fidelity' END AS reason FROM lim LEFT JOIN c USING (user_id)""")
def cut_run(spark, d):
    rows = numbered(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "segment")
    rows = rows.select("user_id", "segment", (F.lit(0.8) + (F.col("event_id") % 21) / 100.0).alias("fidelity"), F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).alias("offsets"))
    b = F.col("segment")
    known = rows.where(b % 7 > 0).select("user_id", b.alias("begin"), (b * 10.0).alias("begin_s"), (b * 10.0 + 5).alias("end_s"), F.lit(None).cast("double").alias("fps_main"), F.lit(None).cast("double").alias("fps_target"), F.lit(None).cast("int").alias("gap_begin"), F.lit(None).cast("int").alias("gap_end"), F.lit(None).cast("array<double>").alias("scene_s"), (b % 3 * 0.1).alias("lag_s"))
    return refine.run(rows, known, "user_id")[1].select("user_id", F.round("mean_fidelity", 6).alias("mean_fidelity"), "cuts", "reason")
