"""Queries over the supplied tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracklake.functions import scalars, signals
from tracklake.operators import catalog, correlation, cuts, delays, measuring, routing, rules, selection, tracks
from tracklake.operators.spread import numbered
from tracklake.plans.registry import query
from tracklake.sources.tables import cut, table
from tracklake.streaming.episodes import EpisodeState, watch

RULES = [("click_E([0-9]+)", 1, "Click {<episode>}.mkv", 5), ("(?:click|view)_E([0-9]+)", 2, "Seen {<episode>}.mkv", 3), ("purchase_E([0-9]+)", 3, "Bought {<episode>}.mkv", 9), ("p[a-z]+_E1([0-9])", 4, "Teen {<episode>}.mkv", 10), ("signup()", 5, "Joined.mkv", 1)]
FOLDERS = [(1, 20), (2, 25), (3, 12), (4, 99), (5, 12)]
RULES_SQL = "rules(regex_pattern, folder_id, rename_pattern, weight) AS (VALUES " + ", ".join(f"('{p}', {f}, '{r}', {w})" for p, f, r, w in RULES) + ")"
FOLDERS_SQL = "folders(folder_id, max_episode_number) AS (VALUES " + ", ".join(map(str, FOLDERS)) + ")"
NAMES_SQL = "names AS (SELECT event_id AS id, event_type || '_E' || (event_id % 30) || '.mkv' AS nom FROM events)"
ROUTED_SQL = f"""{RULES_SQL}, {FOLDERS_SQL}, {NAMES_SQL},
routed AS (SELECT * EXCLUDE (rn) FROM (SELECT n.id, n.nom, r.*, row_number() OVER (PARTITION BY n.id ORDER BY r.weight DESC, r.regex_pattern) AS rn
  FROM names n JOIN rules r ON regexp_matches(n.nom, r.regex_pattern)) WHERE rn = 1),
texted AS (SELECT *, nullif(regexp_extract(nom, regex_pattern, 1), '') AS t FROM routed),
episodes AS (SELECT * EXCLUDE (t), CASE WHEN regexp_full_match(t, '[0-9]+') AND TRY_CAST(t AS BIGINT) > 0 THEN TRY_CAST(t AS BIGINT) END AS episode,
  CASE WHEN t IS NULL THEN 'no episode' WHEN NOT (regexp_full_match(t, '[0-9]+') AND TRY_CAST(t AS BIGINT) > 0) THEN 'invalid episode' END AS reason FROM texted)"""


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "regex_pattern string, folder_id int, rename_pattern string, weight int")


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("_E"), (F.col("event_id") % 30).cast("string"), F.lit(".mkv")).alias("nom"))


def routed(spark: SparkSession, d: str) -> DataFrame:
    return routing.first_match(names(spark, d), rule_table(spark))


def episodes(spark: SparkSession, d: str) -> DataFrame:
    return routing.episodes_of(names(spark, d), rule_table(spark))


def folders(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FOLDERS, "folder_id int, max_episode_number int")


@query(f"WITH {ROUTED_SQL} SELECT id, nom, folder_id, weight FROM routed")
def route_first_match(spark, d):
    return routed(spark, d).select("id", "nom", "folder_id", "weight")


@query(f"WITH {ROUTED_SQL} SELECT id, folder_id, episode FROM episodes WHERE episode IS NOT NULL")
def extract_episode(spark, d):
    return episodes(spark, d).where("episode is not null").select("id", "folder_id", "episode")


@query(f"WITH {ROUTED_SQL} SELECT id, folder_id, episode, replace(rename_pattern, '{{<episode>}}', printf('%02d', episode)) AS target FROM episodes JOIN folders USING (folder_id) WHERE episode <= max_episode_number")
def rename_template(spark, d):
    return routing.with_target(episodes(spark, d), folders(spark)).select("id", "folder_id", "episode", "target")


@query(f"WITH {ROUTED_SQL} SELECT id, folder_id, replace(rename_pattern, '{{<episode>}}', printf('%02d', episode + 12)) AS target FROM episodes JOIN folders USING (folder_id) WHERE episode <= max_episode_number")
def increment_rename(spark, d):
    return routing.with_target(episodes(spark, d), folders(spark), step=12).select("id", "folder_id", "target")


@query(f"WITH {RULES_SQL}, {NAMES_SQL} SELECT id, nom FROM names n WHERE EXISTS (SELECT 1 FROM rules r WHERE regexp_matches(n.nom, r.regex_pattern))")
def regex_conflicts(spark, d):
    return routing.conflicts(names(spark, d), rule_table(spark))


@query(f"WITH {ROUTED_SQL} SELECT folder_id, episode, count(*) AS files, max(weight) AS best_weight, count(DISTINCT weight) AS weights FROM episodes WHERE episode IS NOT NULL GROUP BY ALL")
def group_by_folder_episode_weight(spark, d):
    return routing.by_weight(episodes(spark, d).where("episode is not null"))


@query(f"WITH {ROUTED_SQL} SELECT id, nom, folder_id, reason FROM episodes WHERE reason IS NOT NULL")
def reject_rows(spark, d):
    return episodes(spark, d).where("reason is not null").select("id", "nom", "folder_id", "reason")


@query(f"WITH {ROUTED_SQL} SELECT folder_id, episode, nom, weight, id FROM (SELECT *, row_number() OVER (PARTITION BY folder_id, episode ORDER BY weight DESC, id) AS rn FROM episodes WHERE episode IS NOT NULL) WHERE rn = 1")
def stream_episode_state(spark, d):
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")
    stream = stream.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("_E"), (F.col("event_id") % 30).cast("string"), F.lit(".mkv")).alias("nom"))
    state = EpisodeState(spark)
    watch(stream, rule_table(spark), state).awaitTermination()
    return state.read()


@query(f"WITH {ROUTED_SQL} SELECT folder_id, episode, nom, weight, id FROM (SELECT *, row_number() OVER (PARTITION BY folder_id, episode ORDER BY weight DESC, id) AS rn FROM episodes WHERE episode IS NOT NULL) WHERE rn = 1")
def episode_winners(spark, d):
    return routing.winners(episodes(spark, d).where("episode is not null"))


PERSON_RULES_SQL = """r AS (SELECT regex_pattern, max(folder_id) AS folder_id, max(weight) AS weight FROM (SELECT '_U' || user_id || '_E([0-9]+)' AS regex_pattern, CAST(user_id % 50 AS INTEGER) AS folder_id, CAST(user_id % 7 AS INTEGER) AS weight FROM events
  UNION ALL SELECT event_type || '_U[0-9]*' || (user_id % 100) || '_', 60, 3 FROM events WHERE user_id % 10 = 3 UNION ALL SELECT '^.{' || (9 + user_id % 9) || '}[13579]_E', 61, CAST(user_id % 9 - 6 AS INTEGER) FROM events WHERE user_id % 11 = 0) GROUP BY regex_pattern),
q AS (SELECT DISTINCT event_type || '_U' || user_id || '_E' || (event_id % 30) AS nom FROM events)"""


@query(f"""WITH {PERSON_RULES_SQL}, b AS (SELECT nom, arg_min(r, {{'w': -weight, 'p': regex_pattern}}) AS r FROM q JOIN r ON regexp_matches(nom, regex_pattern) GROUP BY nom)
SELECT event_id AS id, nom, r.regex_pattern AS regex_pattern, r.folder_id AS folder_id, r.weight AS weight FROM (SELECT event_id, event_type || '_U' || user_id || '_E' || (event_id % 30) AS nom FROM events) JOIN b USING (nom)""")
def route_many_rules(spark, d):
    """Rules of every person, more than are tried one by one: found by the letters that they need."""
    e, u = table(spark, d, "events"), F.col("user_id")
    rule = lambda where, pattern, folder, weight: e.where(where).select(pattern.alias("regex_pattern"), folder.cast("int").alias("folder_id"), weight.cast("int").alias("weight"))
    rules_ = rule("true", F.concat(F.lit("_U"), u.cast("string"), F.lit("_E([0-9]+)")), u % 50, u % 7)
    rules_ = rules_.union(rule("user_id % 10 = 3", F.concat("event_type", F.lit("_U[0-9]*"), (u % 100).cast("string"), F.lit("_")), F.lit(60), F.lit(3)))
    rules_ = rules_.union(rule("user_id % 11 = 0", F.concat(F.lit("^.{"), (9 + u % 9).cast("string"), F.lit("}[13579]_E")), F.lit(61), u % 9 - 6))
    noms = e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("_U"), u.cast("string"), F.lit("_E"), (F.col("event_id") % 30).cast("string")).alias("nom"))
    return routing.first_match(noms, cut(rules_.groupBy("regex_pattern").agg(F.max("folder_id").alias("folder_id"), F.max("weight").alias("weight"))))


@query("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%#_3%'")
def catalog_search_like(spark, d):
    return catalog.like(table(spark, d, "part"), "p_brand", "#_3").select("p_partkey", "p_brand")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_custkey = (SELECT min(o_custkey) FROM orders WHERE o_orderstatus = 'F') ORDER BY o_orderkey LIMIT 1")
def catalog_point_lookup(spark, d):
    orders = table(spark, d, "orders")
    first = orders.where("o_orderstatus = 'F'").agg(F.min("o_custkey").alias("c")).first().c
    return catalog.lookup(orders, "o_orderkey", o_orderstatus="F", o_custkey=first).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT p_partkey, path, number_cut, weight, CASE WHEN coalesce(path = '', true) THEN 'path empty' WHEN number_cut < 1 THEN 'number_cut below 1' WHEN weight < 1 THEN 'weight below 1' END AS reason
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS path, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size - 2 END, 5) AS number_cut, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_size - 1 END, 1) AS weight FROM part)""")
def catalog_validate_defaults(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k, F.when(k % 7 != 0, F.col("p_name")).alias("path"), F.when(k % 5 != 0, F.col("p_size") - 2).alias("number_cut"), F.when(k % 3 == 0, F.col("p_size") - 1).alias("weight"))
    return catalog.validated(rows, {"number_cut": 5, "weight": 1}, {"number_cut": 1, "weight": 1}, ["path"]).drop("is_valid")


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return catalog.upsert(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), ["user_id", "event_type"], "event_id")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, p_brand, true AS found FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey")
def track_triple_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return tracks.triple_join(lines, orders, parts, "l_orderkey", "l_partkey").where("found").select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "found")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def props_json_project(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT doc_id, coalesce(m.code, nullif(split_part(d.lang, '-', 1), ''), 'und') AS language FROM documents d LEFT JOIN (VALUES ('en', 'eng'), ('de', 'ger')) m(lang, code) USING (lang)")
def lang_normalize(spark, d):
    known = spark.createDataFrame([("en", "eng"), ("de", "ger")], "lang string, code string")
    return table(spark, d, "documents").join(F.broadcast(known), "lang", "left").select("doc_id", scalars.normal_language(F.col("lang"), F.col("code")).alias("language"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'commentary') OR p_size = 1 THEN 'commentary' WHEN p_size = 2 THEN 'audiodesc' ELSE 'main' END AS audio_role,
CASE WHEN regexp_matches(lower(p_type), 'forced|forcé') THEN 'forced' WHEN contains(lower(p_type), 'sdh') OR p_size = 3 THEN 'hearing' WHEN contains(lower(p_type), 'dubtitle') THEN 'dubtitle' ELSE 'plain' END AS subtitle_role FROM part""")
def role_classify(spark, d):
    return table(spark, d, "part").select("p_partkey", tracks.audio_role(F.col("p_name"), F.col("p_size") == 1, F.col("p_size") == 2).alias("audio_role"), tracks.subtitle_role(F.col("p_type"), F.col("p_size") == 3).alias("subtitle_role"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(lower(url), 'https?://', ''), '^\s+|\s+$', '', 'g') AS title FROM pages")
def title_clean(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.clean_title(F.col("url"), "https?://").alias("title"))


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('de', 'fr') OR lang = 'fr' AND source = 'src1'")
def language_filter_except(spark, d):
    drop = spark.createDataFrame([("de",), ("fr",)], "lang string")
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    original = docs.where("lang = 'fr' and source = 'src1'")
    return docs.join(F.broadcast(drop), "lang", "left_anti").unionByName(original).select("doc_id", "lang")


@query("SELECT lang, count(DISTINCT source) AS groups FROM documents GROUP BY lang HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents)")
def common_languages_intersect(spark, d):
    return tracks.common(table(spark, d, "documents"), "source", "lang")


@query("SELECT lang, count(DISTINCT source) AS groups FROM documents GROUP BY lang ORDER BY groups DESC, lang LIMIT 1")
def most_common_language(spark, d):
    return tracks.most_common(table(spark, d, "documents"), "source", "lang")


@query("SELECT doc_id, text = '' OR doc_id = min(doc_id) OVER (PARTITION BY text) AS keep FROM documents")
def md5_dedupe_keep_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("text") != "", F.md5("text")).alias("h"))
    return tracks.keep_first(docs, F.col("h"), "doc_id").select("doc_id", "keep")


@query("""SELECT conv_id, turn, md5(nullif(array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_full_match(x, '[0-9]+') AND NOT contains(x, '-->')), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), chr(10)), '')) AS text_md5 FROM conversations""")
def text_hash_normalized(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(scalars.subtitle_text(F.col("text"))).alias("text_md5"))


@query("""WITH own AS (SELECT conv_id, array_to_string(list_sort(list(DISTINCT md5(role))), '') AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(s) AS signature, min(conv_id) OVER (PARTITION BY s) AS representative, count(*) OVER (PARTITION BY s) AS members FROM own""")
def md5_signature_groups(spark, d):
    return tracks.signatures(table(spark, d, "conversations"), "conv_id", F.md5("role"))


@query("SELECT doc_id, source, CASE WHEN n = 0 THEN source ELSE source || '_' || n END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents)")
def collision_suffix(spark, d):
    return routing.collision_names(table(spark, d, "documents").select("doc_id", "source"), "source", "doc_id")


@query("""SELECT conv_id, turn, kind FROM (SELECT *, max(CASE WHEN kind = 'ass' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
FROM (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN 'ass' ELSE 'srt' END AS kind FROM conversations)) WHERE CASE WHEN s = 1 THEN kind = 'ass' ELSE rn = 1 END""")
def group_keep_srt_ass(spark, d):
    subs = table(spark, d, "conversations").select("conv_id", "turn", F.when(F.length("text") % 5 == 0, "ass").otherwise("srt").alias("kind"))
    return tracks.text_over_picture(subs, ["conv_id"], "kind", "turn")


@query("SELECT a.l_orderkey, a.l_linenumber AS i, b.l_linenumber AS j, a.l_quantity AS l_quantity_i, b.l_quantity AS l_quantity_j FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber")
def triangular_pairs(spark, d):
    return tracks.pairs(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity"])


WORDS_SQL = "words AS (SELECT vec_id, label, list_transform(range(0, 2), lambda w: list_sum(list_transform(range(0, 32), lambda b: CASE WHEN embedding[w * 32 + b + 1] > 0 THEN CAST(1 AS BIGINT) << b ELSE 0 END))::BIGINT) AS x FROM embeddings)"


def words(spark: SparkSession, d: str) -> DataFrame:
    """The signs of each vector as two words of 32 bits."""
    x = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, b: s + F.when(F.element_at("embedding", w * 32 + b + 1) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    return table(spark, d, "embeddings").select("vec_id", "label", x.alias("x"))


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each vector's words with those of the next id."""
    w = cut(words(spark, d))
    return w.select("vec_id", "x").join(w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


@query(f"WITH {WORDS_SQL} SELECT a.vec_id, round(list_sum(list_transform([1, 2], lambda i: 32 - bit_count(xor(a.x[i], b.x[i])))) / 2.0 / 32, 9) AS fidelity FROM words a JOIN words b ON b.vec_id = a.vec_id + 1")
def hamming_similarity(spark, d):
    return delays.fidelity(neighbours(spark, d)).select("vec_id", F.round("fidelity", 9).alias("fidelity"))


SERIES_SQL = "series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id * 2654435761 % 4294967296 AS word FROM events)"


def series(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as a fingerprint: key, n (from 1), word."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id")
    return numbered(rows, ["key"], "event_id", "n").select("key", "n", (F.col("event_id") * 2654435761 % 4294967296).alias("word"))


@query(f"""WITH {SERIES_SQL}, o AS (SELECT unnest(range(-4, 5)) AS "offset"),
sums AS (SELECT a.user_id AS key, "offset", count(*) AS overlap, sum(32 - bit_count(xor(a.word, b.word))) AS same FROM o, series a JOIN series b ON b.user_id = a.user_id + 1 AND b.n = a.n - "offset" GROUP BY ALL)
SELECT key, round(same / overlap::DOUBLE / 32, 9) AS corr, CAST("offset" AS INTEGER) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY same / overlap::DOUBLE DESC, "offset") AS rn FROM sums WHERE overlap >= 4) WHERE rn = 1""")
def cross_correlation_curve(spark, d):
    s = cut(series(spark, d))
    follower = s.select((F.col("key") - 1).alias("key"), "n", "word")
    return delays.best_offset(delays.curve_by_word(s, follower, 4, 4), ["key"]).select("key", F.round("corr", 9).alias("corr"), "offset")


@query(f"""WITH {SERIES_SQL}, n AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id),
o AS (SELECT a.user_id, unnest(range(32 - least(a.n, b.n), least(a.n, b.n) - 31)) AS "offset" FROM n a JOIN n b ON b.user_id = a.user_id + 1),
sums AS (SELECT a.user_id AS key, "offset", count(*) AS overlap, sum(32 - bit_count(xor(a.word, b.word))) AS same FROM o JOIN series a USING (user_id) JOIN series b ON b.user_id = a.user_id + 1 AND b.n = a.n - "offset" GROUP BY ALL)
SELECT key, round(same / overlap::DOUBLE / 32, 9) AS corr, CAST("offset" AS INTEGER) AS "offset" FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY same / overlap::DOUBLE DESC, "offset") AS rn FROM sums WHERE overlap >= 32) WHERE rn = 1""")
def whole_span_correlation(spark, d):
    """Each user's events with the next user's, at every offset that lets 32 words overlap; blocks of 32 words, so that several meet."""
    s = cut(series(spark, d))
    left = correlation.blocks(s, "word", 32)
    right = correlation.blocks(s.withColumn("key", F.col("key") - 1), "word", 32)
    return correlation.similarity(left, right, delays.LEAST_OVERLAP, 32).withColumn("corr", F.round("corr", 9))


@query("""WITH n AS (SELECT label AS key, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) > 20)
SELECT key, CASE WHEN key % 3 = 0 THEN 'full' ELSE 'blocks' END AS strategy, CAST(CASE WHEN key % 3 = 0 THEN 37 ELSE (key % 7 - 3) * 97 END AS BIGINT) AS lag FROM n""")
def long_lags(spark, d):
    """Each label's vectors as one signal and the same from another sample on; every third label has only two vectors, which
    fit into one transform. Blocks of 256 samples on both sides."""
    rows = table(spark, d, "embeddings").where("label is not null").select(F.col("label").alias("key"), "vec_id", "embedding")
    some = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 20").select("key")
    v = numbered(rows.join(some, "key", "left_semi"), ["key"], "vec_id", "v").where("key % 3 > 0 or v <= 2")
    samples = cut(v.select("key", "v", F.posexplode("embedding").alias("p", "value")).select("key", ((F.col("v") - 1) * 64 + F.col("p") + 1).alias("n"), "value"))
    by = F.when(F.col("key") % 3 == 0, 37).otherwise((F.col("key") % 7 - 3) * 97)
    cut_off = lambda sign: samples.withColumn("n", F.col("n") - F.greatest(F.lit(0), sign * by)).where("n > 0")
    return correlation.chosen_lag(correlation.blocks(cut_off(-1), "value", 256), correlation.blocks(cut_off(1), "value", 256), 18.0 * 512, 256)


def sounded(spark: SparkSession, d: str, tear: Column | None) -> tuple[DataFrame, DataFrame]:
    """Each label's vectors as a recording of 64 samples a second, and the same again, starting later by some five words of its
    fingerprint and by the tear (not again without one): (match, c, its seconds) and samples."""
    rows = table(spark, d, "embeddings").where("label is not null").select(F.col("label").cast("long").alias("match"), "vec_id", "embedding")
    some = rows.groupBy("match").agg(F.count("*").alias("c")).where("c >= 45")
    v = numbered(rows.join(some, "match", "left_semi"), ["match"], "vec_id", "v")
    one = v.select("match", "v", F.posexplode("embedding").alias("p", "value")).select("match", F.lit(1).alias("side"), ((F.col("v") - 1) * 64 + F.col("p")).alias("n"), F.col("value").cast("double").alias("value"))
    one = one.join(F.broadcast(some), "match") if some.limit(4096).count() < 4096 else one.join(some, "match")
    if tear is not None:
        one = one.unionByName(one.withColumns({"n": F.col("n") + F.col("match") % 5 * 40 + tear, "side": F.lit(2)}))
    return some, cut(one.drop("c").withColumn("track", F.lit("a")))


def words_of(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Words of the signs of 32 samples (n, value), one begun every 8 samples."""
    octets = samples.groupBy(*keys, F.floor(F.col("n") / 8).alias("q")).agg(F.sum(F.when(F.col("value") > 0, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("n") % 8).cast("int"))).otherwise(0)).alias("o"))
    # pieces of 512 octets, with the three that follow them
    dealt = octets.withColumns({"_at": F.floor(F.col("q") / 512), "_own": F.lit(True)})
    dealt = dealt.unionByName(dealt.where("pmod(q, 512) < 3").withColumns({"_at": F.col("_at") - 1, "_own": F.lit(False)}))
    w = Window.partitionBy(*keys, "_at").orderBy("q")
    value = sum((F.call_function("shiftleft", F.lead("o", k).over(w), F.lit(8 * k)) for k in (1, 2, 3)), F.col("o"))
    words = dealt.withColumns({"value": value, "_last": F.lead("q", 3).over(w)})
    return words.where("_own and _last = q + 3 and q >= 0").select(*keys, F.col("q").alias("n"), "value")


def recorded(spark: SparkSession, d: str) -> measuring.Tracks:
    """Recordings of which every fourth one is torn in the middle. A word holds the signs of 32 samples and begins 8 after the
    one before."""
    some, samples = sounded(spark, d, F.when((F.col("match") % 4 == 3) & (F.col("n") >= 22 * 64), 16).otherwise(0))
    words_ = words_of(samples, ["match", "side", "track"])
    grid = some.select("match", F.posexplode(F.array(*(F.lit(float(x)) for x in (5, 14, 23, 32)))).alias("segment", "begin_s"), F.lit(8.0).alias("length_s")).withColumn("segment", F.col("segment").cast("long"))
    return measuring.Tracks(cut(words_), samples, cut(grid), 8.0, 64.0)


@query("""SELECT match, CASE WHEN match % 4 <> 3 THEN match % 5 * 625 END AS delay_ms, CASE WHEN match % 4 <> 3 THEN match % 5 * 625 END::DOUBLE AS total_ms, CASE WHEN match % 4 = 3 THEN 'no delay' END AS reason
FROM (SELECT label::BIGINT AS match FROM embeddings WHERE label IS NOT NULL GROUP BY label HAVING count(*) >= 45)""")
def measured_delays(spark, d):
    """Fingerprints and samples in, delays and reasons out: no measurement is handed in."""
    return measuring.decided(measuring.reached(recorded(spark, d)))


def shifted_signals(spark: SparkSession, d: str) -> DataFrame:
    """Each vector, and itself without its first vec_id mod 16 samples: the lag to find."""
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"), F.expr("slice(embedding, cast(vec_id % 16 as int) + 1, 64)").alias("y"))


@query("SELECT vec_id, CAST(1 AS BIGINT) AS file, (vec_id % 16)::DOUBLE AS seconds FROM embeddings")
def fft_correlate(spark, d):
    found = shifted_signals(spark, d).select("vec_id", signals.fft_peak("x", "y").alias("p"))
    file, seconds = signals.lag(F.col("p"), 1)
    return found.select("vec_id", file.alias("file"), seconds.cast("double").alias("seconds"))


@query("SELECT vec_id, CAST(1 AS BIGINT) AS file, (vec_id % 16)::DOUBLE AS seconds FROM embeddings")
def overlap_save(spark, d):
    found = shifted_signals(spark, d).select("vec_id", signals.block_peak("x", "y").alias("p"))
    file, seconds = signals.lag(F.col("p"), 1)
    return found.select("vec_id", file.alias("file"), seconds.cast("double").alias("seconds"))


@query()
def phash64(spark, d):
    frame = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: F.lpad(F.hex(F.floor((F.element_at("embedding", (i % 64 + 1).cast("int")) + 1) * 127 + i % 7).cast("long") % 256), 2, "0")), ""))
    return table(spark, d, "embeddings").select("vec_id", signals.frame_hash(frame).alias("hash"))


@query(f"""WITH {WORDS_SQL}, frames AS (SELECT label AS clip, vec_id AS frame, x FROM words),
near AS (SELECT a.clip, a.frame AS i, b.frame AS j, CAST(bit_count(xor(a.x[1], b.x[1])) + bit_count(xor(a.x[2], b.x[2])) AS BIGINT) AS d FROM frames a JOIN frames b ON a.clip = b.clip AND b.frame BETWEEN a.frame - 20 AND a.frame + 20 AND a.frame <> b.frame),
best AS (SELECT clip, i, j, d FROM (SELECT *, row_number() OVER (PARTITION BY clip, i ORDER BY d, j) AS rn FROM near) WHERE rn = 1)
SELECT clip, i, j, d, CAST(sum(d) OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM best""")
def banded_alignment(spark, d):
    return cuts.trailing_sum(aligned(spark, d), 3)


def aligned(spark: SparkSession, d: str) -> DataFrame:
    """Each label's vectors as a clip of 64-bit frame hashes, set against itself."""
    hash_ = F.element_at("x", 1).bitwiseOR(F.shiftleft(F.element_at("x", 2), 32))
    frames = cut(words(spark, d)).select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), hash_.alias("hash"))
    return cut(cuts.banded_nearest(frames, frames, 20, own=False))


@query("""WITH t AS (SELECT o_orderkey, o_totalprice / 100 AS s FROM orders)
SELECT o_orderkey, CAST(CASE WHEN s > 540 THEN 120 WHEN s > 60 THEN 30 WHEN s > 5 THEN 0 END AS BIGINT) AS begin_s,
CAST(trunc(CASE WHEN s > 540 THEN (s - 240) / 11 WHEN s > 60 THEN (s - 45) / 11 WHEN s > 5 THEN s - 2 / 11 END) AS BIGINT) AS length_s,
printf('%02d:%02d:%02d.%03d', (CAST(floor(s * 1000) AS BIGINT) % 86400000) // 3600000, (CAST(floor(s * 1000) AS BIGINT) % 86400000) // 60000 % 60, (CAST(floor(s * 1000) AS BIGINT) % 86400000) // 1000 % 60, CAST(floor(s * 1000) AS BIGINT) % 1000) AS clock FROM t""")
def segment_grid(spark, d):
    s = F.col("o_totalprice") / 100
    return table(spark, d, "orders").select("o_orderkey", scalars.grid_begin(s).alias("begin_s"), scalars.grid_length(s, 10).alias("length_s"), scalars.clock(s).alias("clock"))


@query("SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN round_even(value / (1000 / 25.0::DOUBLE), 0) * (1000 / 25.0::DOUBLE) ELSE value END, 6) AS delay_ms FROM events")
def frame_quantize(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.frame_aligned(F.col("value"), F.lit(25.0), F.col("event_id") % 2 == 0), 6).alias("delay_ms"))


MEASURED_SQL = """measured AS (SELECT user_id AS pair, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS segment, 0.6 + (event_id % 41) / 100.0::DOUBLE AS fidelity,
CAST(CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN event_id % 2 * 125 WHEN 2 THEN event_id % 7 // 6 * 125 ELSE event_id % 3 * 400 END AS BIGINT) AS delay_ms FROM events),
marked AS (SELECT *, lag(delay_ms) OVER w AS last, min(fidelity) OVER (PARTITION BY pair ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS worst, first(delay_ms) OVER w AS head1 FROM measured WINDOW w AS (PARTITION BY pair ORDER BY segment)),
changed AS (SELECT *, CASE WHEN delay_ms <> last THEN 1 ELSE 0 END AS changed, coalesce(least(fidelity, worst) < 0.9, false) AS weak FROM marked),
runs AS (SELECT *, sum(changed) OVER (PARTITION BY pair ORDER BY segment) AS run FROM changed),
longest AS (SELECT pair, d AS majority FROM (SELECT pair, run, min(delay_ms) AS d, row_number() OVER (PARTITION BY pair ORDER BY count(*) DESC, run) AS rn FROM runs GROUP BY pair, run) WHERE rn = 1),
sums AS (SELECT pair, count(DISTINCT delay_ms) AS n_delays, min(delay_ms) AS low, max(delay_ms) AS high, avg(fidelity) AS mean, arg_min(delay_ms, segment) AS head, arg_max(delay_ms, segment) AS tail,
avg(CASE WHEN delay_ms <> head1 OR fidelity < 0.85 THEN 1.0 ELSE 0.0 END) AS bad, CAST(sum(CASE WHEN changed = 1 AND weak THEN 1 ELSE 0 END) AS BIGINT) AS changes, max(CASE WHEN fidelity > 0.9 THEN 1 ELSE 0 END) AS good1, max(CASE WHEN fidelity < 0.75 THEN 1 ELSE 0 END) AS bad1 FROM runs GROUP BY pair)"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    delay = F.when(u % 4 == 0, F.lit(0)).when(u % 4 == 1, e % 2 * 125).when(u % 4 == 2, F.floor(e % 7 / 6) * 125).otherwise(e % 3 * 400).cast("long")
    rows = numbered(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "segment")
    return cut(rows.select(u.alias("pair"), F.col("segment").cast("int").alias("segment"), (F.lit(0.6) + (e % 41) / 100.0).alias("fidelity"), delay.alias("delay_ms")))


@query(f"""WITH {MEASURED_SQL} SELECT pair, n_delays AS "distinct", round(mean, 9) AS mean_fidelity, round(bad, 9) AS bad_share,
CASE WHEN n_delays = 1 OR near AND head = tail AND bad <= 0.25 THEN 'accept' WHEN near THEN 'adjust' ELSE 'ignore' END AS verdict,
CAST(CASE WHEN n_delays = 1 OR near AND head = tail AND bad <= 0.25 THEN head WHEN near THEN low + round_even((high - low) / 2, 0) END AS BIGINT) AS delay_ms FROM (SELECT *, n_delays = 2 AND high - low < 127 AND mean >= 0.7 AS near FROM sums)""")
def delay_decision_stage1(spark, d):
    return delays.stage_one(measured(spark, d)).withColumns({"mean_fidelity": F.round("mean_fidelity", 9), "bad_share": F.round("bad_share", 9)})


@query(f"""WITH {MEASURED_SQL} SELECT pair, n_delays AS "distinct", round(mean, 9) AS mean_fidelity, changes, majority,
CASE WHEN one THEN 'accept' WHEN torn THEN 'incompatible' WHEN near OR still THEN 'accept' ELSE 'incompatible' END AS verdict, CASE WHEN one THEN head WHEN torn THEN NULL WHEN near THEN majority WHEN still THEN 0 END AS delay_ms
FROM (SELECT *, n_delays = 1 OR near AND head = tail AS one, near AND changes > 1 AND good1 = 1 AND bad1 = 1 AS torn, n_delays = 2 AND high - low < 128 AND mean >= 0.75 AND (low = 0 OR high = 0) AS still FROM (SELECT *, n_delays = 2 AND high - low < 128 AND mean >= 0.9 AS near FROM sums JOIN longest USING (pair)))""")
def delay_decision_check(spark, d):
    return delays.stage_check(measured(spark, d)).drop("low", "high").withColumn("mean_fidelity", F.round("mean_fidelity", 9))


@query("""WITH s AS (SELECT user_id AS pair, count(*) AS n, var_samp(delay_s) AS spread, arg_min(delay_s, event_id) AS head, arg_max(delay_s, event_id) AS tail, avg(delay_s) AS mean_s
FROM (SELECT user_id, event_id, event_id % 11 / 100.0::DOUBLE * (user_id % 3) AS delay_s FROM events) GROUP BY user_id)
SELECT pair, n, CASE WHEN n = 1 OR spread < 0.004 THEN 'all' WHEN abs(head - tail) < 0.004 THEN 'ends' ELSE 'fail' END AS verdict, round(CASE WHEN n = 1 OR spread < 0.004 THEN mean_s WHEN abs(head - tail) < 0.004 THEN (head + tail) / 2 END, 9) AS delay_s FROM s""")
def delay_decision_stage2(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("pair"), F.col("event_id").alias("segment"), ((F.col("event_id") % 11) / 100.0 * (F.col("user_id") % 3)).alias("delay_s"))
    return delays.stage_two(rows).withColumn("delay_s", F.round("delay_s", 9))


@query(f"WITH {MEASURED_SQL} SELECT pair, delay_ms, count(*) AS segments, round(avg(fidelity), 9) AS mean_fidelity FROM measured GROUP BY pair, delay_ms")
def fidelity_matrix(spark, d):
    return measured(spark, d).groupBy("pair", "delay_ms").agg(F.count("*").alias("segments"), F.round(F.avg("fidelity"), 9).alias("mean_fidelity"))


@query("""WITH rows AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS segment, 0.8 + (event_id % 21) / 100.0::DOUBLE AS fidelity, CASE WHEN event_id % 17 = 0 THEN 2 ELSE 1 END AS offsets FROM events),
lim AS (SELECT user_id, least(greatest(avg(fidelity) - 0.75 * (max(fidelity) - min(fidelity)), 0.85), 0.95) AS lim, min(segment) AS lo, max(segment) AS hi FROM rows GROUP BY user_id),
marked AS (SELECT *, fidelity < lim OR offsets > 1 AS bad FROM rows JOIN lim USING (user_id)), islands AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY segment) AS island FROM marked)
SELECT user_id, greatest(min(segment) - 1, min(lo)) AS "begin", least(max(segment) + 1, max(hi)) AS "end", count(*) AS segments FROM islands WHERE bad GROUP BY user_id, island""")
def bad_ranges(spark, d):
    rows = numbered(table(spark, d, "events").select("user_id", "event_id"), ["user_id"], "event_id", "segment")
    rows = rows.select("user_id", F.col("segment").cast("long").alias("segment"), (F.lit(0.8) + (F.col("event_id") % 21) / 100.0).alias("fidelity"), F.when(F.col("event_id") % 17 == 0, 2).otherwise(1).alias("offsets"))
    return cuts.bad_ranges(cut(rows), "user_id")


@query("""WITH s AS (SELECT user_id, event_id::DOUBLE / 1000 AS x, value AS y FROM events),
g AS (SELECT user_id, coalesce(regr_slope(y, x), 0) AS slope, coalesce(regr_intercept(y, x), avg(y)) AS intercept FROM s GROUP BY user_id),
m AS (SELECT user_id, any_value(slope) AS slope, any_value(intercept) AS intercept, avg((y - slope * x - intercept) ** 2) AS mse FROM s JOIN g USING (user_id) GROUP BY user_id)
SELECT user_id, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(mse, 4) AS mse, round(CASE WHEN abs(slope) > 0.005 AND mse <= 0.12 THEN 1 / (1 + slope) ELSE 1.0 END, 4) AS tempo FROM m""")
def drift_regression(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_id").cast("double") / 1000).alias("x"), F.col("value").alias("y"))
    return cuts.drift(rows, "user_id", "x", "y").select("user_id", *(F.round(c, 4).alias(c) for c in ("slope", "intercept", "mse", "tempo")))


RULE_TEXT = "FLAC*1.1>AC3*2>MP3,DTS=EAC3>AAC"


# further rule strings: equal formats that a chain orders, chains that meet, a factor over five, both directions, white space
RULE_TEXTS = [RULE_TEXT, "a=b,a>c>b", "x>y,y>z*6>w", "m>n,n*5>o,n*6>p", "a*1.1>b,b*1>a", " Opus * 1.5 > Vorbis = MP3 "]


@query("""SELECT * FROM (VALUES (0, 'ac3', 'mp3', false, 2.0::DOUBLE), (0, 'dts', 'aac', true, NULL), (0, 'eac3', 'aac', true, NULL), (0, 'flac', 'ac3', false, 1.1), (0, 'flac', 'mp3', false, 2.2), (1, 'a', 'c', true, NULL), (1, 'c', 'b', true, NULL),
(2, 'x', 'y', true, NULL), (2, 'y', 'z', true, NULL), (2, 'x', 'z', true, NULL), (2, 'z', 'w', false, 6.0), (2, 'x', 'w', true, NULL), (2, 'y', 'w', true, NULL), (3, 'm', 'n', true, NULL), (3, 'n', 'o', false, 5.0), (3, 'n', 'p', false, 6.0), (3, 'm', 'p', true, NULL),
(4, 'a', 'b', false, 1.1), (4, 'b', 'a', false, 1.0), (5, 'opus', 'vorbis', false, 1.5), (5, 'opus', 'mp3', false, 1.5)) t(text, winner, loser, unconditional, factor)""")
def rules_relation(spark, d):
    out = None
    for i, text in enumerate(RULE_TEXTS):
        one = rules.relation(spark, text).select(F.lit(i).alias("text"), "*")
        out = one if out is None else out.union(one)
    return out.withColumn("factor", F.round("factor", 9))


@query("""WITH l AS (SELECT conv_id AS key, turn AS n, 't' || turn AS f, CASE WHEN length(text) % 3 > 0 THEN length(text) % 3 * 0.75 END::DOUBLE AS by FROM conversations),
p AS (SELECT a.key, a.f AS winner, b.f AS loser, bool_or(c.by IS NULL) AS unconditional, product(c.by) AS product FROM l a JOIN l b ON a.key = b.key AND a.n < b.n JOIN l c ON c.key = a.key AND c.n >= a.n AND c.n < b.n GROUP BY ALL)
SELECT key, winner, loser, unconditional, round(CASE WHEN NOT unconditional THEN product END, 9) AS factor FROM p""")
def rules_of_turns(spark, d):
    """The turns of each conversation as a chain of formats, some with a factor, some without."""
    q = F.length("text") % 3
    level = F.concat(F.lit("t"), F.col("turn").cast("string"), F.when(q > 0, F.concat(F.lit("*"), (q * 0.75).cast("string"))).otherwise(""))
    chain = F.transform(F.array_sort(F.collect_list(F.struct("turn", level.alias("level")))), lambda x: x["level"])
    texts = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("key")).agg(F.array_join(chain, ">").alias("text"))
    return rules.relations(texts).withColumn("factor", F.round("factor", 9))


# which of two tracks goes, for all pairs of a group in order; then sequential elimination over them, as bits of one number
FACTORS_SQL = "f(strong, weak, factor) AS (VALUES ('flac', 'ac3', 1.1::DOUBLE), ('ac3', 'mp3', 2.0), ('flac', 'mp3', 1.1::DOUBLE * 2.0))"
SOUNDS_SQL = "l_orderkey, l_linenumber, ['flac', 'ac3', 'mp3', 'dts'][l_partkey % 4 + 1] AS format, (l_suppkey % 3 + 1)::DOUBLE AS channels, 48000 AS rate, l_extendedprice AS bitrate"
BEATEN_SQL = f"""{FACTORS_SQL}, l AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY place, format, channels, bitrate) - 1 AS n FROM sounds),
p AS (SELECT a.one, a.n AS i, b.n AS j, CASE WHEN a.format = b.format AND a.channels = b.channels THEN CASE WHEN a.bitrate >= b.bitrate THEN b.n ELSE a.n END
  WHEN a.format = b.format AND a.channels > b.channels THEN CASE WHEN a.bitrate / a.channels > 0.9::DOUBLE * b.bitrate / b.channels THEN b.n END
  WHEN a.format = b.format THEN CASE WHEN b.bitrate / b.channels > 0.9::DOUBLE * a.bitrate / a.channels THEN a.n END
  WHEN a.channels >= b.channels AND a.bitrate > b.bitrate * x.factor THEN b.n WHEN b.channels >= a.channels AND b.bitrate > a.bitrate * y.factor THEN a.n END AS loser
  FROM l a JOIN l b ON a.one = b.one AND a.n < b.n LEFT JOIN f x ON x.strong = a.format AND x.weak = b.format LEFT JOIN f y ON y.strong = b.format AND y.weak = a.format),
m AS (SELECT one, list_reduce(list_prepend((1::BIGINT << 31) - 1, list(i + 64 * j + 4096 * loser ORDER BY i, j)), lambda m, c: CASE WHEN (m >> (c % 64)) & (m >> (c // 64 % 64)) & 1 = 1 THEN m - (1::BIGINT << (c // 4096)) ELSE m END) AS mask FROM p WHERE loser IS NOT NULL GROUP BY one),
k AS (SELECT l.*, coalesce((mask >> n) & 1 = 1, true) AS keep FROM l LEFT JOIN m ON m.one = l.one)"""


@query(f"WITH sounds AS (SELECT {SOUNDS_SQL}, l_orderkey AS one, l_linenumber AS place FROM lineitem), {BEATEN_SQL} SELECT l_orderkey, l_linenumber, format, channels, rate, bitrate, keep FROM k")
def audio_dominance(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(F.array(*map(F.lit, ("flac", "ac3", "mp3", "dts"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("format"), (F.col("l_suppkey") % 3 + 1).cast("double").alias("channels"), F.lit(48000).alias("rate"), F.col("l_extendedprice").alias("bitrate"))
    return selection.dominant(lines, "l_orderkey", "l_linenumber", RULE_TEXT)


@query("""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 0 WHEN length(text) % 3 = 0 THEN 1 WHEN length(text) % 3 = 1 THEN 2 ELSE 3 END AS stage FROM conversations),
c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(count(*) OVER (PARTITION BY conv_id ORDER BY stage RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t)
SELECT conv_id, turn, stage FROM c WHERE stage = 3 OR n - b <= 4""")
def budget_prune(spark, d):
    n = F.length("text") % 3
    rows = tracks.in_stages(table(spark, d, "conversations"), "conv_id", [F.col("role") == "system", n == 0, n == 1], 4)
    return rows.select("conv_id", "turn", "stage")


EDGES_SQL = "edges AS (SELECT lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS winner, o_orderkey AS loser, o_orderkey % 100 AS delay FROM orders)"


@query(f"""WITH RECURSIVE {EDGES_SQL}, walk AS (SELECT loser AS node, loser AS root, CAST(0 AS BIGINT) AS delay FROM edges WHERE winner IS NULL UNION ALL SELECT e.loser, w.root, w.delay + e.delay FROM walk w JOIN edges e ON e.winner = w.node)
SELECT node, root, delay FROM walk WHERE node IN (SELECT loser FROM edges WHERE winner IS NOT NULL UNION ALL SELECT winner FROM edges WHERE winner IS NOT NULL)""")
def winner_tree_delays(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    edges = table(spark, d, "orders").select(F.lag("o_orderkey").over(w).alias("winner"), F.col("o_orderkey").alias("loser"), (F.col("o_orderkey") % 100).alias("delay"))
    return tracks.tree_delays(cut(edges.where("winner is not null")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag || '_' || l_linestatus, l_linenumber) AS place FROM lineitem")
def output_track_order(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return tracks.output_order(lines, "l_orderkey", F.concat_ws("_", "l_returnflag", "l_linestatus"), "l_linenumber").select("l_orderkey", "l_linenumber", "place")


@query("SELECT l_orderkey AS pair, avg(l_extendedprice) >= avg(l_quantity * 1000) AS a_wins, round(avg(l_extendedprice), 6) AS mean_a, round(avg(l_quantity * 1000), 6) AS mean_b FROM lineitem GROUP BY l_orderkey")
def better_video(spark, d):
    scores = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_extendedprice").alias("score_a"), (F.col("l_quantity") * 1000).alias("score_b"))
    return selection.better_video(scores).withColumns({"mean_a": F.round("mean_a", 6), "mean_b": F.round("mean_b", 6)})
