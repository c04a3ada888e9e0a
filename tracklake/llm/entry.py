"""Queries of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklake.llm import ann, bpe, codes, exact_dedup, langid, lexical, media, near_dedup, packing, pii, resample, suffix_dedup, url_rules

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    bad = (F.col("quality").eqNullSafe(0) | F.col("toxic").eqNullSafe(1)).alias("bad")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad).groupBy("page_id").agg(F.max("bad").alias("bad"))
    return url_rules.judge(pages, pages.select("page_id", "url").join(labels, "page_id"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), WORDS)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.fit(pii.labelled(spark)))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), RANKS)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.summary(table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


EVERY = (op1_url_rules, op2_packing, op3_pii, op4_bpe, op5_suffix_dedup, op6_media, op7_ann, op8_language, op9_near_dedup, op10_resample, op11_lexical_search, op12_vector_codes, op13_exact_dedup)
QUERIES = {f.__name__: f for f in EVERY}


def _codes_sql() -> str:
    """Six rounds as chained CTEs: a (part, nearest entry) of the vectors under codebook c, then the next codebook."""
    gap = "list_sum(list_transform(list_zip(p.x, c.y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = "a{0} AS MATERIALIZED (SELECT r, part, x, arg_min(c.entry, {1} * 16 + c.entry) AS entry, min({1})::BIGINT AS gap FROM p JOIN c{0} c USING (part) GROUP BY r, part, x)"
    new = """s{0} AS (SELECT part, entry, pos, sum(v)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM a{0}) GROUP BY ALL),
m{0} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS y FROM s{0} GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT part, entry, coalesce(m.y, c.y) AS y FROM c{0} c LEFT JOIN m{0} m USING (part, entry))"""
    steps = [near.format(i, gap) + ",\n" + new.format(i, i + 1) for i in range(6)]
    return f"""WITH k AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, list_transform(embedding, lambda v: floor(4096 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM k, range(8) AS t(part)),
c0 AS MATERIALIZED (SELECT part, r AS entry, x AS y FROM p WHERE r < 16),
{", ".join(steps)},
{near.format(6, gap)},
h AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS h FROM c6),
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(gap)::BIGINT AS error FROM a6 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM e JOIN k USING (r), h"""


ORACLE = {
    "op11_lexical_search": r"""WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS l FROM n),
w AS (SELECT t, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY t, nn),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l))))::BIGINT AS score FROM q JOIN f USING (t) JOIN w USING (t) JOIN n USING (doc_id), s GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 20""",
    "op12_vector_codes": _codes_sql(),
    "op9_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS c FROM r GROUP BY node) c USING (doc_id)""",
    "op5_suffix_dedup": r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
h AS (SELECT doc_id, hex(b) AS h, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM h)),
f AS (SELECT w, min(doc_id) AS m FROM w GROUP BY w),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN f USING (w) WHERE doc_id > m),
r AS (SELECT doc_id, min(i) AS s, max(i) + 50 AS e FROM (SELECT *, sum(CASE WHEN i <= p + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM g) GROUP BY doc_id, g),
k AS (SELECT doc_id, substr(h, 2 * coalesce(lag(e) OVER o, 0) + 1, 2 * (s - coalesce(lag(e) OVER o, 0))) AS before, s, e FROM r JOIN h USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
j AS (SELECT doc_id, string_agg(before, '' ORDER BY s) AS head, max(e) AS e, CAST(sum(e - s) AS BIGINT) AS removed, count(*) AS spans FROM k GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * e + 1), h))) AS kept_sha256 FROM h LEFT JOIN j USING (doc_id)""",
    "op13_exact_dedup": r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""",
}
