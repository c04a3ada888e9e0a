"""URL filters: fixed host and path rules, and association rules mined from labels by FP-growth.

A url becomes a set of tokens of a dozen kinds (scheme, host, its parent, first and inner labels, the first two path
parts, the rest of the path and its last part, file type, names of query fields, fragment), each read whole; long ones
stand as their hash. FP-growth over the labelled urls, with the label as an item, gives rules from token combinations
to a block. Pruned are rules under the support bound (a share of the urls and at least `LEAST` of them), under the
confidence bound, those whose confidence isn't surely above the share of blocked urls (lower Wilson bound at `SURE`
standard deviations, and `LIFT` times that share), and those that a shorter rule with no less confidence covers.
Each rule stands in an inverted index under its rarest token, so a url meets only the rules whose rarest token it
has; an index of more than `FEW` rules isn't broadcast but dealt by token and a salt, as a common token may be in
every url. All of it is DataFrame functions and Spark ML on the JVM.

Defined cases: a null url, or one without "://", has empty host and path and no tokens; no rule fits
it and its verdict is allow; repeated urls share their verdict, also under one page_id; a labelled url counts as often
as it comes; of mined rules that fit the surest counts; without labels no rules are mined; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut

# (action, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "label=block"
LEAST, LIFT, SURE = 20, 1.2, 3.0  # pages a mined rule rests on, gain over the base rate, standard deviations
FEW, SALTS, LONG = 20_000, 32, 120


def host_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, SHAPE, 1), UPPER, LOWERED), F.regexp_extract(text, SHAPE, 2)


def fixed_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its action."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones take precedence
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, action = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def tokens(url: Column) -> Column:
    """The url's tokens: an array of at most twelve, without repeats; empty where there is no "://"."""
    host, path = host_path(url)
    bare = F.regexp_replace(host, r":\d*$", "")
    part = lambda i: F.regexp_extract(path, r"^" + r"/[^/]*" * (i - 1) + r"/([^/]+)", 1)
    shape = lambda c: F.regexp_replace(c, r"[0-9]+", "0")
    named = [
        ("scheme=", F.regexp_extract(url, r"(?s)^(.*?)://", 1)),
        ("host=", bare),
        ("site=", F.regexp_extract(bare, r"([^.]+\.[^.]+)$", 1)),
        ("first=", F.regexp_extract(bare, r"^([^.]+)\.[^.]+\.", 1)),
        ("inner=", F.regexp_extract(bare, r"^[^.]+\.(.+)\.[^.]+\.[^.]+$", 1)),
        ("dir=", shape(part(1))),
        ("page=", shape(part(2))),
        ("rest=", shape(F.regexp_extract(path, r"^/[^/]*/[^/]*/(.+)$", 1))),
        ("last=", shape(F.regexp_extract(path, r"^/[^/]*/[^/]*/(?:.*/)?([^/]+)/?$", 1))),
        ("type=", F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)),
        ("query=", F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), r"=[^&]*", "")),
        ("fragment=", F.regexp_extract(url, r"(?s)#(.+)", 1)),
    ]
    whole = lambda v: F.when(F.length(v) > LONG, F.concat(F.lit("sha256:"), F.sha2(v, 256))).otherwise(v)
    made = F.array(*(F.when(F.length(v) > 0, F.concat(F.lit(k), whole(v))) for k, v in named))
    return F.when(url.contains("://"), F.array_compact(made)).otherwise(F.array().cast("array<string>"))


def wilson(share: Column, n: Column, z: float) -> Column:
    """Lower bound of a share seen in n cases."""
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = LEAST, lift: float = LIFT, sure: float = SURE) -> DataFrame:
    """rule (array of tokens), confidence, support, first (its rarest token) from rows of url and bad (boolean)."""
    items = labelled.select(F.array_compact(F.concat(tokens(F.col("url")), F.array(F.when(F.col("bad"), F.lit(BAD))))).alias("items"), "bad").where("size(items) > 0")
    items = cut(items)
    total = items.agg(F.count("*").alias("n"), F.count_if("bad").alias("bad")).first()
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / max(1, total.n))), minConfidence=confidence).fit(items.select("items"))
    found = model.associationRules.where(F.element_at("consequent", 1) == BAD).select(F.array_sort("antecedent").alias("rule"), "confidence", "support")
    base = total.bad / max(1, total.n)
    pages = F.round(F.col("support") * total.n / F.col("confidence"))  # how many urls have the rule's tokens
    found = found.where((F.col("support") * total.n >= least - 0.5) & (F.col("confidence") >= lift * base) & (wilson(F.col("confidence"), pages, sure) > base))
    single = model.freqItemsets.where("size(items) = 1").select(F.element_at("items", 1).alias("token"), "freq")
    rare = found.withColumn("token", F.explode("rule")).join(single, "token").groupBy("rule", "confidence", "support").agg(F.min_by("token", F.struct("freq", "token")).alias("first"))
    rare = cut(rare)
    # a rule is covered by a shorter one over some of its tokens, which stands under one of them
    short = rare.select(F.col("rule").alias("short"), F.col("confidence").alias("sure"), F.col("first").alias("token"))
    covered = rare.withColumn("token", F.explode("rule")).join(short, "token").where((F.size("short") < F.size("rule")) & (F.size(F.array_except("short", "rule")) == 0) & (F.col("sure") >= F.col("confidence"))).select("rule").distinct()
    return rare.join(covered, "rule", "left_anti")


def indexed(urls: DataFrame, mined: DataFrame) -> DataFrame:
    """Each url's tokens against the rules that stand under them: url, tokens, rule, sure."""
    met = urls.withColumn("token", F.explode("tokens"))
    if mined.limit(FEW + 1).count() <= FEW:
        return met.join(F.broadcast(mined), "token")
    salted = mined.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return met.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, support: float = 0.002, confidence: float = 0.6, least: int = LEAST, lift: float = LIFT, sure: float = SURE) -> DataFrame:
    """page_id, host, path, rule and verdict of each page; confidence: of the mined rule that fits best, if any."""
    mined = cut(mine(labelled, support, confidence, least, lift, sure)).select("rule", F.col("confidence").alias("sure"), F.col("first").alias("token"))
    urls = pages.where(F.col("url").isNotNull()).select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    hits = indexed(urls, mined).where(F.size(F.array_except("rule", "tokens")) == 0).groupBy("url").agg(F.max("sure").alias("confidence"))
    host, path = host_path(F.col("url"))
    out = pages.select("page_id", "url").join(hits, "url", "left").withColumns({"host": host, "path": path})
    rule, action = fixed_rule(rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))}).select("page_id", "host", "path", "rule", "verdict", "confidence")
