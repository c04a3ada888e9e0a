"""Arriving names routed by prioritised regex rules, episodes, and target names."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.functions.scalars import episode_group, episode_text, java_pattern, renamed, valid_episode
from tracklake.operators.spread import looked_up, looked_up_by_size, numbered
from tracklake.sources.tables import cut

BLOCK = 200  # rules tried in one pass over the names
GRAM = 3  # letters that a rule must need to be in the index, and that its piece is known by at both ends
INDEXED = 100_000  # rules whose index is broadcast; a larger one is met by a dealt join


def needed(pattern: str) -> str:
    """The longest text that every match of a pattern holds for certain; empty where none is sure.

    Only plain letters of the outermost sequence count: groups, classes, and what a quantifier may leave out end a run;
    a choice on the outermost level, or flags inside the pattern, leave nothing sure.
    """
    runs, run, depth, i = [], "", 0, 0
    if "(?" in pattern and re.search(r"\(\?[a-zA-Z-]+[:)]", pattern):
        return ""
    while i < len(pattern):
        c, wide, plain = pattern[i], 1, False
        if c == "\\":
            wide, plain = 2, i + 1 < len(pattern) and not pattern[i + 1].isalnum()
            c = pattern[i + 1 : i + 2]
        elif c == "[":
            end = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            wide = (end if end > 0 else len(pattern)) - i + 1
        elif c == "|" and not depth:
            return ""
        elif c in "()":
            depth += 1 if c == "(" else -1
        else:
            plain = c not in ".^$*+?{}|"
        i += wide
        again = re.match(r"[*+?]|\{(\d*),?\d*\}", pattern[i:])
        if again:
            i += again.end()
            lazy = re.match(r"[?+]", pattern[i:])
            i += lazy.end() if lazy else 0
        sure = plain and not depth and (not again or again[0] == "+" or bool(again[1]) and int(again[1]) > 0)
        run = run + c if sure else ""
        runs.append(run)
        if again:
            run = ""
    return max(runs, key=len, default="")


def tried(names: DataFrame, some: list[Row], rules: DataFrame) -> DataFrame:
    """The first of a block of rules that each name matches: its number is found once, the rule is joined by it."""
    first = F.coalesce(*(F.when(F.col("nom").rlike(java_pattern(r.regex_pattern)), F.lit(i)) for i, r in enumerate(some, 1)))
    numbered_ = names.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(some, 1)], T.StructType([T.StructField("_first", T.IntegerType()), *rules.schema.fields]))
    return names.withColumn("_first", first).join(F.broadcast(numbered_), "_first").drop("_first")  # at most BLOCK rules


def piece_index(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rules with the piece that they need, whole (adds piece), and the rules that need less than GRAM letters."""
    known = rules.withColumn("piece", F.udf(needed, "string")("regex_pattern"))  # once a rule
    short = F.length("piece") < GRAM
    return known.where(~short), known.where(short).drop("piece")


def asked(noms: DataFrame, index: DataFrame) -> DataFrame:
    """nom, piece: the pieces of each name that some rule may need.

    Of the places of a name only those count whose first GRAM letters begin some piece, and of these only the lengths of
    such pieces that end in the right letters too; so a name asks for few pieces, however many rules there are.
    """
    shape = lambda piece: (F.substring(piece, 1, GRAM).alias("head"), F.length(piece).alias("wide"), F.right(piece, F.lit(GRAM)).alias("tail"))
    shapes = cut(index.select(*shape("piece")).distinct())
    near = shapes.count() <= INDEXED
    heads = shapes.groupBy("head").agg(F.collect_set("wide").alias("_wide"))
    places = F.posexplode(F.transform(F.sequence(F.lit(1), F.length("nom") - GRAM + 1), lambda i: F.substring("nom", i, GRAM))).alias("_at", "head")
    at = noms.where(F.length("nom") >= GRAM).select("nom", places)
    at = at.join(F.broadcast(heads), "head") if near else looked_up(at, "head", "nom", heads)
    one = at.select("nom", "_at", F.explode("_wide").alias("wide")).where(F.col("_at") + F.col("wide") <= F.length("nom"))
    one = one.select("nom", F.expr("substring(nom, _at + 1, wide)").alias("piece"))
    if near:
        one = one.select("nom", "piece", *shape("piece")).join(F.broadcast(shapes), ["head", "wide", "tail"], "left_semi").select("nom", "piece")
    return one.distinct()


def found_by_index(names: DataFrame, rules: DataFrame, by_weight: bool) -> DataFrame:
    """As first_match, for any number of rules: each distinct name tries those that need a piece which it has.

    Rules that need too little are tried by blocks, each a pass over the distinct names.
    """
    noms = cut(names.where("nom is not null").groupBy("nom").agg(F.count("*").alias("_times")))
    index, short = piece_index(rules)
    index = cut(index)
    wanted = asked(noms.select("nom"), index)
    met = wanted.join(F.broadcast(index), "piece") if index.count() <= INDEXED else looked_up(cut(wanted), "piece", "nom", index)
    sure = met.where(F.rlike("nom", F.regexp_replace("regex_pattern", r"\(\?P<", "(?<"))).select("nom", *rules.columns)
    order = [F.desc("weight"), F.col("regex_pattern")] if by_weight else [F.col("regex_pattern")]
    for some in blocks(short, *order):
        sure = sure.unionByName(tried(noms.select("nom"), some, rules))
    place = F.struct(*([-F.col("weight")] if by_weight else []), F.col("regex_pattern"))
    best = sure.groupBy("nom").agg(F.min_by(F.struct(*rules.columns), place).alias("_rule")).join(noms, "nom")
    return looked_up_by_size(names, "nom", best, "_times").select(*names.columns, "_rule.*")


def blocks(rules: DataFrame, *order: Column) -> Iterator[list[Row]]:
    """The rules in order, BLOCK of them at a time; only one block is held at once."""
    ordered, at = rules.orderBy(*order), 0
    while some := ordered.offset(at).limit(BLOCK).collect():
        yield some
        if len(some) < BLOCK:
            return
        at += BLOCK


def first_match(names: DataFrame, rules: DataFrame, by_weight: bool = True) -> DataFrame:
    """Each name with the heaviest rule whose pattern it matches (ties by pattern); names without one drop out.

    names: nom and others. rules: regex_pattern, folder_id, rename_pattern, weight; by_weight: false takes the rules in
    the order of their patterns alone. Up to BLOCK rules are literals of one projection, so each is compiled once and no
    name is shuffled; more of them are found by an index of what they need.
    """
    order = [F.desc("weight"), F.col("regex_pattern")] if by_weight else [F.col("regex_pattern")]
    rules = rules.where("regex_pattern is not null")
    some = rules.orderBy(*order).limit(BLOCK + 1).collect()
    if not some:
        return names.crossJoin(rules).limit(0)
    return tried(names, some, rules) if len(some) <= BLOCK else found_by_index(names, rules, by_weight)


def with_episode(routed: DataFrame) -> DataFrame:
    """Adds episode (null where the pattern gives no valid number) and why it was rejected."""
    known = "_group" in routed.columns
    texted = routed.withColumn("_text", episode_text(F.col("nom"), F.col("regex_pattern"), F.col("_group") if known else None))
    text, valid = F.col("_text"), valid_episode(F.col("_text"))
    out = texted.withColumn("episode", F.when(valid, text.try_cast("long"))).withColumn("reason", F.when(text.isNull(), "no episode").when(~valid, "invalid episode"))
    return out.drop("_text", "_group")


def episodes_of(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Names with the rule that they match first and their episode; where a rule's episode stands is found once a rule."""
    return with_episode(first_match(names, rules.withColumn("_group", episode_group(F.col("regex_pattern")))))


def with_target(episodes: DataFrame, folders: DataFrame, step: int = 0) -> DataFrame:
    """Valid episodes within their folder's bound, with their target name. folders: folder_id, max_episode_number."""
    within = episodes.where("episode is not null").join(folders, "folder_id").where(F.col("episode") <= F.col("max_episode_number"))
    return within.withColumn("target", renamed(F.col("rename_pattern"), F.col("episode") + step))


def conflicts(samples: DataFrame, rules: DataFrame) -> DataFrame:
    """Samples (id, nom) that some stored rule matches already."""
    pattern = rules.select("regex_pattern").distinct()
    return first_match(samples, pattern, by_weight=False).select(*samples.columns)


def by_weight(episodes: DataFrame) -> DataFrame:
    """Files and best weight of each (folder, episode), and the files at that weight."""
    return episodes.groupBy("folder_id", "episode").agg(F.count("*").alias("files"), F.max("weight").alias("best_weight"), F.countDistinct("weight").alias("weights"))


def winners(arrivals: DataFrame, order: str = "id") -> DataFrame:
    """The incumbent of each (folder, episode) after all arrivals: a later one wins only with more weight."""
    return arrivals.groupBy("folder_id", "episode").agg(F.min_by(F.struct("nom", "weight", order), F.struct(-F.col("weight"), F.col(order))).alias("w")).select("folder_id", "episode", "w.*")


def with_rejects(arrivals: DataFrame, order: str = "id") -> DataFrame:
    """What becomes of all files of each (folder, episode): one row for each class of files that merge with each other.

    arrivals: folder_id, episode, nom, weight, size, id, signature; files merge if their signatures are equal (null with
    null). The class of the heaviest file (ties to the earlier) is primary and named after that file; files of other
    classes can't be merged into it, so each such class is an incompatible one, named after its heaviest file, of equals
    the largest, of those the latest. files: how many the class takes in.
    """
    keys = ["folder_id", "episode"]
    top = F.struct("weight", -F.col(order), "nom", "size")
    held = F.struct("weight", "size", F.col(order).alias("_o"), "nom")
    c = arrivals.groupBy(*keys, "signature").agg(F.max(top).alias("_first"), F.max(held).alias("_held"), F.count("*").alias("files"))
    best = c.groupBy(*keys).agg(F.max("_first").alias("_best"))
    c = c.join(best, keys).withColumn("primary", F.col("_first") == F.col("_best"))
    name = F.when(F.col("primary"), F.col("_first.nom")).otherwise(F.col("_held.nom"))
    weight = F.when(F.col("primary"), F.col("_first.weight")).otherwise(F.col("_held.weight"))
    return c.select(*keys, "signature", F.when(F.col("primary"), "primary").otherwise("incompatible").alias("role"), name.alias("nom"), weight.alias("weight"), "files")


def collision_names(files: DataFrame, base: str, order: str) -> DataFrame:
    """Equal base names told apart: the first keeps its name, later ones get _1, _2 by the order."""
    n = F.col("_n") - 1
    return numbered(files, [base], order, "_n").withColumn("name", F.when(n == 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_"), n.cast("string")))).drop("_n")
