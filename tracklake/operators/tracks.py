"""Track records: metadata joins, roles, languages, hashes, duplicate removal, pairs and output order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.operators.spread import looked_up
from tracklake.sources.tables import cut




def triple_join(tracks: DataFrame, properties: DataFrame, streams: DataFrame, on: str, also: str) -> DataFrame:
    """Each track with both of its other records; found tells those that lack one."""
    return tracks.join(properties.withColumn("_p", F.lit(True)), on, "left").join(streams.withColumn("_s", F.lit(True)), also, "left").withColumn("found", F.col("_p").isNotNull() & F.col("_s").isNotNull()).drop("_p", "_s")


def audio_role(title: Column, commentary: Column, described: Column) -> Column:
    """commentary before audiodesc before main, from the lower-cased title and the flags."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.when(F.contains(low, F.lit("commentary")) | F.coalesce(commentary, F.lit(False)), "commentary").when(
        F.coalesce(described, F.lit(False)) | low.rlike("audio description|audiodesc|visual impaired"), "audiodesc").otherwise("main")


def subtitle_role(title: Column, hearing: Column) -> Column:
    """forced before hearing before dubtitle before plain, as tracks are put out."""
    low = F.lower(F.coalesce(title, F.lit("")))
    heard = F.contains(low, F.lit("sdh")) | F.contains(low, F.lit("(cc)")) | low.isin("cc", "hi") | F.coalesce(hearing, F.lit(False))
    return F.when(low.rlike("forced|forcé"), "forced").when(heard, "hearing").when(F.contains(low, F.lit("dubtitle")), "dubtitle").otherwise("plain")


def common(members: DataFrame, group: str, item: str) -> DataFrame:
    """Items that every group has."""
    total = members.select(F.countDistinct(group).alias("n"))
    return members.groupBy(item).agg(F.countDistinct(group).alias("groups")).join(F.broadcast(total), F.col("groups") == F.col("n")).drop("n")  # one row


def accumulated(*sets: DataFrame) -> DataFrame:
    """What any of several sets of the same columns holds, once."""
    out = sets[0]
    for more in sets[1:]:
        out = out.unionByName(more)
    return out.distinct()


def unique_tracks(rows: DataFrame, group: str, hash_: str) -> DataFrame:
    """How many tracks of a group stay when equal hashes count once and empty ones each."""
    h = F.nullif(F.col(hash_), F.lit(""))
    return rows.groupBy(group).agg((F.countDistinct(h) + F.count_if(h.isNull())).alias("tracks"))


def most_common(members: DataFrame, group: str, item: str) -> DataFrame:
    """The item of most groups, ties by name."""
    return members.groupBy(item).agg(F.countDistinct(group).alias("groups")).orderBy(F.desc("groups"), item).limit(1)


def needed_language(members: DataFrame, group: str, item: str) -> DataFrame:
    """The same, but an error where no item is in two groups."""
    best = most_common(members, group, item)
    return best.where(F.when(F.col("groups") < 2, F.raise_error(F.lit("no language in common"))).otherwise(F.lit(True)).cast("boolean"))


def keep_first(tracks: DataFrame, hash_: Column, order: str) -> DataFrame:
    """Adds keep: the first of each hash by the order; an empty hash is never a duplicate."""
    first = tracks.withColumn("_h", F.nullif(hash_, F.lit("")))
    least = first.where("_h is not null").groupBy("_h").agg(F.min(order).alias("_first"))
    return first.join(least, "_h", "left").withColumn("keep", F.col("_h").isNull() | (F.col(order) == F.col("_first"))).drop("_h", "_first")


def hashed(tracks: DataFrame, what: dict[str, Column]) -> DataFrame:
    """Adds hash, the MD5 of what counts for a track's kind; null for kinds without an entry or content."""
    value = F.coalesce(*(F.when(F.col("kind") == kind, c) for kind, c in what.items()))
    return tracks.withColumn("hash", F.md5(value))


def signatures(members: DataFrame, owner: str, hash_: Column) -> DataFrame:
    """Owners with equal sets of hashes: signature, representative (the smallest owner) and members."""
    own = members.groupBy(owner).agg(F.array_join(F.array_sort(F.collect_set(hash_)), "").alias("signature"))
    least = own.groupBy("signature").agg(F.min(owner).alias("representative"), F.count("*").alias("members"))
    return own.join(least, "signature").select(owner, F.md5("signature").alias("signature"), "representative", "members")


def pairs(rows: DataFrame, group: list[str], order: str, carry: list[str]) -> DataFrame:
    """Every two rows of a group, the smaller by the order first."""
    left = rows.select(*group, F.col(order).alias("i"), *(F.col(c).alias(f"{c}_i") for c in carry))
    right = rows.select(*group, F.col(order).alias("j"), *(F.col(c).alias(f"{c}_j") for c in carry))
    return left.join(right, group).where("i < j")


def text_over_picture(subtitles: DataFrame, group: list[str], kind: str, order: str) -> DataFrame:
    """Per group: all styled ones if there are any, else the first plain one."""
    w = Window.partitionBy(*group)
    styled = F.max((F.col(kind) == "ass").cast("int")).over(w)
    rank = F.row_number().over(w.orderBy(order))
    return subtitles.withColumns({"_s": styled, "_r": rank}).where(F.when(F.col("_s") == 1, F.col(kind) == "ass").otherwise(F.col("_r") == 1)).drop("_s", "_r")


def within_budget(tracks: DataFrame, group: str, rank: list, most: int) -> DataFrame:
    """Per group the first `most` tracks by the rank."""
    return tracks.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*rank))).where(F.col("place") <= most)


def in_stages(tracks: DataFrame, group: str, stages: list[Column], most: int) -> DataFrame:
    """Drops the tracks of one stage after another (each all at once) until a group is within its budget.

    A track's stage is the first whose condition holds; tracks without one always stay.
    """
    stage = F.coalesce(*(F.when(c, i) for i, c in enumerate(stages)), F.lit(len(stages)))
    out = tracks.withColumn("stage", stage)
    w = Window.partitionBy(group)
    total = F.count("*").over(w)
    before = F.coalesce(F.count("*").over(w.orderBy("stage").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return out.withColumns({"_n": total, "_b": before}).where((F.col("stage") == len(stages)) | (F.col("_n") - F.col("_b") <= most)).drop("_n", "_b")


def subtitle_key(language: Column, role: Column, class_: Column) -> Column:
    """What subtitles are put out by, as text: language, role and class. role: as of `subtitle_role`; class: as of `codec_class`."""
    part = F.when(role == "plain", "_aa").otherwise(F.concat(F.lit("_"), role))
    return F.concat(language, part, F.when(class_ == "picture", "_uncodable").when(class_ == "plain", "_srt").otherwise("_all"))


def audio_key(language: Column, role: Column) -> Column:
    """What sound is put out by: the language, with a mark for comments and for descriptions of the picture."""
    return F.concat(language, F.when(role == "commentary", "_com").when(role == "audiodesc", "_visuali").otherwise(""))


def output_order(tracks: DataFrame, group: str, key: Column, order: str) -> DataFrame:
    """Adds place: tracks of a group by their key, then in the order they came."""
    return tracks.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(key, order)).cast("long"))


def tree_delays(edges: DataFrame) -> DataFrame:
    """Sums of delays along the way from the roots: edges (winner, loser, delay), one a loser, to node, root, delay.

    Each round doubles the length of the ways known, so log2 of the number of edges bounds the rounds. What is not at a
    root then stands in or below a cycle; its root and delay are null.
    """
    edges = cut(edges.select("winner", "loser", F.col("delay").cast("long").alias("delay")))
    roots = cut(edges.select(F.col("winner").alias("node")).distinct().join(edges.select(F.col("loser").alias("node")).distinct(), "node", "left_anti"))
    ends = roots.select(F.col("node").alias("root"), F.lit(True).alias("_end"))
    first = edges.select(F.col("loser").alias("node"), F.col("winner").alias("root"), "delay")
    up = cut(first.join(ends, "root", "left").select("node", "root", "delay", F.coalesce("_end", F.lit(False)).alias("_end")))
    for _ in range(edges.count().bit_length() + 1):
        open_ = up.where("not _end")
        if not open_.limit(1).count():
            break
        way = up.select(F.col("node").alias("root"), F.col("root").alias("_up"), F.col("delay").alias("_d"), F.col("_end").alias("_e"))
        further = looked_up(open_.drop("_end"), "root", "node", way)
        up = cut(up.where("_end").unionByName(further.select("node", F.col("_up").alias("root"), (F.col("delay") + F.col("_d")).alias("delay"), F.col("_e").alias("_end"))))
    done = up.select("node", F.when(F.col("_end"), F.col("root")).alias("root"), F.when(F.col("_end"), F.col("delay")).alias("delay"))
    return done.union(roots.select("node", F.col("node").alias("root"), F.lit(0).cast("long")))
