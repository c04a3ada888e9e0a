"""Subtitle rules: title cleaning and groups, text hashes, and pruning by stages to a budget.

Rows: grp (one merge), language, ord, title, hearing (flag), class (plain, styled, picture), md5, keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.scalars import subtitle_text
from tracklake.operators.records import style_lines


def _bare(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def title_plain(title: Column) -> Column:
    """Without outer white space; the only one that keeps the case."""
    return _bare(title)


def title_dubbed(title: Column) -> Column:
    return _bare(F.regexp_replace(F.lower(title), r"\s*\(?dubtitle\)?\s*", ""))


def title_hearing(title: Column) -> Column:
    """Without the first of the markers sdh and (cc) that it has; empty for cc or hi alone."""
    low = F.lower(title)
    return _bare(F.when(F.contains(low, F.lit("sdh")), F.regexp_replace(low, r"\s*\(?sdh\)?\s*", "")).when(F.contains(low, F.lit("(cc)")), F.regexp_replace(low, r"\s*\(cc\)\s*", "")).when(low.isin("hi", "cc"), "").otherwise(low))


def title_forced(title: Column) -> Column:
    return _bare(F.regexp_replace(F.regexp_replace(F.lower(title), r"\s*\(?forced\)?\s*", ""), r"\s*\(?forcé\)?\s*", ""))


def is_forced(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike("forced|forcé"), F.lit(False))


def is_hearing(title: Column, flag: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.contains(low, F.lit("sdh")) | F.contains(low, F.lit("(cc)")) | low.isin("cc", "hi") | F.coalesce(flag, F.lit(False))


def is_dubbed(title: Column) -> Column:
    return F.coalesce(F.contains(F.lower(title), F.lit("dubtitle")), F.lit(False))


def styled_text(text: Column) -> Column:
    """Lines of a styled document that aren't blank, without the three fields before their text; null if there are none."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[^,\n]+,\d[^,\n]+,[^,\n]+,", "")), "\n"))


def text_hash(plain: Column, styled: Column) -> Column:
    """MD5 of the styled form where it has several styles or none is known, else of the plain form."""
    styles = style_lines(styled)
    return F.md5(F.when(styles.isNull() | (styles > 1), styled_text(styled)).otherwise(subtitle_text(plain)))


def unlike_styled(tracks: DataFrame, hash_: str) -> DataFrame:
    """keep turned off for plain tracks whose text hash a kept styled track of the merge and language has."""
    styled = tracks.where((F.col("class") == "styled") & F.col("keep") & F.col(hash_).isNotNull()).select("grp", "language", hash_, F.lit(True).alias("_styled")).distinct()
    both = tracks.join(styled, ["grp", "language", hash_], "left")
    return both.withColumn("keep", F.col("keep") & ~((F.col("class") == "plain") & F.coalesce("_styled", F.lit(False)))).select(*tracks.columns)


def title_group(tracks: DataFrame, title: Column, synonyms: DataFrame, name: str) -> DataFrame:
    """Adds the group of a title: the first of its language that lists it, else the title itself. synonyms: language, group, title."""
    known = synonyms.groupBy("language", "title").agg(F.min("group").cast("string").alias("_group")).withColumnRenamed("title", "_title")
    both = tracks.withColumn("_title", title).join(known, ["language", "_title"], "left")
    return both.withColumn(name, F.coalesce(F.concat(F.lit("#"), "_group"), F.concat(F.lit("="), "_title"))).select(*tracks.columns, name)


def first_of_hash(tracks: DataFrame) -> DataFrame:
    """keep turned off for all but the first kept track of each hash of a merge; an empty hash is never a duplicate."""
    w = Window.partitionBy("grp", "md5", "keep").orderBy("language", "ord")
    again = (F.coalesce(F.col("md5"), F.lit("")) != "") & (F.row_number().over(w) > 1)
    return tracks.withColumn("keep", F.col("keep") & ~again)


def pruned(tracks: DataFrame, most: Column, synonyms: DataFrame, keep_languages: list[str], try_languages: list[str]) -> DataFrame:
    """Adds step (null for tracks that no step takes) and turns keep off until each merge has at most `most` kept tracks.

    After equal hashes, steps in order, each only while there are too many: 1 forced plain tracks where there is a styled
    one in the group of their title, else all but the first; 2 the same for all others of languages not listed; 3 for each
    language to try, hearing, then dubbed, then the rest; 4 for languages not listed one styled track a group, forced,
    hearing, dubbed, the rest; 5 as 3 for the languages to keep; 6 the other tracks of languages not listed, one by one;
    7 as 4 for the languages to try. Groups of steps 2, 3 and 5 are made of what step 1 leaves. A styled track that is forced
    and of another kind too stands in two groups of step 4 or 7 and counts as taken in both, as the original counts it.
    Steps only take, so those that are run are the first ones: a merge has a last one, and tracks up to it go.
    """
    t = first_of_hash(tracks)
    forced, heard, dubbed = is_forced(F.col("title")), is_hearing(F.col("title"), F.col("hearing")), is_dubbed(F.col("title"))
    t = t.withColumn("_kind", F.when(heard, 2).when(dubbed, 3).when(~forced, 4)).withColumn("_forced", forced)
    t = title_group(t, title_forced(F.col("title")), synonyms, "_fgroup")
    t = title_group(t, F.when(F.col("_kind") == 2, title_hearing(F.col("title"))).when(F.col("_kind") == 3, title_dubbed(F.col("title"))).otherwise(title_plain(F.col("title"))), synonyms, "_group")
    listed = F.when(F.col("language").isin(*keep_languages), "keep").when(F.col("language").isin(*try_languages), "try").otherwise("no")
    rank = F.coalesce(*(F.when(F.col("language") == x, F.lit(i)) for names in (try_languages, keep_languages) for i, x in enumerate(names)), F.lit(0))

    def place(kind: Column, group: str, class_: str, live: Column) -> tuple[Column, Column]:
        """Place of a live track of a class among those of its kind and group, and whether a styled one is there."""
        own = F.when(live & (F.col("class") == class_) & kind.isNotNull(), F.col("ord"))
        w = Window.partitionBy("grp", "language", group, kind)
        some = F.count(F.when(F.col("keep") & (F.col("class") == "styled"), 1)).over(w) > 0
        return F.when(own.isNotNull(), F.row_number().over(w.orderBy(own.isNull().cast("int"), own))), some

    f, k = F.when(F.col("_forced"), F.lit(1)), F.col("_kind")
    goes = lambda at, styled: at.isNotNull() & (styled | (at > 1))
    t = t.withColumns({"_listed": listed, "_rank": rank, "_first": F.coalesce(goes(*place(f, "_fgroup", "plain", F.col("keep"))), F.lit(False))})
    left = F.col("keep") & ~F.col("_first")
    values = [goes(*place(k, "_group", "plain", left)), place(f, "_fgroup", "styled", left)[0] > 1, place(k, "_group", "styled", left)[0] > 1]
    t = t.withColumns({n: F.coalesce(v, F.lit(False)) for n, v in zip(("_plain", "_extra_forced", "_extra"), values, strict=True)})
    step = lambda n, language, kind: F.struct(F.lit(n).alias("stage"), language.cast("string").alias("language"), kind.cast("long").alias("part"))
    none = F.lit("")
    padded = F.lpad(F.col("_rank").cast("string"), 6, "0")
    plain, extra = F.col("_plain"), F.col("_extra_forced") | F.col("_extra")
    both = lambda n, language: F.filter(F.array(F.when(F.col("_extra_forced"), step(n, language, F.lit(1))), F.when(F.col("_extra"), step(n, language, k))), lambda x: x.isNotNull())
    steps = (
        F.when(~F.col("keep"), F.array().cast("array<struct<stage:int,language:string,part:bigint>>"))
        .when(F.col("_first"), F.array(step(1, none, F.lit(0))))
        .when(plain & (F.col("_listed") == "no"), F.array(step(2, none, F.lit(0))))
        .when(plain & (F.col("_listed") == "try"), F.array(step(3, padded, k)))
        .when(extra & (F.col("_listed") == "no"), both(4, F.col("language")))
        .when(plain & (F.col("_listed") == "keep"), F.array(step(5, padded, k)))
        .when(F.col("_listed") == "no", F.array(step(6, F.col("language"), F.col("ord"))))
        .when(extra & (F.col("_listed") == "try"), both(7, padded))
    )
    t = t.withColumn("_steps", steps).withColumn("step", F.array_min("_steps"))
    total = t.groupBy("grp").agg(F.count_if("keep").alias("_total"), F.max(most).alias("_most"))
    taken = t.select("grp", F.explode("_steps").alias("_step")).groupBy("grp", "_step").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("grp").orderBy("_step")) - F.col("_n")
    run = taken.withColumn("_before", before).join(total, "grp").where(F.col("_total") - F.col("_before") > F.col("_most"))
    last = run.groupBy(F.col("grp").alias("_grp")).agg(F.max("_step").alias("_last"))
    t = t.join(last, F.col("grp").eqNullSafe(F.col("_grp")), "left")
    return t.withColumn("keep", F.col("keep") & ~F.coalesce(F.col("step") <= F.col("_last"), F.lit(False))).select(*tracks.columns, "step")
