"""Joins and row numbers whose groups may be large: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS, PIECES, SAMPLE, HOT = 32, 64, 20_000, 4096
TASK = 1 << 20  # rows of a table that one task sorts or groups


def dealt(*tables: DataFrame) -> int:
    """Into how many parts to deal tables that meet by a key, so that what a task holds doesn't grow with them."""
    spark = tables[0].sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), sum(t.count() for t in tables) // TASK + 1)


def looked_up(rows: DataFrame, key: str, other: str, table: DataFrame) -> DataFrame:
    """rows joined with table by key. The rows of a key are dealt by a salt from column other; the table's row is copied
    to the salts that occur, at most SALTS of them, so neither side has a hot key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    slots = salted.select(key, "_salt").distinct().join(table, key)
    return salted.join(slots, [key, "_salt"]).drop("_salt")


def looked_up_by_size(rows: DataFrame, key: str, table: DataFrame, size: str) -> DataFrame:
    """rows joined with table by key, where table has one row a key and column `size` says how many rows have it.

    Keys with more than a HOT-th of all rows, so fewer than HOT keys, are broadcast and their rows stay where they are;
    no other key can fill a task.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    big = F.coalesce(F.col(size) * HOT > total, F.lit(False))
    hot, names = table.where(big), [c for c in table.columns if c != key]
    own = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True)).withColumnsRenamed({c: f"_h_{c}" for c in names})), key, "left")
    back = {f"_h_{c}": c for c in names}
    return own.where("_hot").drop("_hot").withColumnsRenamed(back).unionByName(own.where("_hot is null").select(*rows.columns).join(table.where(~big), key))


def borders(df: DataFrame, order: str) -> list:
    """At most PIECES - 1 values that cut the column into pieces of about equal size; from a bounded sample, which
    settles only how the work is dealt."""
    n = df.count()
    seen = df.select(order).where(F.col(order).isNotNull()).sample(min(1.0, SAMPLE / max(1, n)), 7).limit(2 * SAMPLE).collect()
    values = sorted(r[0] for r in seen)
    return sorted({values[i * len(values) // PIECES] for i in range(1, PIECES)}) if len(values) >= 2 * PIECES else []


def numbered(df: DataFrame, group: list[str], order: str, name: str) -> DataFrame:
    """Adds the row number (from 1) of each row in its group by the order column, whatever the group's size.

    A group is cut into pieces by ranges of the order; rows are numbered in their piece, and the sizes of the pieces
    before (at most PIECES a group) are added. Rows of equal order are numbered in any order, nulls first.
    """
    cuts = borders(df, order)
    piece = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    dealt = df.withColumn("_piece", F.when(F.col(order).isNull(), -1).otherwise(piece))
    sizes = dealt.groupBy(*group, "_piece").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_piece").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_row", F.row_number().over(Window.partitionBy(*group, "_piece").orderBy(order)).cast("long"))
    same = F.col("_p") == F.col("_piece")
    for i, c in enumerate(group):
        same &= F.col(f"_g{i}").eqNullSafe(F.col(c))
    return own.join(sizes, same).withColumn(name, F.col("_row") + F.col("_before")).select(*df.columns, name)


def running(df: DataFrame, group: list[str], order: str, sums: dict[str, Column] | None = None, lags: dict[str, Column] | None = None, mins: dict[str, Column] | None = None, cuts: list | None = None) -> DataFrame:
    """Adds values of what comes before each row in its group by the order, whatever the group's size.

    sums: running sums up to the row; lags: the value of the row before; mins: the least value of all rows before. A group is
    cut into pieces by ranges of the order. Each piece gives a summary (its sum, its last value, its least one), at most PIECES
    a group; what the pieces before a piece add up to is joined to its rows. cuts: the borders of the pieces, if known.
    """
    sums, lags, mins = sums or {}, lags or {}, mins or {}
    cuts = borders(df, order) if cuts is None else cuts
    piece = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    w = Window.partitionBy(*group, "_piece").orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_s_{k}": F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) for k, v in sums.items()} | {f"_l_{k}": F.lag(v).over(w) for k, v in lags.items()} | {f"_m_{k}": F.min(v).over(past) for k, v in mins.items()}
    dealt = df.withColumn("_piece", F.when(F.col(order).isNull(), -1).otherwise(piece))
    rows = dealt.withColumns(own | {"_at": F.row_number().over(w)})
    ends = [F.sum(v).alias(f"_s_{k}") for k, v in sums.items()] + [F.max_by(v, order).alias(f"_l_{k}") for k, v in lags.items()] + [F.min(v).alias(f"_m_{k}") for k, v in mins.items()]
    p = Window.partitionBy(*group).orderBy("_piece")
    before = p.rowsBetween(Window.unboundedPreceding, -1)
    held = [F.sum(f"_s_{k}").over(before).alias(f"_bs_{k}") for k in sums] + [F.lag(f"_l_{k}").over(p).alias(f"_bl_{k}") for k in lags] + [F.min(f"_m_{k}").over(before).alias(f"_bm_{k}") for k in mins]
    held = dealt.groupBy(*group, "_piece").agg(*ends).select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_piece").alias("_p"), *held)
    same = F.col("_p") == F.col("_piece")
    for i, c in enumerate(group):
        same &= F.col(f"_g{i}").eqNullSafe(F.col(c))
    both = rows.join(held, same)
    out = [(F.col(f"_s_{k}") + F.coalesce(f"_bs_{k}", F.lit(0))).alias(k) for k in sums] + [F.when(F.col("_at") == 1, F.col(f"_bl_{k}")).otherwise(F.col(f"_l_{k}")).alias(k) for k in lags] + [F.least(f"_m_{k}", f"_bm_{k}").alias(k) for k in mins]
    return both.select(*df.columns, *out)


def trailing_sum(df: DataFrame, group: str, order: str, value: str, width: int, name: str, length: int = 4096) -> DataFrame:
    """Adds the sum of a value over the last `width` rows of the group by the order, piece by piece of `length` rows.

    The last width - 1 rows of a piece are copied to the next one, so a group of any size is shared out.
    """
    rows = numbered(df, [group], order, "_n").withColumn("_at", F.floor((F.col("_n") - 1) / length))
    late = (F.col("_n") - 1) % length >= length - (width - 1)
    copied = rows.withColumns({"_own": F.lit(True)}).unionByName(rows.where(late).withColumns({"_at": F.col("_at") + 1, "_own": F.lit(False)}))
    w = Window.partitionBy(group, "_at").orderBy("_n").rowsBetween(-(width - 1), 0)
    return copied.withColumn(name, F.sum(value).over(w)).where("_own").select(*df.columns, name)
