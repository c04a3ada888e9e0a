"""Catalog tables: lookups, validation with defaults, inserts, updates, upserts and cascades of deletes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.operators.spread import dealt
from tracklake.sources.tables import cut

LARGE = 1 << 18  # rows of a parent from which both sides are dealt by its key


def like(table: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose column contains the part; % and _ in it are wildcards."""
    return table.where(F.col(column).like(f"%{part}%"))


def listing(table: DataFrame, by: str) -> DataFrame:
    """All rows in the order of a column."""
    return table.orderBy(F.asc(by))


def matching(table: DataFrame, **equal) -> DataFrame:
    """All rows with the given values."""
    for column, value in equal.items():
        table = table.where(F.col(column) == F.lit(value))
    return table


def lookup(table: DataFrame, by: str, **equal) -> DataFrame:
    """The first row by `by` with the given values."""
    return matching(table, **equal).orderBy(by).limit(1)


def validated(table: DataFrame, defaults: dict[str, object], least: dict[str, float], needed: list[str]) -> DataFrame:
    """Defaults filled in; reason says what is below its least value or empty, null where the row is valid."""
    out = table.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
    bad = [F.when(F.coalesce(F.col(c) == "", F.lit(True)), F.lit(f"{c} empty")) for c in needed] + [F.when(F.col(c) < v, F.lit(f"{c} below {v:g}")) for c, v in least.items()]
    return out.withColumn("reason", F.coalesce(*bad)).withColumn("is_valid", F.col("reason").isNull())


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key its latest row by `order`, changes counting after stored rows."""
    every = stored.withColumn("_late", F.lit(0)).unionByName(changes.withColumn("_late", F.lit(1)))
    rest = [c for c in stored.columns if c not in keys]
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_late", order)).alias("r")).select(*keys, "r.*")


def update(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the non-null values of their change."""
    rest = [c for c in stored.columns if c not in keys]
    given = changes.select(*keys, *(F.col(c).alias(f"_{c}") for c in rest if c in changes.columns))
    return stored.join(given, keys, "left").select(*keys, *(F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in rest))


def insert(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored and the rows whose key it hasn't."""
    return stored.unionByName(rows.join(stored.select(*keys), keys, "left_anti"))


@dataclass(frozen=True)
class Link:
    """A foreign key: child's column names a row of parent by its key."""

    parent: str
    key: str
    child: str
    column: str


def cascade(tables: dict[str, DataFrame], links: list[Link], doomed: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Deletes run down the foreign keys: what each table keeps, and what it loses with the reason.

    doomed: rows to delete (columns that tell them) by table. links come in order, no parent after its children. A row goes
    if it is doomed (deleted), if a parent's row went (cascade), or if it names no row of a parent, or none at all (orphan).
    Each table is read once and joined with the keys of its parents; what is lost isn't collected anywhere.
    """
    state: dict[str, DataFrame] = {}

    def marked(name: str) -> DataFrame:
        df = tables[name].withColumn("_reason", F.lit(None).cast("string"))
        if name in doomed:
            keys = doomed[name].columns
            df = df.join(doomed[name].distinct().withColumn("_doomed", F.lit(True)), keys, "left").withColumn("_reason", F.when(F.col("_doomed"), "deleted")).drop("_doomed")
        for link in (x for x in links if x.child == name):
            above = state[link.parent].select(F.col(link.key).alias(link.column), F.col("_reason").isNull().alias("_stands"))
            # a key that comes again stands as long as one of its rows does
            above = above.where(F.col(link.column).isNotNull())
            if state[link.parent].count() > LARGE:  # else Spark sends the parent's keys to its children
                n = dealt(tables[name], state[link.parent])
                above, df = above.repartition(n, link.column), df.repartition(n, link.column)
            above = above.groupBy(link.column).agg(F.bool_or("_stands").alias("_stands"))
            found = F.when(F.col("_stands").isNull(), "orphan").when(~F.col("_stands"), "cascade")
            df = df.join(above, link.column, "left").withColumn("_reason", F.coalesce("_reason", found)).drop("_stands")
        return df.select(*tables[name].columns, "_reason")

    parents = [x.parent for x in links]
    for name in sorted(tables, key=lambda n: max([i + 1 for i, x in enumerate(links) if x.child == n], default=0)):
        state[name] = marked(name)
        if name in parents:
            state[name] = cut(state[name])  # its children read it again
    kept = {n: df.where("_reason is null").drop("_reason") for n, df in state.items()}
    return kept, {n: df.where("_reason is not null").withColumnRenamed("_reason", "reason") for n, df in state.items()}
