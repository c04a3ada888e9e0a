"""Compression of vectors to short codes: product quantisation with integer codebooks.

Components become integers, floor(4096 * x), and are kept as columnar blocks: a block has up to `BLOCK` vectors, one
numpy array for each component. A round is one RDD `treeAggregate` over the blocks. In a block the squared distances to the
entries of a part's codebook accumulate dimension by dimension, the nearest entries are taken, and `np.add.at` adds the
parts and counts into int64 tensors (part x entry x position, part x entry), which merge through a reduction tree.
The tensors have one fixed size, whatever the table's, so the driver gets a few small arrays a round; integers add up to the
same sums in any order, so lost and repeated tasks change nothing. Blocks lie in a table in the shared folder.

Each of `PARTS` codebooks has `ENTRIES` entries and starts as that part of the rows with the smallest ids. A round assigns
each part to its nearest entry (ties to the lower index) and replaces the entries by floor(sum / count) component by
component; unused ones stay.

Defined cases: rows whose vector is null or empty or holds null, infinite or NaN components are dropped, as are those without
an id and those whose length isn't the most frequent one (of equally frequent lengths the largest); repeated rows are rows
of their own, of one id the smaller vector first; fewer rows than `ENTRIES` give as many entries; lengths that
`PARTS` doesn't divide make the first parts one component longer; integers beyond +-`LIMIT` are set to it, so that no
distance overflows; null labels count as one label; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import cut, looked_up_by_size, rows

SCALE, PARTS, ENTRIES, ROUNDS, BLOCK, LIMIT, DEPTH = 4096, 8, 16, 6, 4096, 1 << 27, 3
BLOCKS = "n int, ids binary, labels array<string>, columns binary"


def valid(table: DataFrame) -> DataFrame:
    """vec_id, label and vector (of doubles) of the rows that are kept."""
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col("label").cast("string") if "label" in table.columns else F.lit(None).cast("string")
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("vector")).where(sound & F.col("vec_id").isNotNull())
    common = every.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), F.desc("n")).first()
    return every.where(F.size("vector") == (common.n if common else 0))


def integers(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x * SCALE), -LIMIT, LIMIT).astype(np.int64)


def blocks(vectors: DataFrame) -> DataFrame:
    """Columnar blocks: ids, labels, and the integer components one after another, each for all vectors of the block."""

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, BLOCK):
                b = batch.slice(s, BLOCK)
                x = integers(b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
                columns = np.ascontiguousarray(x.T.astype(np.int32))
                yield rows(
                    [("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("columns", pa.binary())],
                    [b.num_rows], [b.column("vec_id").to_numpy().astype(np.int64).tobytes()], [b.column("label").to_pylist()], [columns.tobytes()],
                )

    return vectors.mapInArrow(run, BLOCKS)


def bounds(dims: int) -> list[int]:
    """Where the parts begin, with the end at last."""
    short, longer = divmod(dims, PARTS)
    return [p * short + min(p, longer) for p in range(PARTS + 1)]


def nearest(columns: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each vector's part and its squared distance; columns: position x vector, book: entry x position."""
    distance = np.zeros((len(book), columns.shape[1]), np.int64)
    for at in range(len(columns)):
        gap = columns[at][None, :].astype(np.int64) - book[:, at, None]
        distance += gap * gap
    code = distance.argmin(axis=0)
    return code, np.take_along_axis(distance, code[None, :], axis=0)[0]


def start(vectors: DataFrame, edges: list[int]) -> list[np.ndarray]:
    """The codebooks of the first ENTRIES rows by id."""
    first = vectors.orderBy("vec_id", "vector").limit(ENTRIES).select("vector").collect()
    x = integers(np.array([r.vector for r in first]))
    return [x[:, s:e] for s, e in zip(edges, edges[1:], strict=False)]


def improved(table: DataFrame, books: list[np.ndarray], edges: list[int]) -> list[np.ndarray]:
    """The codebooks after a round over all blocks."""
    entries, wide = len(books[0]), max(b.shape[1] for b in books)
    shared = table.sparkSession.sparkContext.broadcast(books)  # PARTS x ENTRIES x positions, one size for all tables

    def add(total, row):
        sums, counts = total
        columns = np.frombuffer(row.columns, np.int32).reshape(edges[-1], row.n)
        for p, book in enumerate(shared.value):
            own = columns[edges[p] : edges[p + 1]]
            code, _ = nearest(own, book)
            np.add.at(counts[p], code, 1)
            for at, values in enumerate(own):
                np.add.at(sums[p, :, at], code, values)
        return sums, counts

    def merge(a, b):
        return a[0] + b[0], a[1] + b[1]

    zero = (np.zeros((PARTS, entries, wide), np.int64), np.zeros((PARTS, entries), np.int64))
    sums, counts = table.select("n", "columns").rdd.treeAggregate(zero, add, merge, DEPTH)
    shared.destroy()
    means = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], 0)
    return [np.where(counts[p][:, None] > 0, means[p, :, : b.shape[1]], b) for p, b in enumerate(books)]


def fit(table: DataFrame, books: list[np.ndarray], edges: list[int], rounds: int = ROUNDS) -> list[np.ndarray]:
    for _ in range(rounds):
        books = improved(table, books, edges)
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def assign(table: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """vec_id, label, code (bytes, one a part) and error of every vector."""
    shared = table.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                columns = np.frombuffer(r["columns"], np.int32).reshape(edges[-1], r["n"])
                codes, error = np.zeros((r["n"], PARTS), np.uint8), np.zeros(r["n"], np.int64)
                for p, book in enumerate(shared.value):
                    code, distance = nearest(columns[edges[p] : edges[p + 1]], book)
                    codes[:, p] = code
                    error += distance
                schema = [("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.binary()), ("error", pa.int64())]
                yield rows(schema, np.frombuffer(r["ids"], np.int64), r["labels"], [c.tobytes() for c in codes], error)

    return table.mapInArrow(run, "vec_id long, label string, code binary, error long")


def compress(table: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes (vec_id, label, code, error) of all kept rows, and the codebooks."""
    spark = table.sparkSession
    vectors = valid(table)
    some = vectors.limit(1).select(F.size("vector").alias("n")).first()
    if some is None:
        return spark.createDataFrame([], "vec_id long, label string, code binary, error long"), []
    edges = bounds(some.n)
    stored = cut(blocks(vectors))
    books = fit(stored, start(vectors, edges), edges)
    return assign(stored, books, edges), books


def decode(codes: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    """The vectors that codes (vector x part) stand for."""
    return np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1) / SCALE


def summary(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    codes, books = compress(table)
    codes = codes.withColumn("same", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    if books:
        codes = cut(codes)
    labels = codes.groupBy("same").agg(F.sum("error").alias("label_error"), F.count("*").alias("times"))
    found = looked_up_by_size(codes, "same", labels, "times")
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def ratio(dims: int) -> float:
    """How many times smaller a code is than the vector's float components."""
    return 4 * dims / (PARTS * math.log2(ENTRIES) / 8)
