"""Nearest neighbours by randomly rotated one-bit codes.

Each vector, less the mean, is divided by its length, turned by a random orthonormal map into `WIDE` times as many
dimensions and kept as one bit a dimension with two correction scalars: its length and the inner product of the unit
vector with its code. The inner product with a query is estimated from the bits without bias; the error bound says how
far off it may be. Only vectors whose upper bound reaches the k-th best score so far (or the k-th best lower bound of
the rows at hand) are reranked by the exact inner product of the original vectors in double precision.

Of equal vectors only the k + 1 smallest ids can be among a query's k nearest, so only these are searched. Queries are
dealt in parts, vectors with their codes in shards; a task streams a shard past a part's queries, reranks what the
bounds leave, and gives k rows a query. Those that the bounds leave grow with the table (on vectors without structure
they are a fixed share of it), so they are reranked where they are found and never shuffled.

The work is one pass over all codes for each query, as the queries are a fixed share of the rows; what is shuffled are
vectors x parts of `PART` queries, queries x shards, and k rows a query and shard.

Defined cases: vectors that are null, zero, or hold null, infinite or NaN components take no part, nor do those whose
length isn't the most frequent one (of equally frequent lengths the largest); ties go to the smaller id; of several
vectors under one id the smallest, component by component, counts; with fewer than k others all are given; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import blocks_for, cut, rows

PART, SHARD, LEAST_SHARD, CHUNK, PAIRS, WIDE, BOUND = 4096, 131_072, 4096, 1024, 65_536, 4, 3.0

CODES = "vec_id long, vector array<{0}>, code binary, norm double, fit double"


def valid(table: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part, once an id."""
    own = table.schema["embedding"].dataType.elementType.typeName()
    v = F.col("vector")
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    every = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if own == 'float' else 'double'}>").alias("vector")).where(sound & F.col("vec_id").isNotNull())
    common = every.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), F.desc("n")).first()
    return every.where(F.size("vector") == (common.n if common else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    """A random orthonormal map to WIDE times the dimensions, as rows."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((WIDE * dims, WIDE * dims)))
    return (q * np.sign(np.diag(r)))[:dims]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def center(vectors: DataFrame, dims: int) -> np.ndarray:
    """The mean vector: sums by task, then one row a dimension."""

    def run(batches):
        total = np.zeros(dims)
        n = 0
        for b in batches:
            x = matrix(b.column("vector"), dims)
            total += x.sum(axis=0)
            n += len(x)
        if n:
            yield rows([("pos", pa.int32()), ("total", pa.float64()), ("n", pa.int64())], np.arange(dims), total, np.full(dims, n))

    found = vectors.select("vector").mapInArrow(run, "pos int, total double, n long").groupBy("pos").agg((F.sum("total") / F.sum("n")).alias("mean")).collect()
    return np.array([r["mean"] for r in sorted(found, key=lambda r: r.pos)])


def encode(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Adds code, norm and fit to vec_id and vector."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"), len(mean)) - mean
            norm = np.linalg.norm(x, axis=1)
            o = (x / np.where(norm, norm, 1)[:, None]) @ turn
            fit = np.abs(o).sum(axis=1) / np.sqrt(o.shape[1])
            code = [c.tobytes() for c in np.packbits(o > 0, axis=1)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("vector"), pa.array(code, pa.binary()), pa.array(norm), pa.array(fit)], ["vec_id", "vector", "code", "norm", "fit"])

    return vectors.select("vec_id", "vector").mapInArrow(run, CODES.format(vectors.schema["vector"].dataType.elementType.typeName()))


class Search:
    """The queries of a part while a shard passes by; the k best of each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, mean: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.q, self.k, self.wide = ids, q, k, turn.shape[1]
        self.offset, self.turned, self.size = (q @ mean)[:, None], (q @ turn).astype(np.float32), np.linalg.norm(q, axis=1)[:, None]
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.reranked = 0

    def see(self, ids: np.ndarray, x: np.ndarray, code: list[bytes], norm: np.ndarray, fit: np.ndarray) -> None:
        bits = np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(ids), -1), axis=1, count=self.wide)
        fit = np.maximum(fit, 1e-9)
        estimate = self.offset + (self.turned @ (bits.astype(np.float32) * 2 - 1).T) * (norm / fit / np.sqrt(self.wide))
        error = self.size * (norm * np.sqrt(np.maximum(0, 1 - fit**2)) / fit * BOUND / np.sqrt(max(1, self.wide - 1))) + 1e-6 * self.size * (1 + norm)
        own = self.ids[:, None] == ids
        bar = self.score[:, -1]
        if len(ids) > self.k:
            bar = np.maximum(bar, np.partition(np.where(own, -np.inf, estimate - error), -self.k, axis=1)[:, -self.k])
        at, i = np.nonzero((estimate + error >= bar[:, None]) & ~own)
        self.reranked += len(at)
        score = np.concatenate([np.einsum("ij,ij->i", self.q[at[s : s + PAIRS]], x[i[s : s + PAIRS]]) for s in range(0, len(at), PAIRS)]) if len(at) else np.zeros(0)
        on = score >= self.score[at, -1]
        at, vec, score = at[on], ids[i[on]], score[on]
        some, start = np.unique(at, return_index=True)
        for q, s, e in zip(some.tolist(), start.tolist(), [*start[1:].tolist(), len(at)], strict=True):
            every, names = np.concatenate([self.score[q], score[s:e]]), np.concatenate([self.vec[q], vec[s:e]])
            best = np.lexsort((names, -every))[: self.k]
            self.score[q], self.vec[q] = every[best], names[best]


FOUND = "query_id long, vec_id long, score double"


def found(asked: DataFrame, base: DataFrame, dims: int, mean: np.ndarray, turn: np.ndarray, k: int) -> DataFrame:
    """The k best of each shard for each query: query_id, vec_id, score.

    asked: part, shard, vec_id, vector; base: part, shard, vec_id, vector, code, norm, fit.
    """
    schema = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]

    def run(batches):
        at, ids, vectors, search = None, [], [], None

        def done():
            if search is not None:
                on = search.score > -np.inf
                yield rows(schema, np.repeat(search.ids, on.sum(axis=1)), search.vec[on], search.score[on])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "shard", "kind")])
            edges = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:], strict=False):
                part, shard, kind = group[:, s].tolist()
                if (part, shard) != at:
                    yield from done()
                    at, ids, vectors, search = (part, shard), [], [], None
                b = batch.slice(s, e - s)
                if kind == 0:
                    ids.append(b.column("vec_id").to_numpy())
                    vectors.append(matrix(b.column("vector"), dims))
                    continue
                if not ids:
                    continue
                search = search or Search(np.concatenate(ids), np.concatenate(vectors), mean, turn, k)
                for i in range(0, b.num_rows, CHUNK):
                    c = b.slice(i, CHUNK)
                    search.see(c.column("vec_id").to_numpy(), matrix(c.column("vector"), dims), c.column("code").to_pylist(), c.column("norm").to_numpy(), c.column("fit").to_numpy())
        yield from done()

    none = F.lit(None)
    left = asked.select("part", "shard", F.lit(0).alias("kind"), "vec_id", "vector", none.cast("binary").alias("code"), none.cast("double").alias("norm"), none.cast("double").alias("fit"))
    right = base.select("part", "shard", F.lit(1).alias("kind"), "vec_id", "vector", "code", "norm", "fit")
    return left.union(right).repartition("part", "shard").sortWithinPartitions("part", "shard", "kind").mapInArrow(run, FOUND)


def nearest(table: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    spark = table.sparkSession
    vectors = cut(valid(table))
    some = vectors.limit(1).select(F.size("vector").alias("n")).first()
    if some is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    mean, turn = center(vectors, some.n), rotation(some.n)
    copies = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    base = cut(encode(vectors.withColumn("copy", copies).where(F.col("copy") <= k + 1), mean, turn))
    queries = vectors.where(F.col("vec_id") % every == 0)
    parts, n = blocks_for(queries, PART), base.count()
    # shards of SHARD rows, but smaller ones where there are few, so that all cores take part
    shards = max(-(-n // SHARD), min(-(-n // LEAST_SHARD), -(-2 * spark.sparkContext.defaultParallelism // parts)))
    dealt = lambda name, count: F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(count)).cast("int").alias(name)
    over = lambda name, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    asked = queries.select("vec_id", "vector", dealt("part", parts), over("shard", shards))
    best = found(asked, base.select("*", dealt("shard", shards), over("part", parts)), some.n, mean, turn, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
