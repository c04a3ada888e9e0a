"""Quality by importance resampling.

Two generative models over `BUCKETS` hashed word n-grams (one and two words, lower case) are fitted:
one to target texts (labelled good), one to all texts. A document's log weight is the log of the ratio of its
probabilities under the two models, i.e. the sum over its n-grams of the log ratio of their shares; a Gumbel draw
from a hash of doc_id is added to it, and the top k documents by that sum are a sample without replacement by weight.

k is the share of good texts among the labelled ones, times the number of documents, unless given.
The target is fitted to at most about `SAMPLE` labelled documents chosen by a hash of doc_id; the
counts of all texts, and k, cover all rows. Defined cases: a null text is empty; a text without words
has log weight 0; ties go to the smaller doc_id; without good labels both models are equal; repeated
rows are rows of their own (equal ones have equal keys, so a tie at the bar keeps all of that doc_id); an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import U, cut, mix, rows, slices, starts, utf8, words

BUCKETS, SAMPLE, NARROW = 16384, 20_000, 10_000


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of each n-gram, by text."""
    w, doc = words(*utf8(column))
    pair = mix(w[:-1] + mix(w[1:] + U(1)))[doc[:-1] == doc[1:]] if len(w) > 1 else w[:0]
    both = np.concatenate([w, pair])
    at = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]]) if len(w) > 1 else doc
    return at, (both % U(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The log ratio of target to all texts for each bucket."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    share = min(1.0, SAMPLE / max(1, good.count()))
    good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("good", F.lit(True))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), "doc_id", "left")  # about SAMPLE ids

    def run(batches):
        all_, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            doc, h = hashed(b.column("text"))
            all_ += np.bincount(h, minlength=BUCKETS)
            chosen = np.array([bool(x) for x in b.column("good").to_pylist()], bool)
            target += np.bincount(h[chosen[doc]], minlength=BUCKETS)
        some = np.flatnonzero(all_)
        yield rows([("h", pa.int64()), ("n", pa.int64()), ("t", pa.int64())], some, all_[some], target[some])

    found = marked.select("doc_id", "text", "good").mapInArrow(run, "h long, n long, t long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()  # a row a bucket
    n, t = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in found:
        n[r.h] += r.n
        t[r.h] += r.t
    return np.log(t / t.sum()) - np.log(n / n.sum()) if any(r.t for r in found) else np.zeros(BUCKETS)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = 11) -> DataFrame:
    """doc_id, log_weight and key."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS numbers

    def run(batches):
        for b in slices(batches):
            doc, h = hashed(b.column("text"))
            weight = np.bincount(doc, weights=shared.value[h], minlength=b.num_rows)
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            u = ((mix(mix(ids.astype(np.int64).view(np.uint64)) + U(seed)) >> U(11)).astype(np.float64) + 0.5) / (1 << 53)
            yield rows([("doc_id", pa.int64()), ("log_weight", pa.float64()), ("key", pa.float64())], ids, weight, weight - np.log(-np.log(u)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, log_weight double, key double")


def bar(keys: DataFrame, k: int) -> tuple[float, int]:
    """Key and doc_id of the k-th row by key (falling) and doc_id: histograms narrow the range until few rows are left."""
    r = keys.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    low, high, above = r.low, r.high, 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        width = (high - low) / 1024
        if inside.count() <= NARROW or low + width <= low:
            break
        slot = F.least(F.lit(1023), F.floor((F.col("key") - low) / width)).cast("int")
        for b in sorted(inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect(), key=lambda x: -x.slot):
            if above + b.n >= k:
                low, high = b.low, b.high
                break
            above += b.n
    last = inside.orderBy(F.desc("key"), "doc_id").limit(k - above).agg(F.min_by(F.struct("key", "doc_id"), F.struct("key", -F.col("doc_id"))).alias("x")).first().x
    return last.key, last.doc_id


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, key and kept for each document."""
    keys = cut(weigh(docs, fit(docs, labels)))
    total = keys.count()
    if k is None:
        r = labels.agg(F.avg((F.col("quality").eqNullSafe(1) & ~F.col("toxic").eqNullSafe(1)).cast("double")).alias("s")).first()
        k = round(total * (1.0 if r.s is None else r.s))
    if k <= 0 or k >= total:
        return keys.withColumn("kept", F.lit(k > 0))
    key, doc = bar(keys, k)
    return keys.withColumn("kept", (F.col("key") > key) | ((F.col("key") == key) & (F.col("doc_id") <= doc)))
