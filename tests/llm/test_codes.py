"""Vector codes against plain Python integers, and what codes give back."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import SF
from tests.oracle import connect, same
from tracklake.llm import codes, entry

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, n int"


def plain(rows, rounds=6):
    """rows: (vec_id, vector, label); all by Python integers, one vector and one component after another."""
    kept = sorted((r for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], list(r[1])))
    if not kept:
        return [], ""
    dims = len(kept[0][1])
    edges = codes.bounds(dims)
    x = [[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in kept]
    books = [[v[s:e] for v in x[:16]] for s, e in zip(edges, edges[1:], strict=False)]

    def near(part, book):
        gaps = [sum((a - b) ** 2 for a, b in zip(part, y, strict=True)) for y in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            members = defaultdict(list)
            for v in x:
                members[near(v[s:e], books[p])[0]].append(v[s:e])
            books[p] = [[sum(c) // len(members[i]) for c in zip(*members[i], strict=True)] if i in members else y for i, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for y in b for c in y).encode()).hexdigest()
    out, errors = [], defaultdict(int)
    for r, v in zip(kept, x, strict=True):
        found = [near(v[s:e], books[p]) for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
        error = sum(f[1] for f in found)
        errors[r[2]] += error
        out.append((r[0], "".join(f"{f[0]:02x}" for f in found), error, r[2]))
    return sorted((i, c, e, errors[label], sha) for i, c, e, label in out), sha


def vectors(n, dims, seed=3):
    r = random.Random(seed)
    out = [(i * 3, [r.gauss(0, 0.3) for _ in range(dims)], r.choice([0, 0, 0, 1, None])) for i in range(n)]
    out += [(n * 3, None, 1), (n * 3 + 1, [], 1), (1, [0.5] * (dims - 1) + [None], 2), (2, [float("nan")] * dims, 2), (4, [float("inf")] * dims, None)]
    out += [(0, [0.25] * dims, 1), (0, [0.25] * dims, 1), (5, [0.0] * dims, None), (None, [1.0] * dims, 1)]
    r.shuffle(out)
    return out


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def made(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1, 2) for i, v, label in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize(("n", "dims"), [(400, 16), (60, 19), (9, 8)])
def test_plain(spark, n, dims):
    rows = vectors(n, dims)
    assert got(codes.summary(made(spark, rows))) == plain(rows)[0]


def test_other_lengths_are_dropped(spark):
    rows = vectors(50, 8)
    assert got(codes.summary(made(spark, [*rows, (7000, [1.0] * 9, 0), (7001, [2.0], 0)]))) == plain(rows)[0]


def test_partitions_and_blocks_change_nothing(spark, monkeypatch):
    table = made(spark, vectors(300, 16))
    once = got(codes.summary(table.coalesce(1)))
    monkeypatch.setattr(codes, "BLOCK", 7)
    assert got(codes.summary(table.repartition(13))) == once


def test_wide_components_are_limited(spark):
    rows = [(i, [3e38, -3e38] + [float(i)] * 6, 0) for i in range(20)]
    found = codes.summary(made(spark, rows))
    assert found.count() == 20 and found.where("error < 0").count() == 0


def test_empty(spark):
    assert got(codes.summary(made(spark, []))) == []
    assert got(codes.summary(made(spark, [(1, None, 1)]))) == []


def test_sql(spark):
    same(entry.QUERIES["op12_vector_codes"](spark, SF), connect(SF), entry.ORACLE["op12_vector_codes"])


def test_codes_stand_for_their_vectors(spark):
    """What a code decodes to is off by the row's error, and the rounds make the errors smaller."""
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    found, books = codes.compress(table)
    rows = {r.vec_id: r.embedding for r in table.collect()}
    found = found.collect()
    x = codes.integers(np.array([rows[r.vec_id] for r in found]))
    back = codes.decode(np.array([list(r.code) for r in found]), books) * codes.SCALE
    assert ((back - x) ** 2).sum(axis=1).tolist() == [r.error for r in found]
    edges = codes.bounds(x.shape[1])
    first = codes.start(codes.valid(table), edges)
    before = sum(codes.nearest(x[:, s:e].T, first[p])[1].sum() for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False)))
    assert sum(r.error for r in found) < 0.8 * before
    assert codes.ratio(64) == 64 and len(books) == 8
