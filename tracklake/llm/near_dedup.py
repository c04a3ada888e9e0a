"""MinHash near-duplicates by an LSH forest.

Each distinct shingle set gets one signature of 64 minimum hashes. A tree of the forest is the list
of signatures sorted from another place on (rotations); texts alike stand next to each other there.
A region is a run of equal first values; its depth adapts: where a run is larger than `REGION`, a
deeper one is taken. Candidates are all pairs of a small region, the neighbours by longest common
prefix, and each member with the run's `LEADERS` most central ones (a base of many copies shares its values
with most of them, though the copies may be less alike to each other). Pairs that their signatures
rule out are left. Links are confirmed on the full shingle sets: first each text's with the most
central one it met, then those between texts that are not connected yet, so a group of n copies costs
about n confirmations. Runs that have more than `REGION` texts at `DEEP` values are then completed: runs
that share a text make a cluster, and in a cluster every link between texts that are still not connected is
found on the full sets. Where that is less work, texts meet only under their rarest shared shingles (a text
whose set must share 85 in 100 with another one's shares one of its rarest 16 in 100 with it; shingles of one component
alone can't be shared); else, in clusters of texts that are all nearly alike, blocks of texts are set against
blocks. So every pair that shares a run of `DEEP` values in a tree is tested, save those that their signatures rule
out (`SURE` standard deviations) in a small run.

Defined cases: null or empty text, or white space only: an empty set, linked with nothing. Equal
sets are linked. Repeated rows of a doc_id are one document if their texts agree; if they don't, each row has its
own n_shingles, its smallest set (by size, then hash) is the one that others are searched for, and all rows have one
component_id, the smallest found for any. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import U, cut, looked_up, mix, rows, shingles, slices, starts, text_only, tidied, utf8, words

VALUES, TREES, DEPTH, REGION, LEADERS, SALTS = 64, 16, 8, 24, 3, 32
DEEP, BLOCK, HELD, SURE = 4, 512, 200_000, 6
PLAIN = 1 << 26  # clusters of no more pairs than this meet in blocks without further ado
DEAR = 100  # a pair that is joined and confirmed by itself costs about as much as so many in a block
MULTIPLY = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)

SETS = "doc_id long, n long, fp1 long, fp2 long, sig binary"


def _sets(k: int):
    schema = [("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("sig", pa.binary())]

    def run(batches):
        for b in slices(batches):
            n = b.num_rows
            key = shingles(*words(*utf8(b.column("text"))), n, k)
            at = starts((key >> U(52)).astype(np.int64), n)
            count = np.diff(at)
            h = mix(key & U((1 << 52) - 1))
            full = np.flatnonzero(count)
            sig = np.zeros((n, VALUES), np.uint32)
            fp = np.zeros((2, n), np.uint64)
            if len(full):
                first = at[full]
                for i, m in enumerate(MULTIPLY):
                    sig[full, i] = np.minimum.reduceat((h * m) >> U(32), first)
                fp[0, full] = np.add.reduceat(h, first)
                fp[1, full] = np.add.reduceat(mix(h ^ U(0xA5A5A5A5A5A5A5A5)), first)
            yield rows(schema, b.column("doc_id").to_numpy(zero_copy_only=False), count, fp[0].view(np.int64), fp[1].view(np.int64), [x.tobytes() if c else None for x, c in zip(sig, count, strict=True)])

    return run


TREE = "tree int, " + ", ".join(f"s{i} int" for i in range(DEPTH)) + ", doc_id long, central long, bits binary"


def _trees(with_bits: bool):
    """One row for each tree of a signature; bits: a byte of each of its values."""
    schema = [("tree", pa.int32()), *((f"s{i}", pa.int32()) for i in range(DEPTH)), ("doc_id", pa.int64()), ("central", pa.int64()), ("bits", pa.binary())]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.int32).reshape(-1, VALUES)
            doc, central = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "central"))
            bits = [x.tobytes() for x in (sig & 255).astype(np.uint8)] if with_bits else [None] * len(sig)
            for t in range(TREES):
                s = np.roll(sig, -t * (VALUES // TREES), axis=1)[:, :DEPTH]
                yield rows(schema, np.full(len(sig), t), *s.T, doc, central, bits)

    return run


def _runs(b: pa.RecordBatch) -> np.ndarray:
    """How many first values each row of a sorted tree shares with the row before it."""
    s = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ["tree", *(f"s{i}" for i in range(DEPTH))]])
    same = np.cumprod(s[:, 1:] == s[:, :-1], axis=0).sum(axis=0) - 1
    return np.concatenate([[-1], same])


def _whole(batches):
    """Batches rearranged so that none but very long runs of the first two values are cut, and those only between runs of
    DEEP values, or in one that alone is so long (it is completed later)."""
    held: pa.RecordBatch | None = None
    for b in batches:
        if held is not None:
            b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            held = None
        lcp = _runs(b) if b.num_rows else np.zeros(0, int)
        k = max(np.flatnonzero(lcp < 2), default=0)
        if k == 0 and b.num_rows < HELD:
            held = b
            continue
        k = k or max(np.flatnonzero(lcp < DEEP), default=0)
        k = k or b.num_rows
        yield b.slice(0, k)
        held = b.slice(k) if k < b.num_rows else None
    if held is not None and held.num_rows:
        yield held


def _sizes(lcp: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's run at a depth, and the run's size."""
    run = np.cumsum(lcp < depth) - 1
    return run, np.bincount(run)[run]


LEVELS = (2, 4, 8)


RUN = ["tree", *(f"s{i}" for i in range(DEEP))]
CENTRAL = "doc_id long, c long, " + ", ".join(f"{c} int" for c in RUN)


def _centrality(batches):
    """doc_id, c: the sizes of a text's runs. With a tree: a piece of a run of DEEP values, its least doc_id and size;
    a run may go on in another batch or task, so the first and last piece of a batch are given out whatever their size."""
    schema = [("doc_id", pa.int64()), ("c", pa.int64()), *((c, pa.int32()) for c in RUN)]
    for b in _whole(batches):
        if not b.num_rows:
            continue
        lcp, doc = _runs(b), b.column("doc_id").to_numpy(zero_copy_only=False)
        sizes = [_sizes(lcp, level)[1] for level in LEVELS]  # the deep runs tell a base from copies that share most of it
        big = sizes[0] > 2
        if big.any():
            yield rows(schema, doc[big], sum(sizes)[big], *(pa.nulls(int(big.sum()), pa.int32()) for _ in RUN))
        head = np.flatnonzero(lcp < DEEP)
        size = np.diff(np.append(head, len(doc)))
        some = size > REGION
        some[[0, -1]] = True
        yield rows(schema, np.minimum.reduceat(doc, head)[some], size[some], *(b.column(c).to_numpy(zero_copy_only=False)[head[some]] for c in RUN))


def _candidates(percent: int):
    """Pairs a < b whose signatures don't rule the similarity out (SURE standard deviations below it, about one link
    in a thousand million); leader: the central one of the two, if the pair was met as such, and its centrality."""
    schema = [("a", pa.int64()), ("b", pa.int64()), ("leader", pa.int64()), ("central", pa.int64())]
    share = percent / 100
    least = math.floor(VALUES * share - SURE * math.sqrt(VALUES * share * (1 - share)))

    def run(batches):
        for b in _whole(batches):
            lcp, doc, central = _runs(b), *(b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "central"))
            bits = np.frombuffer(b"".join(b.column("bits").to_pylist()), np.uint8).reshape(-1, VALUES)
            out = []

            def alike(i, j):
                if not len(i):
                    return np.zeros(0, bool)
                return np.concatenate([(bits[i[s : s + 50_000]] == bits[j[s : s + 50_000]]).sum(axis=1) >= least for s in range(0, len(i), 50_000)])

            depth = np.full(len(doc), DEPTH + 1)
            for level in LEVELS:
                run_, size = _sizes(lcp, level)
                new = (size <= REGION) & (depth > DEPTH)
                depth[new] = level
                order = np.lexsort((doc, -central, run_))
                head = np.flatnonzero(np.concatenate([[True], np.diff(run_[order]) > 0]))
                ends = np.append(head[1:], len(order))
                for place in range(LEADERS):  # the most central of a run, and the next ones
                    lead = order[np.minimum(head + place, ends - 1)][run_]
                    some = np.flatnonzero((new | (size > REGION)) & (doc[lead] != doc))
                    some = some[alike(some, lead[some])]
                    out.append((doc[some], doc[lead[some]], doc[lead[some]], central[lead[some]]))
            far = None
            for k in range(1, REGION):
                far = lcp[1:].copy() if far is None else np.minimum(far[:-1], lcp[k:])  # far[i]: what rows i and i+k share
                i = np.flatnonzero((far >= depth[k:]) | ((k == 1) & (far >= 2)))
                if not len(i) and not (far >= 2).any():
                    break
                i = i[alike(i, i + k)]
                out.append((doc[i], doc[i + k], np.full(len(i), -1), np.zeros(len(i), np.int64)))
            x, y, leader, c = (np.concatenate([o[i] for o in out]) for i in range(4))
            keep = x != y
            if keep.any():
                yield rows(schema, np.minimum(x, y)[keep], np.maximum(x, y)[keep], [None if v < 0 else v for v in leader[keep].tolist()], c[keep])

    return run


def _links(k: int, percent: int):
    schema = [("a", pa.int64()), ("b", pa.int64())]

    def run(batches):
        for whole in batches:
            for b in slices([whole], "text_a", 1 << 19):
                for p in slices([b], "text_b", 1 << 19):
                    n = p.num_rows
                    sets = [shingles(*words(*utf8(p.column(c))), n, k) for c in ("text_a", "text_b")]
                    both = np.sort(np.concatenate(sets))
                    shared = both[1:][both[1:] == both[:-1]]
                    shared = np.bincount((shared >> U(52)).astype(np.int64), minlength=n)
                    total = sum(np.bincount((s >> U(52)).astype(np.int64), minlength=n) for s in sets) - shared
                    ok = (100 * shared >= percent * total) & (total > 0)
                    if ok.any():
                        yield rows(schema, *(p.column(c).to_numpy(zero_copy_only=False)[ok] for c in ("a", "b")))

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough. A text that many pairs have is copied to a few salts, not hot."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    met = looked_up(looked_up(pairs.select("a", "b"), "a", "b", a), "b", "a", b)
    return met.select("a", "b", "text_a", "text_b").mapInArrow(_links(k, percent), "a long, b long")


HUBS = 8


def salted(edges: DataFrame, low: DataFrame) -> DataFrame:
    """edges (u, v) joined with low (u, m). The edges of a node are dealt by HUBS salts, its row is copied to each: a few
    numbers a node, and no exchange more than a plain join has, which counts as there are many rounds."""
    every = low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HUBS - 1))))
    return edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(HUBS)).cast("int")).join(every, ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges (a, b).

    Rounds of large-star and small-star: every node is linked to the smallest of its neighbours,
    until nothing changes; the number of rounds grows with the logarithm of the longest chain. A node of many
    neighbours is dealt by salts.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = told(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted(large, low).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = cut(small)
        now = told(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now


def rooted(rows_: DataFrame, column: str, other: str, roots: DataFrame) -> DataFrame:
    """Adds root_<column>, the root of a column's node (itself where it has no link); the rows of a node are dealt by another column."""
    every = roots.select(F.col("node").alias(column), F.col("root").alias("_root"), F.explode(F.sequence(F.lit(0), F.lit(HUBS - 1))).alias("_salt"))
    both = rows_.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(HUBS)).cast("int")).join(every, [column, "_salt"], "left")
    return both.withColumn(f"root_{column}", F.coalesce("_root", column)).drop("_salt", "_root")


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, root) after the links more (a, b) are added: only the graph of the roots that they join is worked on."""
    ends = rooted(rooted(more.select("a", "b"), "a", "b", roots), "b", "a", roots)
    over = cut(components(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))))
    old = roots.select("node", F.col("root").alias("top"))
    new = over.select("node").join(roots.select("node"), "node", "left_anti").select("node", F.col("node").alias("top"))  # nodes that had no link before
    return cut(rooted(old.union(new), "top", "node", over).select("node", F.col("root_top").alias("root")))


def _keys(k: int):
    """The shingles of each text, eight bytes each."""
    schema = [("doc_id", pa.int64()), ("keys", pa.binary())]

    def run(batches):
        for b in slices(batches):
            n = b.num_rows
            key = shingles(*words(*utf8(b.column("text"))), n, k)
            at = starts((key >> U(52)).astype(np.int64), n)
            key &= U((1 << 52) - 1)
            yield rows(schema, b.column("doc_id").to_numpy(zero_copy_only=False), [key[i:j].tobytes() for i, j in zip(at, at[1:])])

    return run


def _between(percent: int):
    """Links between the two sides of a block; of those between the same two components one is enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        doc, root, left = (table.column(c).to_numpy() for c in ("doc_id", "root", "left"))
        keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        count = np.array([len(x) for x in keys])
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        _, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[at]
        row = np.repeat(np.arange(len(keys)), count)[column >= 0]
        column = column[column >= 0]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(x), len(y)), np.int64)
        wide = 4096
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            i, j = np.searchsorted(column, (c, c + wide))
            part = np.zeros((len(keys), wide), np.float32)
            part[row[i:j], column[i:j] - c] = 1
            shared += (part[x] @ part[y].T).astype(np.int64)
        ok = (100 * shared >= percent * (count[x][:, None] + count[y] - shared)) & (root[x][:, None] != root[y])
        i, j = np.nonzero(ok)
        if not len(i):
            return schema.empty_table()
        i, j = x[i], y[j]
        _, one = np.unique(np.stack([np.minimum(root[i], root[j]), np.maximum(root[i], root[j])]), axis=1, return_index=True)
        i, j = i[one], j[one]
        return pa.table([np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])], schema=schema)

    return run


def split_up(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (cluster, doc_id, root) of the clusters that have several components, and those clusters' sizes.

    sizes: cluster, n, top (texts of the largest component), main (its root).
    """
    m = rooted(members, "doc_id", "cluster", roots).withColumnRenamed("root_doc_id", "root")
    n = m.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    n = cut(n.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("root", F.struct("n", -F.col("root"))).alias("main")).where("n > top"))
    return looked_up(m, "cluster", "doc_id", n.select("cluster")).select("cluster", "doc_id", "root"), n


def _spelled(batches):
    """A row for each shingle of each text."""
    schema = [("cluster", pa.int64()), ("doc_id", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("key", pa.int64())]
    for b in slices(batches, "keys"):
        raw = b.column("keys").to_pylist()
        count = np.array([len(x) // 8 for x in raw])
        own = [np.repeat(b.column(c).to_numpy(zero_copy_only=False), count) for c in ("cluster", "doc_id", "root")]
        yield rows(schema, *own, np.repeat(count, count), np.frombuffer(b"".join(raw), np.int64))


def rarest(m: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """The shingles under which a text must meet any other component's text that is alike enough: cluster, key, doc_id, root, n.

    Of a text's n shingles a like one has at least `percent` in 100. In the order of how many texts of the cluster have
    them, one of the first n - that + 1 is shared; those that one component alone has come first of all and drop out.
    """
    spelled = m.join(keys, "doc_id").select("cluster", "doc_id", "root", "keys").mapInArrow(_spelled, "cluster long, doc_id long, root long, n long, key long")
    spelled = cut(spelled).withColumn("at", F.struct("cluster", "key"))
    shared = spelled.groupBy("at").agg(F.count("*").alias("f"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("at", "f")
    met = looked_up(spelled, "at", "doc_id", shared)
    w = Window.partitionBy("doc_id")
    need = F.ceil(F.col("n") * percent / 100)
    placed = met.withColumns({"place": F.row_number().over(w.orderBy("f", "key")), "all": F.count("*").over(w)})
    return placed.where(F.col("place") <= F.col("all") - need + 1).select("cluster", "key", "doc_id", "root", "n")


def under_rarest(prefix: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest shingles and aren't too unequal in size."""
    size = prefix.groupBy("cluster", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    rows_ = looked_up(prefix.withColumn("at", F.struct("cluster", "key")), "at", "doc_id", size.select(F.struct("cluster", "key").alias("at"), "salts"))
    x = rows_.select("at", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), F.col("doc_id").alias("a"), F.col("root").alias("root_a"), F.col("n").alias("n_a"))
    y = rows_.select("at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("doc_id").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"))
    fits = (F.col("root_a") != F.col("root_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return x.join(y, ["at", "salt"]).where("a < b").where(fits).select("a", "b").distinct()


def cheap(prefix: DataFrame, n: DataFrame) -> DataFrame:
    """The clusters in which meeting under rare shingles costs less than meeting in blocks."""
    own = prefix.groupBy("cluster", "key", "root").agg(F.count("*").alias("g"))
    cost = own.groupBy("cluster", "key").agg(((F.pow(F.sum("g"), F.lit(2)) - F.sum(F.col("g") * F.col("g"))) / 2).alias("pairs")).groupBy("cluster").agg(F.sum("pairs").alias("pairs"))
    return n.join(cost, "cluster", "left").where(F.coalesce("pairs", F.lit(0)) * DEAR <= (F.col("n") - F.col("top")) * F.col("n")).select("cluster")


def between(m: DataFrame, n: DataFrame, keys: DataFrame, percent: int, anchors: bool) -> DataFrame:
    """Links between the components of each cluster. All texts out of a cluster's largest component meet all its texts;
    anchors: one block of a cluster of several blocks meets all its texts instead."""
    blocks = F.ceil(F.col("n") / BLOCK)
    if anchors:
        n = n.where(F.col("n") - F.col("top") > BLOCK)
    n = n.select("cluster", "main", blocks.alias("ys"), (F.lit(1) if anchors else F.ceil((F.col("n") - F.col("top")) / BLOCK)).alias("xs"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("ys"))
    m = cut(looked_up(m, "cluster", "doc_id", n).select("cluster", "doc_id", "root", "xs", "ys", block.alias("y"), (block == 0 if anchors else F.col("root") != F.col("main")).alias("out")))
    x = m.where("out").select("cluster", "doc_id", "root", F.lit(True).alias("left"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("xs")).alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("y"))
    y = m.select("cluster", "doc_id", "root", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("xs") - 1).cast("long"))).alias("x"), "y")
    return x.union(y).join(keys, "doc_id").groupBy("cluster", "x", "y").applyInArrow(_between(percent), "a long, b long")


def completed(members: DataFrame, roots: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """roots after all links within the clusters (members: cluster, doc_id) are found."""

    def added(more: DataFrame) -> None:
        nonlocal roots
        more = cut(more)
        if more.limit(1).count():
            roots = joined(roots, more)

    m, n = split_up(members, roots)
    if not n.limit(1).count():
        return roots
    m = cut(m)
    keys = texts.join(m.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_keys(k), "doc_id long, keys binary")
    keys = cut(keys.groupBy("doc_id").agg(F.min_by("keys", F.struct(F.length("keys"), "keys")).alias("keys")))  # of clashing texts the smallest set
    large = n.where((F.col("n") - F.col("top")) * F.col("n") > PLAIN)
    if large.limit(1).count():
        prefix = cut(rarest(looked_up(m, "cluster", "doc_id", large.select("cluster")), keys, percent))
        sparse = cut(cheap(prefix, large))
        added(confirmed(under_rarest(prefix.join(sparse, "cluster", "left_semi"), percent), texts, k, percent))
        members = cut(members.join(sparse, "cluster", "left_anti"))
    for anchors in (True, False) if large.limit(1).count() else (False,):  # a block of each first, where there is much to save
        m, n = split_up(members, roots)
        if n.limit(1).count():
            added(between(m, n, keys, percent, anchors))
    return roots


def dealt(trees: DataFrame, large: DataFrame) -> DataFrame:
    """The rows of the trees by ranges: a run of DEEP values is in one task, unless it is a large one, which is completed later."""
    marked = trees.join(large.select(*RUN, F.lit(True).alias("large")), RUN, "left")
    rest = [F.when(F.col("large"), F.col(f"s{i}")) for i in range(DEEP, DEPTH)]
    return marked.repartitionByRange(*RUN, *rest).select(*trees.columns)


@tidied
def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    sets = cut(text_only(docs).mapInArrow(_sets(k), SETS))
    # equal sets are dealt by a salt too, so that a large group of copies doesn't meet in one task
    equal = ["n", "fp1", "fp2"]
    full = sets.where("n > 0").select("doc_id", *equal, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"))
    least = full.groupBy(*equal, "salt").agg(F.min("doc_id").alias("least"))
    least = least.select(*equal, "salt", F.min("least").over(Window.partitionBy(*equal)).alias("rep"))  # at most SALTS rows a set
    classes = cut(full.join(least, [*equal, "salt"]).select("doc_id", "rep"))
    reps = sets.where("n > 0").join(classes.where("doc_id = rep").select("doc_id").distinct(), "doc_id").groupBy("doc_id").agg(F.min(F.struct("n", "fp1", "fp2", "sig")).alias("s")).select("doc_id", "s.*")
    texts = text_only(docs)
    order = ["tree", *(f"s{i}" for i in range(DEPTH))]

    plain = cut(reps.select("doc_id", "sig", F.lit(0).cast("long").alias("central")))
    sizes = cut(plain.mapInArrow(_trees(False), TREE).repartitionByRange(*order).sortWithinPartitions(*order, "doc_id").mapInArrow(_centrality, CENTRAL))
    large = cut(sizes.where("tree is not null").groupBy(*RUN).agg(F.sum("c").alias("size"), F.min("doc_id").alias("low")).where(F.col("size") > REGION))
    central = sizes.where("tree is null").groupBy("doc_id").agg(F.sum("c").alias("c"))
    ranked = plain.drop("central").join(central, "doc_id", "left").select("doc_id", "sig", F.coalesce("c", F.lit(0)).alias("central"))
    ordered = dealt(ranked.mapInArrow(_trees(True), TREE), large).sortWithinPartitions(*order, "doc_id")
    pairs = cut(ordered.mapInArrow(_candidates(percent), "a long, b long, leader long, central long"))
    member = F.when(F.col("leader") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    first = pairs.where("leader is not null").groupBy(member.alias("member")).agg(F.max_by("leader", F.struct("central", -F.col("leader"))).alias("leader"))
    first = first.select(F.least("member", "leader").alias("a"), F.greatest("member", "leader").alias("b")).distinct()
    roots = components(cut(confirmed(first, texts, k, percent)))
    left = rooted(rooted(pairs.select("a", "b").distinct(), "a", "b", roots), "b", "a", roots)
    left = cut(left.where("root_a <> root_b").select("a", "b"))
    more = cut(confirmed(left.join(first, ["a", "b"], "left_anti"), texts, k, percent))
    if more.limit(1).count():
        roots = joined(roots, more)
    if large.limit(1).count():
        together = plain.mapInArrow(_trees(False), TREE).select(*RUN, "doc_id").join(large, RUN)
        members = cut(components(together.select(F.col("doc_id").alias("a"), F.col("low").alias("b"))).select(F.col("node").alias("doc_id"), F.col("root").alias("cluster")))
        roots = completed(members, roots, texts, k, percent)
    merged = rooted(classes, "rep", "doc_id", roots).groupBy("doc_id").agg(F.min("root_rep").alias("component_id"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles")).join(merged, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.col("component_id") == F.col("doc_id"))
