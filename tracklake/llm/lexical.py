"""Ranked lexical search: TPUT (three-phase uniform threshold) over term-partitioned postings.

A pass over the texts counts them and their terms, a second one makes postings: for each run of documents of a task (a block
of at most `DOCS` documents and about `POSTINGS` postings) and each term a segment with the block's documents that have the
term and its impact in them, highest first. Only terms that some item has are kept (a bitmap of at most `BITS` bits tells, then
the terms themselves). Segments are dealt by term, and by runs of blocks, so that a frequent term's list is in many pieces.

1. The heads of all lists: the k highest impacts of each term. Their sums by document bound each item's k-th best score from
   below (t1).
2. An item with m lists can't miss a document whose entries all lie below t1 / m. Entries that reach this uniform threshold
   are fetched from every list and meet at the coordinator of their block, with the best impact that stayed behind in each
   segment. It adds them up for each item; a document's unseen lists give it at most what stayed behind. The k-th best of all
   sums so far bounds from below once more (t2), and documents that can't reach it go.
3. What the remaining documents have in the lists where they weren't seen is looked up in the postings, which makes their
   scores exact.

Items come in blocks of about `PAIRS` pairs of item and term (each is a pass over the postings, not over the texts); what is
broadcast is the pairs of one such block. A term is known by 64 bits of hash.

Terms are the maximal runs of letters and digits of ASCII and of all other characters, A-Z lower-cased. Defined cases: a null
or empty text has no terms and is not counted; texts of any length are read as a whole; rows without doc_id or item_id take no
part; repeated documents are documents of their own, of several texts under one item_id the smallest counts; equal scores go
to the smaller doc_id; items without terms or without a document that scores have no rows; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import cut, rows, slices, text_only, utf8, words

DOCS, POSTINGS, PAIRS, BITS = 1 << 15, 1 << 21, 1 << 18, 1 << 27
OUTSIDE = np.zeros(256, bool)
OUTSIDE[:128] = True
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

SEGMENTS = "term long, block long, n int, docs binary, impacts binary"
FOUND = "item long, block long, doc int, doc_id long, seen long, most long"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each term, and its text's number."""
    w, doc = words(*utf8(column), OUTSIDE)
    return w.view(np.int64), doc


def counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and all their terms."""

    def run(batches):
        n = total = 0
        for b in slices(batches):
            _, doc = terms(b.column("text"))
            n, total = n + len(np.unique(doc)), total + len(doc)
        yield rows([("n", pa.int64()), ("total", pa.int64())], [n], [total])

    r = docs.select("text").mapInArrow(run, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    return r.n or 0, r.total or 0


class Bitmap:
    """Which values of the last bits of a hash occur; no false negatives."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.int64(len(bits) * 8 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap(items: DataFrame) -> Bitmap:
    """Of all terms of the items: bytes are put together on the way, at most BITS / 8 of them."""
    total = counted(items)[1]
    size = 1 << min(BITS.bit_length() - 1, max(10, (16 * total).bit_length()))

    def run(batches):
        for b in slices(batches):
            at = np.unique(terms(b.column("text"))[0] & np.int64(size - 1))
            where, start = np.unique(at >> 3, return_index=True)
            bits = np.bitwise_or.reduceat(np.left_shift(1, at & 7), start) if len(at) else at
            yield rows([("at", pa.int64()), ("bits", pa.int64())], where, bits)

    bits = np.zeros(size // 8, np.uint8)
    for r in items.select("text").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
        bits[r["at"]] = r.bits
    return Bitmap(bits)


def postings(docs: DataFrame, wanted: Bitmap, n: int, total: int) -> tuple[DataFrame, DataFrame]:
    """Segments (term, block, n, docs, impacts) by term, and the documents of each block (block, ids)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)  # BITS / 8 bytes at most

    def flush(block, ids, parts):
        """All segments of a block, and under term null its documents by id."""
        doc, term, tf, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        ids = np.concatenate(ids)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        impact = (1_000_000_000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // total))
        doc = place[doc]
        by = np.lexsort((doc, -impact, term))
        doc, term, impact = doc[by].astype(np.uint16), term[by], impact[by].astype(np.uint32)
        start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(term))
        schema = [("term", pa.int64()), ("block", pa.int64()), ("n", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary())]
        yield rows(schema, [None], [block], [len(ids)], [ids[order].tobytes()], [None])
        for s in range(0, len(start), 4096):
            a, b = start[s : s + 4096].tolist(), end[s : s + 4096].tolist()
            yield rows(schema, term[start[s : s + 4096]], np.full(len(a), block), end[s : s + 4096] - start[s : s + 4096], [doc[x:y].tobytes() for x, y in zip(a, b, strict=True)], [impact[x:y].tobytes() for x, y in zip(a, b, strict=True)])

    def run(batches):
        block, ids, parts, held, many = TaskContext.get().partitionId() << 24, [], [], 0, 0
        for b in slices(batches):
            hashes, doc = terms(b.column("text"))
            size = np.bincount(doc, minlength=b.num_rows)
            on = shared.value.has(hashes)
            hashes, doc = hashes[on], doc[on]
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])])) if len(doc) else np.zeros(0, np.int64)
            if held and (held + b.num_rows > DOCS or many + len(first) > POSTINGS):
                yield from flush(block, ids, parts)
                block, ids, parts, held, many = block + 1, [], [], 0, 0
            at = doc[first]
            parts.append((at + held, hashes[first], np.diff(np.append(first, len(doc))), size[at]))
            ids.append(b.column("doc_id").to_numpy().astype(np.int64))
            held, many = held + b.num_rows, many + len(first)
        if held:
            yield from flush(block, ids, parts)

    made = docs.select("doc_id", "text").mapInArrow(run, SEGMENTS)
    # a term's list is dealt by runs of 64 tasks' blocks, so its pieces grow in number with the table, not in size
    run_of = F.shiftright("block", 30)
    dealt = cut(made.withColumn("run", run_of).repartition("term", "run", F.when(F.col("term").isNull(), F.col("block"))).sortWithinPartitions("term", "block").drop("run"))
    return dealt.where("term is not null"), dealt.where("term is null").select("block", F.col("docs").alias("ids"))


class Asks:
    """A block of items: its pairs of item and term by term, with weights. Arrays only, of at most about PAIRS pairs."""

    def __init__(self, items: list[tuple[int, dict[int, int]]], df: dict[int, int], n: int):
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * f + 1))) for t, f in df.items()}
        pairs = sorted((t, i, k * weight[t]) for i, (_, own) in enumerate(items) for t, k in own.items() if weight.get(t, 0) > 0)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.term, self.item, self.weight = (np.array([p[x] for p in pairs], np.int64) for x in range(3))
        self.terms, self.start = np.unique(self.term, return_index=True)
        self.end = np.append(self.start[1:], len(self.term))
        self.lists = np.bincount(self.item, minlength=len(items))
        self.least = np.zeros(len(self.term), np.int64)  # the impact that reaches the uniform threshold, by pair

    def threshold(self, bound: np.ndarray) -> None:
        """Sets the uniform threshold of each item from the bound of its k-th best score: bound / lists."""
        self.bound = bound
        each = -(-bound // np.maximum(1, self.lists))
        self.least = -(-each[self.item] // self.weight)
        self.fetched = np.minimum.reduceat(self.least, self.start) if len(self.start) else self.least

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Where each hash stands among the terms, else -1."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, -1) if len(self.terms) else np.full(len(hashes), -1)


def ask_blocks(items: DataFrame, pairs: int) -> Iterator[list[tuple[int, dict[int, int]]]]:
    """Items with the number of times they have each term, in lists of about that many pairs."""
    out, held = [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        term, times = np.unique(terms(pa.array([r.text], pa.string()))[0], return_counts=True)
        if out and held + len(term) > pairs:
            yield out
            out, held = [], 0
        out.append((r.item_id, dict(zip(term.tolist(), times.tolist(), strict=True))))
        held += len(term)
    if out:
        yield out


def frequencies(segments: DataFrame, block: list[tuple[int, dict[int, int]]]) -> dict[int, int]:
    """How many documents have each of the block's terms that occur at all."""
    wanted = sorted(set().union(*(own for _, own in block)))
    if not wanted:
        return {}
    own = segments.sparkSession.createDataFrame([(t,) for t in wanted], "term long")  # at most about PAIRS
    return {r.term: r.df for r in segments.select("term", "n").join(F.broadcast(own), "term").groupBy("term").agg(F.sum("n").alias("df")).collect()}


def kth(sums: DataFrame, value: str, k: int, items: int) -> np.ndarray:
    """The k-th largest value of each item, 0 where there are fewer; one row an item comes back."""
    ranked = sums.withColumn("_r", F.row_number().over(Window.partitionBy("item").orderBy(F.desc(value)))).where(F.col("_r") <= k)
    out = np.zeros(items, np.int64)
    for r in ranked.where(F.col("_r") == k).select("item", F.col(value).alias("v")).collect():
        out[r.item] = r.v
    return out


def heads(segments: DataFrame, asks: Asks, k: int) -> np.ndarray:
    """Phase 1: a lower bound of each item's k-th best score from the k highest impacts of each list."""
    shared = segments.sparkSession.sparkContext.broadcast(asks)
    schema = [("term", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("impact", pa.int64())]

    def top(batches):
        for b in batches:
            at = shared.value.find(b.column("term").to_numpy())
            term, blocks, docs, impacts = [], [], [], []
            for i in np.flatnonzero(at >= 0).tolist():
                d = np.frombuffer(b.column("docs")[i].as_buffer(), np.uint16)[:k]
                docs.append(d)
                impacts.append(np.frombuffer(b.column("impacts")[i].as_buffer(), np.uint32)[:k])
                term.append(np.full(len(d), at[i]))
                blocks.append(np.full(len(d), b.column("block")[i].as_py()))
            if docs:
                yield rows(schema, *(np.concatenate(x) for x in (term, blocks, docs, impacts)))

    every = segments.select("term", "block", "docs", "impacts").mapInArrow(top, "term long, block long, doc int, impact long")
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact")))).where(F.col("_r") <= k).drop("_r")

    def spread(batches):
        a = shared.value
        for b in batches:
            term = b.column("term").to_numpy()
            times = a.end[term] - a.start[term]
            pair = np.repeat(a.start[term], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            value = np.repeat(b.column("impact").to_numpy(), times) * a.weight[pair]
            out = [("item", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("value", pa.int64())]
            yield rows(out, a.item[pair], np.repeat(b.column("block").to_numpy(), times), np.repeat(b.column("doc").to_numpy(), times), value)

    sums = first.mapInArrow(spread, "item long, block long, doc int, value long").groupBy("item", "block", "doc").agg(F.sum("value").alias("value"))
    return kth(sums, "value", k, len(asks.ids))


class Block:
    """The coordinator of one block of documents: what was fetched of its segments, added up for each item."""

    def __init__(self, block: int, ids: np.ndarray):
        self.block, self.ids, self.lists = block, ids, {}

    def see(self, at: int, docs: np.ndarray, impacts: np.ndarray, rest: int) -> None:
        self.lists[at] = docs, impacts, rest

    def candidates(self, a: Asks, by_item: list[np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
        """item, block, doc, doc_id, seen (the sum so far) and most (what it can become at most).

        Given are the documents that may still be among the item's k best: of those whose sum is complete the first k,
        of the others all that can reach the bound or the k-th best sum of this block.
        """
        schema = [("item", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("seen", pa.int64()), ("most", pa.int64())]
        out = []
        for item, pairs in enumerate(by_item):
            seen, more = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
            slack, any_ = 0, False
            for p, at in pairs:
                if at not in self.lists:
                    continue
                docs, impacts, rest = self.lists[at]
                # impacts fall: what this item fetches of the list ends where they drop below its threshold
                end = len(impacts) - int(np.searchsorted(impacts[::-1], a.least[p]))
                behind = int(impacts[end]) if end < len(impacts) else rest
                d = docs[:end]
                seen[d] += a.weight[p] * impacts[:end].astype(np.int64)
                if behind:
                    slack += int(a.weight[p]) * behind
                    more[d] -= int(a.weight[p]) * behind
                any_ |= end > 0
            if not any_:
                continue
            most = seen + more + slack
            known = seen > 0
            bar = max(int(a.bound[item]), int(np.partition(seen, -k)[-k]) if len(seen) > k else 0)
            on = np.flatnonzero(known & (most >= bar))
            whole = most[on] == seen[on]
            done = on[whole]
            done = done[np.lexsort((done, -seen[done]))][:k]
            on = np.concatenate([done, on[~whole]])
            out.append((np.full(len(on), item), np.full(len(on), self.block), on, self.ids[on], seen[on], most[on]))
            if len(out) >= 256:
                yield rows(schema, *(np.concatenate(x) for x in zip(*out, strict=True)))
                out = []
        if out:
            yield rows(schema, *(np.concatenate(x) for x in zip(*out, strict=True)))


def fetched(segments: DataFrame, ids: DataFrame, asks: Asks, k: int) -> DataFrame:
    """Phase 2: what reaches the uniform thresholds, added up by the coordinators of the blocks."""
    shared = segments.sparkSession.sparkContext.broadcast(asks)
    schema = [("block", pa.int64()), ("at", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("rest", pa.int64())]

    def fetch(batches):
        for b in batches:
            at = shared.value.find(b.column("term").to_numpy())
            on = np.flatnonzero(at >= 0).tolist()
            docs, impacts, rest = [], [], []
            for i in on:
                v = np.frombuffer(b.column("impacts")[i].as_buffer(), np.uint32)
                end = len(v) - int(np.searchsorted(v[::-1], shared.value.fetched[at[i]]))
                docs.append(b.column("docs")[i].as_buffer()[: 2 * end].to_pybytes())
                impacts.append(v[:end].tobytes())
                rest.append(int(v[end]) if end < len(v) else 0)
            if on:
                yield rows(schema, b.column("block").to_numpy()[on], at[on], docs, impacts, rest)

    def coordinate(batches):
        a, held = shared.value, None
        by_item = [[] for _ in a.ids]
        for at, (s, e) in enumerate(zip(a.start.tolist(), a.end.tolist(), strict=True)):
            for p in range(s, e):
                by_item[a.item[p]].append((p, at))
        for b in batches:
            for r in b.to_pylist():
                if r["at"] < 0:
                    if held is not None:
                        yield from held.candidates(a, by_item, k)
                    held = Block(r["block"], np.frombuffer(r["docs"], np.int64))
                else:
                    held.see(r["at"], np.frombuffer(r["docs"], np.uint16), np.frombuffer(r["impacts"], np.uint32), r["rest"])
        if held is not None:
            yield from held.candidates(a, by_item, k)

    got = segments.select("term", "block", "docs", "impacts").mapInArrow(fetch, "block long, at int, docs binary, impacts binary, rest long")
    own = ids.select("block", F.lit(-1).alias("at"), F.col("ids").alias("docs"), F.lit(None).cast("binary").alias("impacts"), F.lit(0).cast("long").alias("rest"))
    return own.unionByName(got).repartition("block").sortWithinPartitions("block", "at").mapInArrow(coordinate, FOUND)


def looked_up_scores(segments: DataFrame, open_: DataFrame, asks: Asks) -> DataFrame:
    """Phase 3: item, doc_id and exact score of documents whose sums aren't complete, from the postings.

    open_: item, block, doc, doc_id. For each of an item's terms a lookup meets the segment of term and block.
    """
    shared = segments.sparkSession.sparkContext.broadcast(asks)

    def want(batches):
        a = shared.value
        by_item = [np.flatnonzero(a.item == i) for i in range(len(a.ids))]
        schema = [("term", pa.int64()), ("block", pa.int64()), ("item", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("weight", pa.int64())]
        for b in batches:
            pairs = [by_item[i] for i in b.column("item").to_pylist()]
            times = [len(p) for p in pairs]
            pair = np.concatenate([*pairs, np.zeros(0, np.int64)]).astype(np.int64)
            again = [np.repeat(b.column(c).to_numpy(), times) for c in ("block", "item", "doc", "doc_id")]
            yield rows(schema, a.term[pair], *again, a.weight[pair])

    def look(batches):
        schema = [("item", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int64()), ("doc", pa.int32()), ("score", pa.int64())]
        at, segment, impact = None, None, np.zeros(1 << 16, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            term, block = b.column("term").to_numpy(), b.column("block").to_numpy()
            is_list = b.column("item").is_null().to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], is_list[1:] | is_list[:-1] | (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
            for s, e in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
                if is_list[s]:
                    at = term[s], block[s]
                    segment = np.frombuffer(b.column("docs")[s].as_buffer(), np.uint16).copy(), np.frombuffer(b.column("impacts")[s].as_buffer(), np.uint32).copy()
                elif at == (term[s], block[s]):
                    if segment is not None:  # the first lookup here
                        impact[:] = 0
                        impact[segment[0]] = segment[1]
                        segment = None
                    c = b.slice(s, e - s)
                    value = impact[c.column("doc").to_numpy()] * c.column("weight").to_numpy()
                    yield rows(schema, c.column("item"), c.column("doc_id"), c.column("block"), c.column("doc"), value)

    none = F.lit(None)
    asked = open_.mapInArrow(want, "term long, block long, item long, doc int, doc_id long, weight long").withColumns({"docs": none.cast("binary"), "impacts": none.cast("binary")})
    lists = segments.select("term", "block", none.cast("long").alias("item"), none.cast("int").alias("doc"), none.cast("long").alias("doc_id"), none.cast("long").alias("weight"), "docs", "impacts")
    met = lists.unionByName(asked).repartition("term", "block").sortWithinPartitions("term", "block", F.col("item").asc_nulls_first())
    parts = met.mapInArrow(look, "item long, doc_id long, block long, doc int, score long")
    return parts.groupBy("item", "doc_id", "block", "doc").agg(F.sum("score").alias("score")).select("item", "doc_id", "score")


def searched(segments: DataFrame, ids: DataFrame, block: list[tuple[int, dict[int, int]]], n: int, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of items."""
    spark = segments.sparkSession
    asks = Asks(block, frequencies(segments, block), n)
    asks.threshold(heads(segments, asks, k))
    found = cut(fetched(segments, ids, asks, k))
    bars = kth(found, "seen", k, len(asks.ids)).tolist()
    bar = spark.createDataFrame(list(enumerate(bars)), "item long, bar long")  # a row an item
    left = found.join(F.broadcast(bar), "item").where("most >= bar")
    exact = left.where("most = seen").select("item", "doc_id", F.col("seen").alias("score"))
    scores = exact.unionByName(looked_up_scores(segments, left.where("most > seen").select("item", "block", "doc", "doc_id"), asks))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(asks.ids.tolist())), "item long, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, pairs: int = PAIRS) -> DataFrame:
    """The k best documents of each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    docs, items = text_only(docs), text_only(items, "item_id").groupBy("item_id").agg(F.min("text").alias("text"))
    n, total = counted(docs)
    out = spark.createDataFrame([], RESULT)
    if not n:
        return out
    segments, ids = postings(docs, bitmap(items), n, total)
    for block in ask_blocks(items, pairs):
        out = out.unionByName(searched(segments, ids, block, n, k))
    return out
