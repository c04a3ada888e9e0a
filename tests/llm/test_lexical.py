"""Ranked lexical search against plain Python, with small blocks, many pieces, ties and odd rows."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.test_llm import SF, UPPER, texts
from tests.oracle import connect, same
from tracklake.llm import entry, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=20):
    own = [(i, Counter(split(t))) for i, t in docs if i is not None]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    by_item = {}
    for i, t in items:
        if i is not None:
            by_item[i] = min(by_item.get(i, t or ""), t or "")
    out = []
    for i, text in by_item.items():
        scores = []
        for d, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            score = sum(k2 * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k2 in Counter(split(text)).items() if t in c)
            if score > 0:
                scores.append((-score, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


def frame(spark, rows, key, parts=4):
    return spark.createDataFrame([(i, t, 3, 1, 2, 9) for i, t in rows], f"{key} long, text string, n long, item long, block long, score long").repartition(parts)


@pytest.fixture(scope="module")
def case():
    some = texts(n=90)
    docs = [(i * 5 % 2003, t) for i, t in enumerate(some)] + [(5000 - i, "the hot copy e a of all") for i in range(150)] + [(7, "again a"), (7, "again a"), (None, "no id a e")]
    r = random.Random(1)
    items = [(i * 2, " ".join((t or "").split()[: r.randrange(0, 40)])) for i, t in enumerate(r.sample(some, 30))]
    items += [(1001, "hot copy"), (1003, "nothing-matches-zzz"), (1005, None), (1007, "a A a e"), (1009, "!! ..."), (None, "a"), (1011, "b first"), (1011, "a first"), (1013, "😀 日本語 été x")]
    return docs, items


def test_plain(spark, case):
    docs, items = case
    assert got(lexical.search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"))) == plain(docs, items)


@pytest.mark.parametrize(("docs_", "postings", "pairs", "parts"), [(16, 100, 40, 9), (5, 1 << 21, 7, 1), (1 << 15, 50, 1 << 18, 23)])
def test_blocks_and_pieces_change_nothing(spark, case, monkeypatch, docs_, postings, pairs, parts):
    docs, items = case[0], case[1][::3] if pairs < 10 else case[1]
    monkeypatch.setattr(lexical, "DOCS", docs_)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    assert got(lexical.search(frame(spark, docs, "doc_id", parts), frame(spark, items, "item_id"), k=5, pairs=pairs)) == plain(docs, items, 5)


def test_thresholds_leave_lists_unread_and_lookups_complete_scores(spark, monkeypatch):
    """Rare terms carry the score, so the uniform threshold cuts the lists of frequent ones."""
    r = random.Random(9)
    docs = [(i, " ".join(["common", *r.choices(["usual", "often", "much"], k=r.randrange(1, 30)), *([f"rare{r.randrange(8)}"] if i % 40 == 0 else [])])) for i in range(800)]
    items = [(1, "common usual rare0 rare1 rare2 rare3 rare4 rare5"), (2, "usual often much common rare7")]
    seen = []
    real = lexical.looked_up_scores
    monkeypatch.setattr(lexical, "DOCS", 100)
    monkeypatch.setattr(lexical, "looked_up_scores", lambda s, o, a: (seen.append((o.count(), a.least.max())), real(s, o, a))[1])
    assert got(lexical.search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), k=3)) == plain(docs, items, 3)
    assert seen[0][0] > 0 and seen[0][1] > 0


def test_terms_and_bitmap(spark):
    column = pa.array(["A-b c3_D", None, "", "É日x\x00y"])
    w, doc = lexical.terms(column)
    assert doc.tolist() == [0, 0, 0, 0, 3, 3] and len(set(w.tolist())) == 6
    items = frame(spark, [(1, "one two three"), (2, "three FOUR")], "item_id")
    bits = lexical.bitmap(items)
    assert bits.has(lexical.terms(pa.array(["one TWO three four"]))[0]).all()
    others = lexical.terms(pa.array([" ".join(f"w{i}" for i in range(500))]))[0]
    assert bits.has(others).mean() < 0.1


def test_empty(spark, case):
    docs, items = case
    assert got(lexical.search(frame(spark, [], "doc_id", 1), frame(spark, items, "item_id"))) == []
    assert got(lexical.search(frame(spark, docs, "doc_id"), frame(spark, [], "item_id", 1))) == []
    assert got(lexical.search(frame(spark, [(1, "only")], "doc_id", 1), frame(spark, [(1, "only")], "item_id", 1))) == plain([(1, "only")], [(1, "only")])


def test_sql(spark):
    same(entry.QUERIES["op11_lexical_search"](spark, SF), connect(SF), entry.ORACLE["op11_lexical_search"])
