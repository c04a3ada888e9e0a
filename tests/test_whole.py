"""Pieces of whole merges against lists: groups of the same sound, and knockouts that measure only pairs that meet."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.test_operators import knocked_out
from tracklake.operators import delays, measuring, merging, whole
from tracklake.plans.queries import words_of


def test_files_of_the_same_sound(spark):
    rows = [
        (1, 1, "a", 0.5), (1, 1, "b", 0.5), (1, 2, "b", 0.25), (1, 2, "a", 0.25), (1, 3, "a", 0.0), (1, 4, "a", None), (1, 5, "a", 0.0), (1, 5, "a", 1.0), (1, 6, "", 0.0), (1, 7, "", 0.0), (1, 8, None, 0.0), (2, 1, "a", 0.0)]
    t = spark.createDataFrame(rows, "grp int, file long, md5 string, delay_s double")
    got = {(r.grp, r.file): (r.representative, r.delay_ms) for r in whole.same_sound(t).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 250), (1, 3): (3, 0), (1, 4): (3, 0), (1, 5): (5, 0), (1, 6): (6, 0), (1, 7): (7, 0), (1, 8): (8, 0), (2, 1): (1, 0)}
    forced = spark.createDataFrame([(1, 2)], "grp int, file long")
    got = {(r.grp, r.file): (r.representative, r.delay_ms) for r in whole.same_sound(t, forced).collect()}
    assert (got[1, 1], got[1, 2]) == ((2, -250), (2, 0))


def measured(spark, fits, asked):
    table = spark.createDataFrame([(*k, v) for k, v in fits.items()] or [(-1, 0, 0, 0)], "grp int, a long, b long, delay_ms long")

    def measure(pairs):
        asked.extend(tuple(r) for r in pairs.select("grp", "a", "b").collect())
        return pairs.select("grp", "a", "b").join(table, ["grp", "a", "b"], "left").selectExpr("grp", "a", "b", "delay_ms", "if(delay_ms is null, 'no', null) as reason")

    return measure


def test_knockout_measures_each_pair_that_meets_once(spark):
    r = random.Random(4)
    files, fits, want_edges, want_out = [], {}, set(), set()
    for g in range(8):
        names = list(range(r.randrange(1, 6)))
        score = {x: r.randrange(3) for x in names}
        files += [(g, x, float(score[x])) for x in names]
        good = {(a, b) for a in names for b in names if a < b and r.random() < 0.6}
        fits |= {(g, a, b): 10 * a + b for a, b in good}
        edges, out = knocked_out(names, {p: score[p[0]] >= score[p[1]] for p in good})
        want_edges |= {(g, *e) for e in edges}
        want_out |= {(g, x) for x in out}
    asked = []
    edges, tried, done = whole.knockout(spark.createDataFrame(files, "grp int, name long, score double"), measured(spark, fits, asked))
    assert {(x.grp, x.winner, x.loser) for x in edges.collect()} == want_edges
    assert {tuple(x) for x in merging.left_over(done, edges).collect()} == want_out
    assert len(asked) == len(set(asked)) == tried.count()
    assert len(asked) < sum(n * (n - 1) // 2 for n in (sum(f[0] == g for f in files) for g in range(8)))


def test_forced_winner_meets_all(spark):
    files = spark.createDataFrame([(1, x, 0.0) for x in (1, 2, 3, 4)], "grp int, name long, score double")
    forced = spark.createDataFrame([(1, 3)], "grp int, file long")
    asked = []
    edges, tried, done = whole.star(files, forced, measured(spark, {(1, 1, 3): 5, (1, 3, 4): -5}, asked))
    assert sorted(asked) == [(1, 1, 3), (1, 2, 3), (1, 3, 4)]
    assert {(r.winner, r.loser) for r in edges.collect()} == {(3, 1), (3, 4)}
    assert {r.name for r in done.collect()} == {2, 3}


def test_words_of_long_and_torn_sound(spark):
    """Words of more octets than a piece holds, with places missing, against plain sums."""
    r = random.Random(2)
    rows = [(k, n, r.uniform(-1, 1)) for k, ends in (("a", range(3, 9000)), ("b", range(4080, 4140)), ("c", range(10))) for n in ends if not (k == "a" and 4200 <= n < 4260)]
    octets = {}
    for k, n, v in rows:
        octets[k, n // 8] = octets.get((k, n // 8), 0) + ((1 << n % 8) if v > 0 else 0)
    want = {(k, q, sum(octets[k, q + i] << 8 * i for i in range(4))) for k, q in octets if all((k, q + i) in octets for i in range(4))}
    assert {tuple(x) for x in words_of(spark.createDataFrame(rows, "key string, n long, value double").repartition(5), ["key"]).collect()} == want


def test_only_sound_in_reach_is_measured(spark, monkeypatch):
    """A long recording: what meets in a round is the grid and what delays may reach, and the decision is that of the whole."""
    r = np.random.default_rng(6)
    sound = r.normal(size=20_000)
    rows = [(1, file, file, n, float(v)) for file, late in ((1, 0), (2, 80)) for n, v in enumerate(sound, late)]
    samples = spark.createDataFrame(rows, "grp long, file long, ord long, n long, value double")
    grid = spark.createDataFrame([(1, k, float(b), 8.0) for k, b in enumerate((20, 29, 38))], "grp long, segment long, begin_s double, length_s double")
    sounds = whole.Sounds(words_of(samples, ["grp", "file", "ord"]), samples, grid, 8.0, 64.0)
    pairs = spark.createDataFrame([(7, 1, 1, 2)], "match long, grp long, a long, b long")
    tracks = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "grp long, file long, ord long")
    near, all_ = whole.heard(sounds, pairs, tracks), whole.heard(sounds, pairs, tracks, True)
    assert all_.samples.count() == 40_000
    least, most, n = near.samples.agg(F.min("n"), F.max("n"), F.count("*")).first()
    assert (20 - 17) * 64 - 3 < least <= (20 - 17) * 64 and (46 + 17) * 64 <= most < (46 + 17) * 64 + 3 and n == 2 * (most - least + 1)
    asked, plain = [], delays.summary
    monkeypatch.setattr(delays, "summary", lambda *a, **k: (asked.append(1), plain(*a, **k))[1])
    got = [tuple(x) for x in measuring.decided(near).collect()]
    assert len(asked) <= 3  # each round of words is summed up once
    assert got == [tuple(x) for x in measuring.decided(all_).collect()] == [(7, 1250, 1250.0, None)]
