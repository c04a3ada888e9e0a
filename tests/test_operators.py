"""Operators on small hand-made rows: golden cases, properties and edge cases."""

import functools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracklake.functions import scalars, signals
from tracklake.operators import catalog, correlation, cuts, delays, measuring, merging, routing, rules, selection, spread, subtitles, tracks
from tracklake.sources import metadata
from tracklake.streaming.episodes import EpisodeState, watch


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_rename(spark):
    t = F.lit("S {<episode>}.mkv")
    assert tuple(one(spark, scalars.renamed(t, F.lit(7)), scalars.renamed(t, F.lit(123)), scalars.renamed(F.lit("S.mkv"), F.lit(1)))) == ("S 07.mkv", "S 123.mkv", None)


def test_episode_validity(spark):
    rows = spark.createDataFrame([("0",), ("1a",), (None,), ("07",), ("9" * 30,)], "t string").select(scalars.valid_episode(F.col("t")).alias("v")).collect()
    assert [r.v for r in rows] == [False, False, False, True, False]


def test_grid(spark):
    rows = spark.createDataFrame([(1320.0,), (300.0,), (30.0,), (5.0,)], "d double").select(scalars.grid_begin(F.col("d")), scalars.grid_length(F.col("d"), 10)).collect()
    assert [tuple(r) for r in rows] == [(120, 98), (30, 23), (0, 29), (None, None)]


def test_shifted_begin(spark):
    rows = spark.createDataFrame([(120, 1500), (120, -1500), (1, -1500)], "b long, d long").select(*scalars.shifted_begin(F.col("b"), F.col("d"))).collect()
    assert [tuple(r) for r in rows] == [(121, 500), (118, 500), (None, None)]


def test_similarity_and_frames(spark):
    a = F.array(*(F.lit(x).cast("long") for x in (1, 2, 3)))
    b = F.array(*(F.lit(x).cast("long") for x in (1, 2, 2)))
    r = one(spark, scalars.bit_similarity(a, b), scalars.frame_aligned(F.lit(100.0), F.lit(25.0), F.lit(True)), scalars.frame_aligned(F.lit(100.0), F.lit(25.0), F.lit(False)))
    assert r[0] == pytest.approx(95 / 96) and r[1] == 80 and r[2] == 100


def test_tempo_chain(spark):
    for rate in (0.2, 0.9, 1.0, 3.0, 9.0):
        chain = one(spark, scalars.tempo_chain(F.lit(rate)))[0]
        assert np.prod(chain) == pytest.approx(rate) and all(0.5 <= x <= 2 for x in chain)


def test_rules_golden():
    assert rules.parse("a*1.1>b*2>c") == {("a", "b"): 1.1, ("b", "a"): False, ("a", "c"): pytest.approx(2.2), ("c", "a"): False, ("b", "c"): 2.0, ("c", "b"): False}
    assert rules.parse("A>B") == {("a", "b"): True, ("b", "a"): False}
    assert rules.parse("a*1.1>b,b*1>a") == {("a", "b"): 1.1, ("b", "a"): 1.0}
    assert rules.parse("a=b") == {}
    assert rules.parse("a>b,b>c,a>b")[("a", "c")] is True
    assert ("x", "x") not in rules.parse("x>y,y>z,z>x,x>y")  # a cycle ends


@given(st.lists(st.sampled_from(["a", "b", "c=d", "a*2", "e*6", "b*1.5"]), min_size=1, max_size=4), st.lists(st.sampled_from(["c", "d", "e"]), max_size=3))
@settings(max_examples=60, deadline=None)
def test_rules_never_beat_both_ways_always(x, y):
    found = rules.parse(">".join(x) + "," + ">".join(y))
    for (a, b), by in found.items():
        assert a != b and not (by is True and found.get((b, a)) is True)


@given(st.integers(0, 40), st.integers(41, 90), st.integers(0, 2**31))
@settings(max_examples=40, deadline=None)
def test_planted_lag_and_blocks(lag, n, seed):
    x = np.random.default_rng(seed).standard_normal(n + lag)
    y = x[lag:]
    assert signals.peak(x, y)[0] == lag
    if len(y) > 1:
        assert signals.peak_in_blocks(x, y, 1 << (2 * len(y)).bit_length()) == signals.peak(x, y)


def test_lag_readout(spark):
    rows = spark.createDataFrame([(3, 16), (13, 16)], "peak long, n long").select(F.struct("peak", "n").alias("p"))
    file, seconds = signals.lag(F.col("p"), 1)
    assert [tuple(r) for r in rows.select(file, seconds).collect()] == [(1, 3.0), (2, 3.0)]


def test_frame_hash(spark):
    raw = bytes(np.add.outer(np.arange(32), np.arange(32)).astype(np.uint8).tobytes())
    rows = spark.createDataFrame([(raw,), (raw,), (b"x",), (None,)], "g binary").select(signals.frame_hash("g").alias("h")).collect()
    assert rows[0].h == rows[1].h is not None and rows[2].h is None and rows[3].h is None


def test_first_match_ties_and_nulls(spark):
    names = spark.createDataFrame([(1, "show E01"), (2, None), (3, "other"), (1, "show E01")], "id long, nom string").dropDuplicates()
    rs = spark.createDataFrame([("E([0-9]+)", 1, "a", 5), ("show E([0-9]+)", 2, "b", 5), ("x", 3, "c", 9)], "regex_pattern string, folder_id int, rename_pattern string, weight int")
    assert [(r.id, r.folder_id) for r in routing.first_match(names, rs).collect()] == [(1, 1)]
    assert routing.first_match(names, rs.limit(0)).count() == 0


def test_majority_run(spark):
    rows = spark.createDataFrame([(1, i, 0.95, d) for i, d in enumerate((0, 0, 125, 0, 0))], "pair int, segment int, fidelity double, delay_ms long")
    r = delays.summary(rows).first()
    assert (r.majority, r.distinct, r.head, r.tail) == (0, 2, 0, 0)


@pytest.mark.parametrize(
    "series,expected",
    [([(0.1, 5), (0.2, 5)], ("accept", 5)), ([(0.9, 0), (0.9, 125), (0.9, 0), (0.9, 0)], ("accept", 0)), ([(0.9, 0), (0.9, 125)], ("adjust", 62)), ([(0.9, 0), (0.9, 127)], ("ignore", None)), ([(0.6, 0), (0.6, 125)], ("ignore", None)), ([(1.0, 1), (1.0, 2), (1.0, 3)], ("ignore", None))],
)
def test_stage_one_branches(spark, series, expected):
    rows = spark.createDataFrame([(1, i, float(f), d) for i, (f, d) in enumerate(series)], "pair int, segment int, fidelity double, delay_ms long")
    r = delays.stage_one(rows).first()
    assert (r.verdict, r.delay_ms) == expected


@pytest.mark.parametrize(
    "series,strict,expected",
    [([(0.5, 0)] * 3, False, ("accept", 0)), ([(0.95, 0), (0.95, 125), (0.95, 0)], False, ("accept", 0)), ([(0.95, 0), (0.95, 0), (0.95, 125)], False, ("accept", 0)), ([(0.8, 0), (0.8, 125)], False, ("accept", 0)), ([(0.8, 0), (0.8, 200)], False, ("incompatible", None)), ([(0.8, 0), (0.8, 125)], True, ("incompatible", None)), ([(0.5, 0), (0.5, 200)], False, ("incompatible", None)), ([(0.99, 0), (0.89, 100)], True, ("incompatible", None))],
)
def test_stage_check_branches(spark, series, strict, expected):
    rows = spark.createDataFrame([(1, i, float(f), d) for i, (f, d) in enumerate(series)], "pair int, segment int, fidelity double, delay_ms long")
    r = delays.stage_check(rows, strict).first()
    assert (r.verdict, r.delay_ms) == expected


def test_stage_agreement(spark):
    assert tuple(one(spark, delays.agreed(F.lit(1000.0), F.lit(0.4)), delays.agreed(F.lit(1000.0), F.lit(0.5)))) == (1400.0, None)


def test_keep_first(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, ""), (4, ""), (5, None), (6, "b")], "id int, h string")
    assert {r.id: r.keep for r in tracks.keep_first(t, F.col("h"), "id").collect()} == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3)), max_size=12), st.integers(1, 5))
@settings(max_examples=8, deadline=None)
def test_budget_holds_unless_only_protected_rows_are_left(spark, rows, most):
    t = spark.createDataFrame([(g, i, s) for i, (g, s) in enumerate(rows)], "g int, i int, s int")
    out = tracks.in_stages(t, "g", [F.col("s") == 0, F.col("s") == 1, F.col("s") == 2], most).groupBy("g").agg(F.count("*").alias("n"), F.min("stage").alias("low")).collect()
    assert all(r.n <= most or r.low == 3 for r in out)


def test_tree_delays(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 5), (3, 4, 1), (1, 5, 7), (8, 9, 2)], "winner long, loser long, delay long")
    assert {(r.node, r.root, r.delay) for r in tracks.tree_delays(edges).collect()} == {(1, 1, 0), (2, 1, 10), (3, 1, 15), (4, 1, 16), (5, 1, 7), (8, 8, 0), (9, 8, 2)}


def test_catalog(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, name string, seq int")
    changes = spark.createDataFrame([(2, "c", 0), (3, "d", 5)], "id int, name string, seq int")
    assert {r.id: r.name for r in catalog.upsert(stored, changes, ["id"], "seq").collect()} == {1: "a", 2: "c", 3: "d"}
    assert {r.id: r.name for r in catalog.update(stored, changes.withColumn("name", F.lit(None).cast("string")), ["id"]).collect()} == {1: "a", 2: "b"}
    assert catalog.insert(stored, changes, ["id"]).count() == 3


def test_dominance(spark):
    t = spark.createDataFrame([(1, 0, "mp3", 2.0, 48000, 100.0), (1, 1, "flac", 2.0, 48000, 300.0), (1, 2, "flac", 2.0, 48000, 300.0), (2, 0, "x", 2.0, 48000, 1.0), (2, 1, "y", 6.0, 48000, 1.0)], "g int, i int, format string, channels double, rate int, bitrate double")
    out = {(r.g, r.i): r.keep for r in selection.dominant(t, "g", "i", "flac>mp3").collect()}
    assert out == {(1, 0): False, (1, 1): True, (1, 2): False, (2, 0): True, (2, 1): True}


def test_bad_ranges_and_drift(spark):
    rows = spark.createDataFrame([(1, i, 0.99 if i not in (3, 4) else 0.5, 1) for i in range(8)], "g int, segment long, fidelity double, offsets int")
    assert [tuple(r) for r in cuts.bad_ranges(rows, "g").collect()] == [(1, 2, 5, 2)]
    flat = spark.createDataFrame([(1, 2.0, 5.0), (1, 2.0, 7.0)], "g int, x double, y double")
    assert cuts.drift(flat, "g", "x", "y").first().slope == 0


def test_metadata(spark):
    doc = '{"media": {"track": [{"@type": "Audio", "StreamOrder": "1", "Channels": "6", "BitRate_Nominal": "9", "Title": "t"}, {"@type": "Text"}]}}'
    rows = metadata.container_tracks(spark.createDataFrame([("f", doc)], "file string, json string")).collect()
    assert [(r.type, r.stream_order, r.channels, r.bitrate, r.stream_size) for r in rows] == [("Audio", 1, 6.0, 9, 1), ("Text", None, 2.0, None, 1)]
    props = metadata.property_tracks(spark.createDataFrame([("f", '{"tracks": [{"id": 1, "properties": {"codec": "a"}}, {"id": 1, "properties": {}}]}')], "file string, json string")).collect()
    assert all(r.repeated for r in props) and len(props) == 2
    assert one(spark, metadata.fingerprint(F.lit("X=1\nFINGERPRINT=1,4294967295")))[0] == [1, 4294967295]
    assert one(spark, metadata.pcm(F.lit(bytearray(np.array([1, 2], "<f4").tobytes() + b"x"))))[0] == [1.0, 2.0]


def test_stream_equals_batch(spark, tmp_path):
    rs = spark.createDataFrame([("E([0-9]+)", 1, "a", 5), ("big E([0-9]+)", 1, "a", 9)], "regex_pattern string, folder_id int, rename_pattern string, weight int")
    rows = [(1, "E01"), (2, "big E01"), (3, "E02"), (4, "E02"), (5, "E0")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "id long, nom string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("id long, nom string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = EpisodeState(spark, f"{tmp_path}/state")
    watch(stream, rs, state).awaitTermination()
    assert {(r.episode, r.nom) for r in state.read().collect()} == {(1, "big E01"), (2, "E02")}
    twin = routing.winners(routing.with_episode(routing.first_match(spark.createDataFrame(rows, "id long, nom string"), rs)).where("episode is not null"))
    assert {(r.episode, r.weight) for r in twin.collect()} == {(r.episode, r.weight) for r in state.read().collect()}


def test_rules_of_equal_formats_and_chains():
    assert {k: v for k, v in rules.parse("a=b,a>c>b").items() if v is not False} == {("a", "c"): True, ("c", "b"): True}
    assert rules.parse("m>n,n*5>o,n*6>p").get(("m", "o")) is None and rules.parse("m>n,n*6>p")["m", "p"] is True
    found = rules.parse("x>y,y>z,z>x")  # ends, and no pair is above each other
    assert not any(v is True and found.get((b, a)) is True for (a, b), v in found.items())
    assert rules.compare({("a", "b"): 2.0}, ("A", 5.0), ("b", 10.0)) == 2 and rules.compare({("a", "b"): 2.0}, ("a", 5.1), ("b", 10.0)) == 1
    assert rules.better_encoding(100, 4.0, 95, 5.0) is False and rules.better_encoding(100, 4.0, 96, 5.0) is True


def test_tree_delays_of_cycles(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 1, 5), (2, 3, 1), (7, 8, 4)], "winner long, loser long, delay long")
    got = {r.node: (r.root, r.delay) for r in tracks.tree_delays(edges).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 7: (7, 0), 8: (7, 4)}
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(50)], "winner long, loser long, delay long")
    assert {r.node: r.delay for r in tracks.tree_delays(chain).collect()} == {i: i for i in range(51)}
    assert tracks.tree_delays(edges.limit(0)).count() == 0


def test_numbers_and_sums_of_large_groups(spark):
    import random

    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", k, i % 11) for i, k in enumerate(r.sample(range(100000), 3000))] + [("hot", None, 1)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(4)
    seen = {}
    for g, k, v in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        seen.setdefault(g, []).append((k, v))
    got = {(x.g, x.k): x.n for x in spread.numbered(df, ["g"], "k", "n").collect()}
    assert got == {(g, k): n for g in seen for n, (k, _) in enumerate(seen[g], 1)}
    sums = {(x.g, x.k): x.t for x in spread.trailing_sum(df, "g", "k", "v", 4, "t", 10).collect()}
    assert sums == {(g, k): sum(v for _, v in seen[g][max(0, n - 3) : n + 1]) for g in seen for n, (k, _) in enumerate(seen[g])}
    table = spark.createDataFrame([("hot", 1), ("g0", 2)], "g string, w int")
    assert spread.looked_up(df, "g", "k", table).count() == sum(g in ("hot", "g0") for g, *_ in rows)


def test_drift_far_from_nought(spark):
    rows = spark.createDataFrame([(1, 1e9 + i, 0.01 * i + 3) for i in range(50)], "g int, x double, y double")
    r = cuts.drift(rows, "g", "x", "y").first()
    assert r.slope == pytest.approx(0.01, rel=1e-6) and r.mse == pytest.approx(0, abs=1e-9) and r.tempo == pytest.approx(1 / 1.01, rel=1e-6)


def test_rules_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(routing, "BLOCK", 2)
    rs = spark.createDataFrame([(f"n{i}x", i, "a", i % 3) for i in range(7)] + [("n", 99, "z", 0), (None, 5, "q", 9)], "regex_pattern string, folder_id int, rename_pattern string, weight int")
    names = spark.createDataFrame([(i, f"n{i}x n{i + 1}x") for i in range(8)] + [(50, None), (51, "other")], "id long, nom string")
    got = {r.id: r.folder_id for r in routing.first_match(names, rs).collect()}
    want = {}
    for i in range(8):
        fits = [(-(k % 3), f"n{k}x", k) for k in (i, i + 1) if k < 7] + [(0, "n", 99)]
        want[i] = min(fits)[2]
    assert got == want
    assert {r.id for r in routing.conflicts(names, rs).collect()} == set(range(8))
    assert routing.first_match(names, rs.limit(0)).count() == 0 and routing.conflicts(names, rs.limit(0)).count() == 0


def test_frame_hash_bits(spark):
    """Each bit against a plain two-dimensional cosine sum."""
    r = np.random.default_rng(8)
    frame = r.integers(0, 256, (32, 32)).astype(np.uint8)
    k = np.arange(32)
    low = np.array([[sum(frame[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in k for x in k) * (np.sqrt(1 / 32) if u == 0 else np.sqrt(2 / 32)) * (np.sqrt(1 / 32) if v == 0 else np.sqrt(2 / 32)) for v in range(8)] for u in range(8)]).ravel()
    bits = low > np.median(low[1:])
    got = spark.createDataFrame([(frame.tobytes(),)], "g binary").select(signals.frame_hash("g").alias("h")).first().h
    assert [(got >> i) & 1 for i in range(64)] == bits.astype(int).tolist()


TRACK = st.tuples(st.sampled_from(["flac", "mp3", "ac3"]), st.sampled_from([2.0, 6.0]), st.sampled_from([44100, 48000]), st.sampled_from([100.0, 150.0, 400.0]))


@given(st.lists(TRACK, min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_dominance_rule(some):
    """The pair rule is never both ways, spares one of each pair, and drops nothing that nobody beats."""
    rs = rules.parse("flac*1.1>ac3*2>mp3")
    rows = [dict(zip(("format", "channels", "rate", "bitrate"), t, strict=True)) for t in some]
    for a in rows:
        for b in rows:
            out, back = selection.beaten(a, b, rs), selection.beaten(b, a, rs)
            if a != b and out:
                assert back is None or {out, back} == {"a", "b"}
    keep = [True] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if keep[i] and keep[j] and (out := selection.beaten(rows[i], rows[j], rs)):
                keep[i if out == "a" else j] = False
    assert any(keep)
    for i, on in enumerate(keep):
        if not on:
            assert any(j != i and selection.beaten(rows[min(i, j)], rows[max(i, j)], rs) == ("a" if i < j else "b") for j in range(len(rows)))


def test_state_survives_a_restart_and_a_replay(spark, tmp_path):
    schema = "folder_id int, episode long, nom string, weight int, id long, size long, signature string"
    batches = [[(1, 1, "a", 3, 10, 5, "x"), (1, 1, "b", 3, 9, 5, "y"), (2, 5, "c", 1, 1, 1, None)], [(1, 1, "d", 4, 11, 7, "x"), (2, 5, "e", 1, 2, 1, "z")], [(1, 1, "f", 4, 3, 1, "y")]]
    for epoch, rows in enumerate(batches):
        state = EpisodeState(spark, f"{tmp_path}/state")  # a new object for each batch
        state.merge(spark.createDataFrame(rows, schema), epoch)
        state.merge(spark.createDataFrame(rows, schema), epoch)  # and each batch twice
    state.merge(spark.createDataFrame(batches[1], schema), 1)  # an older one again
    assert {(r.folder_id, r.episode, r.nom) for r in EpisodeState(spark, f"{tmp_path}/state").read().collect()} == {(1, 1, "f"), (2, 5, "c")}
    assert {(r.folder_id, r.episode, r.nom, r.weight) for r in state.incompatible().collect()} == {(1, 1, "d", 4), (2, 5, "e", 1)}


def test_rejects_by_class(spark):
    rows = [(1, 1, "a", 3, 10, 1, "x"), (1, 1, "b", 5, 9, 2, "y"), (1, 1, "c", 3, 8, 3, "x"), (1, 1, "d", 3, 12, 3, "x"), (1, 1, "e", 5, 20, 2, "y"), (1, 2, "g", 1, 1, 1, None)]
    got = {(r.episode, r.signature): (r.role, r.nom, r.weight, r.files) for r in routing.with_rejects(spark.createDataFrame(rows, "folder_id int, episode long, nom string, weight int, id long, size long, signature string")).collect()}
    assert got == {(1, "y"): ("primary", "b", 5, 2), (1, "x"): ("incompatible", "d", 3, 3), (2, None): ("primary", "g", 1, 1)}


def knocked_out(names, beats):
    """The rounds of `merging.knockout` for one merge, by lists."""
    standing, edges, r = list(names), [], 0
    while any((a, b) in beats or (b, a) in beats for a in standing for b in standing if a < b):
        gone, n = set(), len(standing)
        for i, a in enumerate(standing):
            j = (r - i) % n
            if i < j:
                b = standing[j]
                won = beats.get((a, b)) if (a, b) in beats else (None if (b, a) not in beats else not beats[b, a])
                if won is not None:
                    edges.append((a, b) if won else (b, a))
                    gone.add(b if won else a)
        standing = [x for x in standing if x not in gone]
        r += 1
    under = {x: {x} for x in names}
    for winner, loser in reversed(edges):
        pass
    for x in names:
        up = x
        while any(lose == up for _, lose in edges):
            up = next(win for win, lose in edges if lose == up)
        under[up].add(x)
    best = min(standing, key=lambda x: (-len(under[x]), x))
    return set(edges), {y for x in standing if x != best for y in under[x]}


def test_knockout_against_lists(spark):
    import random

    r = random.Random(11)
    files, pairs, want_edges, want_out = [], [], set(), set()
    for g in range(12):
        names = list(range(r.randrange(1, 7)))
        beats = {(a, b): r.random() < 0.5 for a in names for b in names if a < b and r.random() < 0.6}
        files += [(g, x, x) for x in names]
        pairs += [(g, a, b, beats.get((a, b))) for a in names for b in names if a < b]
        edges, out = knocked_out(names, beats)
        want_edges |= {(g, *e) for e in edges}
        want_out |= {(g, x) for x in out}
    edges, out = merging.knockout(spark.createDataFrame(files, "grp int, name long, place int"), spark.createDataFrame(pairs, "grp int, a long, b long, a_wins boolean"))
    assert {(x.grp, x.winner, x.loser) for x in edges.collect()} == want_edges
    assert {tuple(x) for x in out.collect()} == want_out


def test_sources_of_sound(spark):
    import struct

    def wav(code, bits, channels, data, extra=b""):
        form = struct.pack("<HHIIHH", code, channels, 8000, 0, 0, bits)
        body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
        return b"RIFF" + struct.pack("<I", len(body)) + body

    two = np.array([[1, 9], [-2, 9], [3, 9]], "<i2").tobytes()
    rows = [(wav(1, 16, 2, two, b"LIST\x03\0\0\0abc\0"),), (wav(3, 32, 1, np.array([0.5, -1], "<f4").tobytes() + b"x"),), (b"nonsense",), (None,), (wav(1, 24, 1, b"abc"),)]
    got = spark.createDataFrame(rows, "raw binary").select(metadata.wav("raw").alias("w")).select("w.*").collect()
    assert [(r.rate, r.samples) for r in got] == [(8000, [1.0, -2.0, 3.0]), (8000, [0.5, -1.0]), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("n,m,lag", [(50, 9, 17), (64, 17, 40), (33, 5, 0), (40, 16, 24), (16, 3, 13), (35, 17, 18)])
def test_lag_by_blocks(spark, n, m, lag):
    x = np.random.default_rng(n + m).standard_normal(n)
    y = x[lag : lag + m] if lag + m <= n else x[lag:]
    blocks = spark.createDataFrame([("f", b, x[b * 16 : b * 16 + 16].tolist()) for b in range(-(-n // 16))], "file string, block long, samples array<double>")
    got = signals.lag_by_blocks(blocks, spark.createDataFrame([("f", y.tolist())], "file string, y array<double>"), 16).first()
    full = np.round(np.abs(np.correlate(np.concatenate([np.zeros(len(y) - 1), x, np.zeros(len(y) - 1)]), y, "valid")), 9)
    assert (got.lag, got.corr) == (int(full.argmax()) - (len(y) - 1), pytest.approx(full.max()))


def test_budget_by_stages(spark):
    """Equal hashes first, then the stages until the budget holds; a stage that starts is finished."""
    rows = [
        (1, "en", 1, "Forced", False, "plain", "", True), (1, "en", 2, "forced", False, "styled", "", True), (1, "xx", 3, "t", False, "plain", "a", True), (1, "xx", 4, "t", False, "styled", "b", True),
        (1, "xx", 5, "t", False, "styled", "c", True), (1, "en", 6, "t", False, "plain", "d", True), (1, "en", 7, "t", False, "plain", "d", True), (1, "en", 8, "x (sdh)", False, "plain", "e", True), (1, "fr", 9, None, True, "picture", "", True)]
    df = spark.createDataFrame(rows, "grp int, language string, ord long, title string, hearing boolean, class string, md5 string, keep boolean")
    none = spark.createDataFrame([], "language string, group int, title string")

    def left(most):
        return {r.ord for r in subtitles.pruned(df, F.lit(most), none, ["en"], ["fr"]).where("keep").collect()}

    assert left(80) == {1, 2, 3, 4, 5, 6, 8, 9}
    assert left(7) == {2, 3, 4, 5, 6, 8, 9}  # the forced plain one goes, as there is a styled one
    assert left(6) == {2, 4, 5, 6, 8, 9}  # then the plain one of the language not listed
    assert left(5) == {2, 4, 6, 8, 9}  # then all but one styled one there
    assert left(4) == {2, 6, 8, 9}  # then that language's other tracks, one by one
    assert left(1) == {2, 6, 8, 9}  # nothing else may go


def test_tables_are_cleared(spark):
    from tracklake.sources import tables

    df = tables.cut(spark.range(3))
    assert df.count() == 3 and tables.clear(spark) >= 1 and tables.clear(spark) == 0
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        df.count()


def test_worst_and_clique_winners_against_lists(spark):
    import random

    r = random.Random(2)
    text = "flac*1.1>ac3*2>mp3"
    rs = rules.parse(text)
    rows = [(g, i, r.choice(["flac", "ac3", "mp3", "x"]), r.choice([2.0, 6.0]), 48000, float(r.randrange(1, 9))) for g in range(15) for i in range(r.randrange(1, 6))]
    df = spark.createDataFrame(rows, "grp int, member long, format string, channels double, rate int, bitrate double").repartition(3)
    got = {(x.grp, x.member) for x in selection.worst(df, "grp", "member", text).where("is_worst").collect()}
    want = set()
    for g in range(15):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        held = own[0]
        for x in own[1:]:
            if not rules.better_entry(rs, (x[2], x[5]), (held[2], held[5])):
                held = x
        want.add(held[:2])
    assert got == want
    pairs = [(g, i, j) for g in range(15) for i in range(5) for j in range(i + 1, 5) if r.random() < 0.5]
    out = {(x.grp, x.member): (x.clique, x.keep) for x in merging.best_per_clique(df, spark.createDataFrame(pairs, "grp int, i long, j long"), text).collect()}
    names = ("format", "channels", "rate", "bitrate")
    for g in range(15):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: x[1])
        made = []
        for x in own:
            fits = [c for c in made if all((g, y[1], x[1]) in pairs for y in c)]
            fits[0].append(x) if fits else made.append([x])
        for c in made:
            keep = [True] * len(c)
            for i in range(len(c)):
                for j in range(i + 1, len(c)):
                    if keep[i] and keep[j] and (gone := selection.beaten(dict(zip(names, c[i][2:], strict=True)), dict(zip(names, c[j][2:], strict=True)), rs)):
                        keep[i if gone == "a" else j] = False
            for x, k in zip(c, keep, strict=True):
                assert out[g, x[1]] == (c[0][1], k)


def test_what_must_be_there(spark):
    from tracklake.operators import records

    rows = spark.createDataFrame([("1", "en"), ("2", "fr")], "g string, l string")
    with pytest.raises(Exception, match="no language in common"):
        tracks.needed_language(rows, "g", "l").collect()
    assert tracks.needed_language(rows.union(spark.createDataFrame([("2", "en")], rows.schema)), "g", "l").first().l == "en"
    with pytest.raises(Exception, match="no bit rate"):
        one(spark, records.needed_bitrate(F.lit("x"), F.lit(None).cast("string"), F.lit("")))
    assert one(spark, records.needed_bitrate(F.lit("x"), F.lit("7"), F.lit("")))[0] == 7


def test_plan_of_a_whole_merge(spark):
    """Files without the language are rejected, delays add up from the root winner, and what is left out is told."""
    t = spark.createDataFrame([(1, f, "en" if f < 4 else "fr", k, f"k{f}", f, f != 2 or k == "audio") for f in (1, 2, 3, 4) for k in ("audio", "subtitle")], "grp int, file long, language string, kind string, key string, ord long, keep boolean")
    fits = spark.createDataFrame([(1, 1, 2, True), (1, 1, 3, None), (1, 2, 3, True)], "grp int, a long, b long, a_wins boolean")
    between = spark.createDataFrame([(1, 1, 2, 100), (1, 2, 3, 20)], "grp int, winner long, loser long, delay_ms int")
    plan, out = merging.sync_plan(t, fits, between, "en")
    assert {(r.grp, r.name) for r in out.collect()} == {(1, 4)}
    got = {(r.file, r.kind): (r.action, r.delay_ms, r.is_default) for r in plan.collect()}
    assert got == {(1, "audio"): ("take", 0, True), (1, "subtitle"): ("take", 0, False), (2, "audio"): ("take", 100, False), (2, "subtitle"): ("remove", None, False), (3, "audio"): ("take", 120, False), (3, "subtitle"): ("take", 120, False)}


DELAY = "match int, pair int, segment int, fidelity double, delay_ms long"


@pytest.mark.parametrize(
    "first,fine_pair,fine_match,expected",
    [
        ({0: [5, 5], 1: [5, 5]}, {}, None, ([], 5, None)),
        ({0: [0, 125]}, {0: 0.01}, None, ([], 72, None)),  # two near delays: what was measured at their middle, 62
        ({0: [0, 125], 1: [62, 62]}, {0: 0.2}, None, ([0], 62, None)),  # not settled: the pair is ignored
        ({0: [0, 0], 1: [100, 100]}, {}, 0.01, ([], 60, None)),
        ({0: [0, 0], 1: [100, 100]}, {}, 0.5, ([], None, "not settled")),
        ({0: [0, 0], 1: [200, 200]}, {}, 0.01, ([], None, "several delays")),
        ({0: [0, 300], 1: [900, 0]}, {}, 0.01, ([0, 1], None, "no delay")),
    ],
)
def test_combined_delays(spark, first, fine_pair, fine_match, expected):
    rows = spark.createDataFrame([(1, p, i, 0.95, d) for p in first for i, d in enumerate(first[p])], DELAY)
    pairs = spark.createDataFrame([(1, p, d) for p, d in fine_pair.items()], "match int, pair int, delay_s double")
    whole = spark.createDataFrame([] if fine_match is None else [(1, fine_match)], "match int, delay_s double")
    r = delays.combined(rows, pairs, whole).first()
    assert (r.ignored, r.delay_ms, r.reason) == expected


@pytest.mark.parametrize(
    "second,third,expected",
    [
        ({0: [0, 0], 1: [0, 0]}, {}, (40, 2)),
        ({0: [0, 300]}, {}, (None, 2)),
        ({0: [20, 20]}, {0: [0, 0]}, (60, 3)),
        ({0: [20, 20]}, {0: [100, 100]}, (60, 3)),  # small and sure
        ({0: [20, 20]}, {0: [300, 300]}, (None, 3)),
        ({0: [20, 20]}, {}, (None, 3)),  # not measured
        ({0: [0, 0], 9: [500, 0]}, {}, (40, 2)),  # pair 9 is ignored
    ],
)
def test_rechecked_delays(spark, second, third, expected):
    start = spark.createDataFrame([(1, [9], 40), (2, [], None)], "match int, ignored array<int>, delay_ms long")
    made = lambda x: spark.createDataFrame([(1, p, i, 0.95, d) for p in x for i, d in enumerate(x[p])], DELAY)
    rows = delays.rechecked(start, made(second), made(third)).collect()
    assert [(r.match, r.delay_ms, r.test) for r in rows] == [(1, *expected)]


def test_fine_delays(spark):
    rows = [(1, 0, 0, 0.1), (1, 0, 1, 0.1), (1, 1, 0, 0.12), (2, 0, 0, 0.0), (2, 0, 1, 0.5), (3, 0, 0, 0.2), (3, 0, 1, 0.9), (3, 0, 2, 0.2), (4, 0, 0, 0.0), (4, 1, 0, 0.4)]
    df = spark.createDataFrame(rows, "match int, pair int, segment int, delay_s double")
    got = {r.match: (r.delay_s and round(r.delay_s, 6), r.reason) for r in delays.fine_delay(df).collect()}
    assert got == {1: (round((0.1 + 0.1 + 0.12) / 3, 6), None), 2: (None, "a pair varies"), 3: (round(1.3 / 3, 6), None), 4: (None, "pairs vary")}
    long = spark.createDataFrame([(1, 0.3), (4, 0.3)], "match int, delay_s double")
    assert {r.match: r.delay_s for r in delays.fine_delay(df, long).collect()}[1] == 0.3


def budget_model(rows, most, keep, try_):
    """The pruning of one merge as a sequence of steps over lists: rows of (language, ord, title, hearing, class, md5)."""
    live, seen = {}, set()
    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        if row[5] == "" or row[5] not in seen:
            live[row[:2]] = row
            seen.add(row[5])
    n, groups, languages = len(live), {}, sorted({r[0] for r in rows})

    def kind(r):
        title = (r[2] or "").lower()
        return "hearing" if r[3] or "sdh" in title or "(cc)" in title or title in ("cc", "hi") else "dubbed" if "dubtitle" in title else None if "forced" in title else "plain"

    def group(language, of):
        for r in [r for r in sorted(live.values()) if r[0] == language and r[4] != "picture"]:
            if of(r):
                mark = {"forced": "forced", "hearing": "sdh", "dubbed": "dubtitle"}.get(of(r))
                low = (r[2] or "").lower()
                bare = "" if mark == "sdh" and low in ("cc", "hi") else re.sub(rf"\s*\(?{mark}\)?\s*", "", low).strip() if mark else (r[2] or "").strip()
                groups.setdefault((language, of(r), bare), {"plain": [], "styled": []})[r[4]].append(r)

    def take(some):
        nonlocal n
        n -= len(some)
        for r in some:
            live.pop(r[:2], None)

    def texts(language, of):
        for (l, k, _), g in groups.items():
            if l == language and k == of:
                take(g["plain"] if g["styled"] else g["plain"][1:])

    def one_styled(language):
        for of in ("forced", "hearing", "dubbed", "plain"):
            if n > most:
                for (l, k, _), g in groups.items():
                    if l == language and k == of:
                        take(g["styled"][1:])

    kinds = ("hearing", "dubbed", "plain")
    others = [x for x in languages if x not in keep + try_]

    def careful(names):
        for x in names:
            if n > most:
                group(x, kind)
                for k in kinds:
                    if n > most:
                        texts(x, k)

    if n > most:
        for x in languages:
            group(x, lambda r: "forced" if "forced" in (r[2] or "").lower() else None)
        for x in languages:
            texts(x, "forced")
    if n > most:
        for x in others:
            group(x, kind)
            for k in kinds:
                texts(x, k)
    careful(try_)
    for x in others:
        one_styled(x)
    careful(keep)
    for x in others:
        for r in [r for r in sorted(live.values()) if r[0] == x]:
            if n > most:
                take([r])
    for x in try_:
        one_styled(x)
    return set(live)


def test_budget_follows_the_sequence(spark):
    """Tracks that are forced and hearing at once: what the first stage takes doesn't count in the groups of later ones."""
    r = random.Random(4)
    titles = ["Forced", "sdh forced x", "forced x", "forced (sdh)", "x", "y", "x (dubtitle)", "sdh x", None, "cc"]
    merges = {g: sorted({(l, o): (l, o, r.choice(titles), r.random() < 0.2, r.choice(["plain", "plain", "styled", "styled", "picture"]), r.choice(["", "", "", f"m{r.randrange(9)}"])) for o in range(r.randrange(1, 16)) for l in [r.choice(["en", "fr", "de", "it"])]}.values()) for g in range(160)}
    merges[999] = [("de", 0, "sdhx forced", False, "styled", ""), ("de", 1, "sdh forced x", False, "plain", ""), ("de", 2, "forced x", True, "plain", "")]
    limit = {g: 1 if g == 999 else g % 6 for g in merges}
    rows = [(g, *t, True, limit[g]) for g, ts in merges.items() for t in ts]
    df = spark.createDataFrame(rows, "grp int, language string, ord long, title string, hearing boolean, class string, md5 string, keep boolean, most int")
    none = spark.createDataFrame([], "language string, group int, title string")
    kept = {(x.grp, x.language, x.ord) for x in subtitles.pruned(df, F.col("most"), none, ["en"], ["fr"]).where("keep").collect()}
    for g, ts in merges.items():
        assert {k[1:] for k in kept if k[0] == g} == budget_model(ts, limit[g], ["en"], ["fr"]), (g, limit[g], ts)
    assert {k[1:] for k in kept if k[0] == 999} == {("de", 2)}


def test_a_factor_that_is_there_stays():
    found = rules.parse("a*1.1>b,b*1>a,a*2>b")
    assert found["a", "b"] == 1.1 and found["b", "a"] == 1.0


def test_needed_letters():
    cases = {"click_E([0-9]+)": "click_E", "(?:click|view)_E([0-9]+)": "_E", "a|b": "", "ab?cd": "cd", "ab*": "a", "abc+d": "abc", "x{0,2}yz": "yz", "x{2}yz": "yz", r"a\.mkv$": "a.mkv", r"\d+abc": "abc", "[abc]de[^]x]fgh": "fgh", "(?i)abc": "", "^start.*end": "start", "": "", r"a\(b\)c": "a(b)c", "(ab)c(?P<episode>[0-9]+)def": "def"}
    for pattern, want in cases.items():
        assert routing.needed(pattern) == want, pattern
    r = random.Random(2)
    for _ in range(3000):
        pattern = "".join(r.choice(["a", "b", "c", "(a|b)", "[ab]", "a?", "b*", "c+", "a{2}", "(?:bc)?", ".", r"\.", "x|"[:1]]) for _ in range(r.randrange(1, 7)))
        for _ in range(20):
            text = "".join(r.choice("abc.x") for _ in range(r.randrange(0, 9)))
            m = re.search(pattern, text)
            assert not m or routing.needed(pattern) in text, (pattern, text)


def test_many_rules_by_index(spark):
    """10,000 rules in one pass: as plain search in order, and a plan that doesn't grow with their number."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 7))) for _ in range(2500)]
    patterns = sorted({f"{w}_E([0-9]+)" for w in words} | {f"(?:{w}|{v})-{i}" for i, (w, v) in enumerate(zip(words, words[1:], strict=False))} | {f"{w}.*x{i % 50}" for i, w in enumerate(words)} | {f"^{w[:2]}" for w in words[:40]} | {f"z{i}q" for i in range(3500)})
    rs = [(p, i % 90, None, i * 7 % 23) for i, p in enumerate(patterns)]
    names = [(i, r.choice([f"{r.choice(words)}_E{i}", f"{r.choice(words)}-{i % 2500}", f"{r.choice(words)} x{i % 50}", "hot_E1", None, "ab", f"z{i}q"])) for i in range(600)]
    rdf = spark.createDataFrame(rs, "regex_pattern string, folder_id int, rename_pattern string, weight int")
    ndf = spark.createDataFrame(names, "id long, nom string")
    order = sorted(rs, key=lambda x: (-x[3], x[0]))
    compiled = [(re.compile(x[0]), x[0]) for x in order]
    want = {}
    for i, nom in names:
        if nom is not None:
            hit = next((p for c, p in compiled if c.search(nom)), None)
            if hit:
                want[i] = hit
    found = routing.first_match(ndf, rdf)
    assert {x.id: x.regex_pattern for x in found.collect()} == want
    plan = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    half = routing.first_match(ndf, rdf.where("weight < 11"))
    assert abs(plan(found) - plan(half)) < 0.2 * plan(found)
    assert {x.id for x in routing.conflicts(ndf, rdf).collect()} == set(want)


def as_blocks(spark, signals_, width, kind):
    rows = [(k, i // width, x[i : i + width].tolist()) for k, x in signals_.items() for i in range(0, len(x), width)]
    return spark.createDataFrame(rows, f"key string, block long, values array<{kind}>").repartition(3)


def test_whole_span_in_blocks(spark):
    """Fingerprints of one to many blocks against every offset tried by itself."""
    r = np.random.default_rng(8)
    words = {k: r.integers(0, 1 << 32, n) for k, n in (("long", 900), ("short", 40), ("none", 20), ("edge", 64), ("same", 130))}
    other = {"long": np.concatenate([r.integers(0, 1 << 32, 77), words["long"][:500]]), "short": words["short"][3:], "none": words["none"], "edge": r.integers(0, 1 << 32, 200), "same": words["same"]}
    want = {}
    for k, x in words.items():
        y, span = other[k], min(len(x), len(other[k])) - 32
        best = None
        for o in range(-span, span + 1):
            a, b = (x[o:], y) if o > 0 else (x, y[-o:])
            n = min(len(a), len(b))
            if n >= 32:
                corr = sum(32 - int(v).bit_count() for v in (a[:n] ^ b[:n]).tolist()) / n / 32
                if best is None or corr > best[0] + 1e-15:
                    best = corr, o
        if best:
            want[k] = best
    for width in (64, 1 << 16):
        got = {x.key: (x.corr, x.offset) for x in correlation.similarity(as_blocks(spark, words, width, "long"), as_blocks(spark, other, width, "long"), 32, width).collect()}
        assert got.keys() == want.keys()
        for k in want:
            assert got[k] == (pytest.approx(want[k][0]), want[k][1]), k


def test_two_long_signals_in_blocks(spark):
    """The second signal may have many blocks too; both ways of the chooser agree with the whole transform."""
    r = np.random.default_rng(3)
    left = {f"k{i}": r.normal(size=n) for i, n in enumerate((700, 30, 500, 64, 1))}
    right = {"k0": left["k0"][123:], "k1": left["k1"], "k2": np.concatenate([r.normal(size=210), left["k2"][:300]]), "k3": r.normal(size=400), "k4": r.normal(size=3)}
    want = {}
    for k, x in left.items():
        at, n = signals.peak(x, right[k])
        want[k] = at if at < len(x) else at - n
    a, b = as_blocks(spark, left, 64, "double"), as_blocks(spark, right, 64, "double")
    assert {x.key: x.lag for x in correlation.lag(a, b, 64).collect()} == want
    both = correlation.chosen_lag(a, b, 18.0 * 256, 64).collect()
    assert {x.key: x.lag for x in both} == want and {x.strategy for x in both} == {"full", "blocks"}


@pytest.mark.parametrize("span", [16, 200, 1 << 17])
def test_signals_of_many_blocks(spark, monkeypatch, span):
    """Every lag of signals of many blocks against plain sums, whatever a task holds; a key of few blocks goes the other way."""
    monkeypatch.setattr(correlation, "SPAN", {False: span, True: span})
    r = np.random.default_rng(5)
    sizes = {"a": (203, 131), "b": (90, 3), "c": (1, 160), "d": (17, 20), "e": (96, 96), "f": (12, 0)}
    left, right = ({k: r.normal(size=v[i]) for k, v in sizes.items()} for i in (0, 1))
    sides, about = correlation.both(as_blocks(spark, left, 6, "double"), as_blocks(spark, right, 6, "double"))
    got = {}
    for x in correlation.curve(sides, about, False, 6).collect():
        for i, v in enumerate(x["values"]):
            assert got.setdefault((x.key, x.start + i * x.step), v) == v
    want = {(k, i - len(right[k]) + 1): v for k in "abcde" for i, v in enumerate(np.correlate(left[k], right[k], "full"))}
    got = {k: v for k, v in got.items() if k in want or abs(v) > 1e-9}
    assert got == pytest.approx(want)
    words, other = ({k: r.integers(0, 1 << 32, v[i]) for k, v in sizes.items()} for i in (0, 1))
    monkeypatch.setattr(correlation, "FEW", {True: 8})
    sides, about = correlation.both(as_blocks(spark, words, 6, "long"), as_blocks(spark, other, 6, "long"))
    got = {(x.key, x.start + i * x.step): round(v) for x in correlation.curve(sides, about, True, 6).collect() for i, v in enumerate(x["values"])}
    planes = lambda x: (x[:, None] >> np.arange(32) & 1) * 2 - 1
    want = {(k, i - j): 0 for k in "abcde" for i in range(sizes[k][0]) for j in range(sizes[k][1])}
    for k in "abcde":
        for i, row in enumerate(planes(words[k]) @ planes(other[k]).T):
            for j, v in enumerate(row.tolist()):
                want[k, i - j] += v
    assert {k: v for k, v in got.items() if k in want or v} == want


def test_what_long_signals_send_grows_with_them(spark, monkeypatch):
    """Values that go into Arrow tasks, for signals of 64 and 256 blocks."""
    kind, seen = type(spark.range(0)), []
    plain = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: (seen.append(df), plain(df, *a, **k))[1])
    r, sent = np.random.default_rng(1), []
    for n in (512, 2048):
        seen.clear()
        x = {"k": r.normal(size=n)}
        assert [y.lag for y in correlation.lag(as_blocks(spark, x, 8, "double"), as_blocks(spark, {"k": x["k"][5:]}, 8, "double"), 8).collect()] == [5]
        sent.append(sum(df.agg(F.sum(F.size("values"))).first()[0] or 0 for df in seen))
    assert sent[1] < 5 * sent[0]


def test_running_over_pieces(spark, monkeypatch):
    """One group with most rows: shared out by pieces, equal to plain running values."""
    r = random.Random(3)
    rows = [("hot" if i % 3 else f"g{i % 7}", i, r.random(), r.randrange(3)) for i in range(4000)] + [(None, i, 0.5, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, o long, f double, v int").repartition(5)
    got = spread.running(df, ["g"], "o", sums={"total": F.col("v")}, lags={"last": F.col("v")}, mins={"worst": F.col("f")}).collect()
    state = {}
    want = set()
    for g, o, f, v in sorted(rows, key=lambda x: x[1]):
        total, last, worst = state.get(g, (0, None, None))
        want.add((g, o, total + v, last, worst))
        state[g] = total + v, v, f if worst is None else min(worst, f)
    assert {(x.g, x.o, x.total, x.last, x.worst) for x in got} == want
    pieces = spread.borders(df, "o")
    assert len(pieces) > 50  # the hot group is in as many windows


def test_delay_loop_meets_every_branch(spark):
    """Recordings with planted delays: settled by words alone, between two words by samples, torn, drifting apart, and unlike."""
    r = np.random.default_rng(12)
    rate, n = 64, 60 * 64

    def smooth():
        x = np.convolve(r.normal(size=n + 400), np.ones(24) / 24, "same")
        return x - np.convolve(x, np.ones(200) / 200, "same")

    def words(x):
        bits = (x > 0).astype(np.int64)
        return [int((bits[s : s + 32] << np.arange(32)).sum()) for s in range(0, len(x) - 31, 8)]

    base = {m: smooth()[200 : 200 + n] for m in range(6)}
    late = lambda x, k: np.concatenate([r.normal(size=k) * 0.1, x])[: len(x)]
    right = {0: late(base[0], 80), 1: late(base[1], 84), 2: np.concatenate([late(base[2], 80)[:1400], late(base[2], 160)[1400:]]), 3: smooth()[:n], 4: base[4], 5: np.concatenate([late(base[5], 16)[:1400], late(base[5], 20)[1400:]])}
    grid = [(m, s, 5.0 + 10 * s, 8.0) for m in base for s in range(5)]
    w = [(m, side, t, i, v) for m in base for side, t, x in ((1, "a", base[m]), (2, "b", right[m])) for i, v in enumerate(words(x))]
    v = [(m, side, t, i, float(y)) for m in base for side, t, x in ((1, "a", base[m]), (2, "b", right[m])) for i, y in enumerate(x)]
    # a second track on one side, and one that shares nothing: its pair is ignored
    w += [(0, 2, "c", i, int(x)) for i, x in enumerate(r.integers(0, 1 << 32, 400))]
    v += [(0, 2, "c", i, float(x)) for i, x in enumerate(r.normal(size=n))]
    make = lambda rows, kind: spark.createDataFrame(rows, f"match long, side int, track string, n long, value {kind}")
    tracks_ = measuring.Tracks(make(w, "long"), make(v, "double"), spark.createDataFrame(grid, "match long, segment long, begin_s double, length_s double"), 8.0, 64.0)
    got = {x.match: x for x in measuring.decided(tracks_).collect()}
    assert got[0].total_ms == pytest.approx(1250, abs=1) and got[0].delay_ms == 1250 and got[0].reason is None
    assert got[1].total_ms == pytest.approx(84 / rate * 1000, abs=1) and got[1].reason is None  # between two words
    assert got[2].total_ms is None and got[2].reason == "no delay"  # torn by more than a second
    assert got[3].total_ms is None
    assert got[4].total_ms == pytest.approx(0, abs=1)
    assert got[5].match == 5


def test_state_log_is_folded(spark, tmp_path):
    """Over many batches, with restarts, replays and a fold cut short: the winners of all files, and a log that stays short."""
    import os
    import random

    r = random.Random(5)
    schema = "folder_id int, episode long, nom string, weight int, id long, size long, signature string"
    rows, ident = [], 0
    for epoch in range(7):
        some = [(1, r.randrange(3), f"f{ident + i}", r.randrange(epoch + 2), ident + i, 1, r.choice(["x", "y", None])) for i in range(4)]
        ident += 4
        rows += some
        batch = spark.createDataFrame(some, schema)
        state = EpisodeState(spark, f"{tmp_path}/state", fold=2)
        if epoch == 6:  # a fold that wrote its table and then stopped
            spark.createDataFrame(some[:1], schema).write.parquet(state.folded(5))
        state.merge(batch, epoch)
        if epoch % 3 == 0:
            state.merge(batch, epoch)
        best = {}
        for x in rows:
            key = (x[0], x[1])
            best[key] = min(best.get(key, x), x, key=lambda y: (-y[3], y[4]))
        assert {(x.folder_id, x.episode, x.nom) for x in state.read().collect()} == {(*k, x[2]) for k, x in best.items()}
    assert [f.through for f in state.folds(spark)] == [5, 3]
    assert sorted(os.listdir(state.path)) == ["epoch=-1", "epoch=4", "epoch=5", "epoch=6"]
    assert sorted(os.listdir(f"{state.folder}/folded")) == ["through-3", "through-5"]
    before = sorted(map(tuple, state.classes().collect()), key=repr)
    state.merge(spark.createDataFrame([(1, 0, "late", 99, 999, 1, "x")], schema), 3)  # folded: changes nothing
    assert sorted(map(tuple, state.classes().collect()), key=repr) == before
    with pytest.raises(ValueError, match="folded"):
        state.read(before=5)


def test_knockout_of_small_and_large_merges(spark, monkeypatch):
    """Merges are played in one row up to SMALL files, in rounds beyond; both ways give the same."""
    r = random.Random(5)
    files = [(g, g * 100 + i, i) for g in range(12) for i in range(r.randrange(1, 8))]
    pairs = [(g, a, b, r.choice([True, False, None])) for g, a, _ in files for h, b, _ in files if g == h and a < b]
    tables = spark.createDataFrame(files, "grp int, name long, place int"), spark.createDataFrame(pairs, "grp int, a long, b long, a_wins boolean")
    got = {}
    for small in (0, 3, 64):
        monkeypatch.setattr(merging, "SMALL", small)
        edges, out = merging.knockout(*tables)
        way = edges.select("grp", "winner", "loser", (F.col("winner") * 3 - F.col("loser")).alias("delay"))
        got[small] = ({tuple(x) for x in edges.collect()}, {tuple(x) for x in out.collect()}, {tuple(x) for x in merging.down(way).collect() if x.delay_ms})
    assert got[0] == got[3] == got[64] and all(got[0])
    assert {x[0] for x in got[0][0]} > {x[0] for x in got[0][1]}


def test_names_ask_for_few_pieces_of_many_rules(spark):
    """Rules of 500 people share their groups of three letters; a name still asks for no piece but its own."""
    rows = [(f"_U{u}_E([0-9]+)", u, "r", 1) for u in range(500)] + [("view_U[0-9]*7_", 900, "r", 0), ("aaa", 901, "r", 0)]
    rules_ = spark.createDataFrame(rows, "regex_pattern string, folder_id int, rename_pattern string, weight int")
    names = ["view_U17_E3", "click_U499_E1", "click_U500_E1", "xaaaa", "ab", "", "_U1_E2_U1_E3"]
    noms = spark.createDataFrame([(n,) for n in names], "nom string")
    index, short = routing.piece_index(rules_)
    got = sorted((r.nom, r.piece) for r in routing.asked(noms, index).collect())
    assert got == [("_U1_E2_U1_E3", "_U1_E"), ("click_U499_E1", "_U499_E"), ("view_U17_E3", "_U17_E"), ("view_U17_E3", "view_U"), ("xaaaa", "aaa")]
    assert short.count() == 0
    assert {(r.nom, r.folder_id) for r in routing.first_match(noms, rules_).collect()} == {("view_U17_E3", 17), ("click_U499_E1", 499), ("xaaaa", 901), ("_U1_E2_U1_E3", 1)}


def test_parts_grow_with_the_rows(spark, monkeypatch):
    """Stars, cliques and cascades deal their tables into more parts as they grow, so that no task holds more."""
    monkeypatch.setattr(spread, "TASK", 50)
    monkeypatch.setattr(catalog, "LARGE", 50)
    rows = spark.range(600).select((F.col("id") % 200).alias("grp"), F.floor(F.col("id") / 200).alias("name"), (F.col("id") < 200).alias("forced"))
    pairs = rows.where("name > 0").select("grp", F.lit(0).cast("long").alias("a"), F.col("name").alias("b"), (F.col("name") == 1).alias("fits"))
    star = merging.star(rows, pairs)
    assert star.rdd.getNumPartitions() == 13 and star.where("compatible").count() == 200 and star.count() == 400
    made = merging.cliques(rows.select("grp", F.col("name").alias("member")), pairs.where("fits").select("grp", F.col("a").alias("i"), F.col("b").alias("j")))
    assert made.rdd.getNumPartitions() == 13 and made.where("clique = 0").count() == 400 and made.count() == 600
    t = {"folder": spark.range(300).toDF("k"), "file": rows.select(F.col("grp").alias("k"), "name")}
    kept, lost = catalog.cascade(t, [catalog.Link("folder", "k", "file", "k")], {"folder": spark.range(100).toDF("k")})
    assert kept["file"].rdd.getNumPartitions() == 19 and kept["file"].count() == 300 and lost["file"].count() == 300


def test_mean_at_the_bound(spark):
    """A mean of 0.85 suffices, though 0.8 + 0.9 and the like add up to a little less or more by their order."""
    from tracklake.operators import records

    values = [0.7 + k / 100.0 for k in (2, 28, 15, 15, 15)]
    rows = [(g, v, 1) for g in range(40) for v in random.Random(g).sample(values, len(values))] + [(99, 0.849999, 1)]
    added = lambda g: functools.reduce(lambda x, y: x + y, (v for k, v, _ in rows if k == g))  # noqa: E731  (sum() compensates)
    assert any(added(g) / len(values) < 0.85 for g in range(40))
    got = records.compatible_globally(spark.createDataFrame(rows, "g int, fidelity double, offsets int").coalesce(1), "g").collect()
    assert {r.g for r in got if not r.compatible} == {99}


def test_event_rows_are_numbered_once(spark, monkeypatch):
    from tracklake.plans import further

    calls, plain = [], further.numbered
    monkeypatch.setattr(further, "numbered", lambda *a: calls.append(a) or plain(*a))
    monkeypatch.setattr(delays, "combined", lambda first, fine, whole: first)
    monkeypatch.setattr(delays, "rechecked", lambda start, second, third: start)
    assert further.delay_rechecked(spark, "/root/testdata/sf0.001").count() == 1000
    assert len(calls) == 1
