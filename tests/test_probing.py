"""Samples by byte ranges, probes and steps, cascades, and candidates tried in turn, against plain Python."""

import random
import struct

import numpy as np
import pytest

from tracklake.operators import catalog, probes
from tracklake.operators.catalog import Link
from tracklake.sources import sound
from tracklake.streaming import candidates
from tracklake.streaming.candidates import Candidates


def wav(code, bits, channels, data, extra=b""):
    form = struct.pack("<HHIIHH", code, channels, 8000, 0, 0, bits)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 1 << 20])
def test_sound_in_ranges(spark, tmp_path, size):
    r = np.random.default_rng(3)
    long_, two = r.integers(-9000, 9000, 500), r.integers(-9000, 9000, (90, 2))
    files = {
        "a.wav": wav(1, 16, 1, long_.astype("<i2").tobytes()), "b.wav": wav(1, 16, 2, two.astype("<i2").tobytes(), b"LIST\x03\0\0\0abc\0"), "c.f32": np.arange(33, dtype="<f4").tobytes() + b"xy",
        "d.wav": b"nonsense, all of it", "e.wav": b"", "f.wav": wav(1, 24, 1, b"abcabc"), "g.wav": wav(1, 16, 1, b""), "_h.f32": b"12345678", "i.wav": wav(3, 32, 1, np.array([0.5], "<f4").tobytes())[:-1]}
    if size == 1:
        files = {k: files[k] for k in ("c.f32", "g.wav", "i.wav")}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    sound.register(spark)
    df = spark.read.format("samples").option("block", 16).option("bytes", size).option("rate", 100).load(str(tmp_path))
    got = {}
    for x in df.coalesce(4).collect():
        assert (x.file, x.block) not in got
        got[x.file, x.block] = (x.rate, list(x.samples))
    want = {}
    for name, rate, v in (("a.wav", 8000, long_), ("b.wav", 8000, two[:, 0]), ("c.f32", 100, np.arange(33))):
        if name in files:
            want |= {(name, k): (rate, [float(x) for x in v[16 * k : 16 * k + 16]]) for k in range(-(-len(v) // 16))}
    assert got == want


def test_sound_written_twice(spark, tmp_path):
    rows = [("x.wav", b, [float(b), b + 0.5], 8000, 6) for b in (2, 0, 1)] + [("y.f32", 0, [1.0], 8000, 1)]
    blocks = spark.createDataFrame(rows, "file string, block long, samples array<double>, rate int, total long")
    for _ in range(2):
        assert {tuple(r) for r in sound.stored(blocks, str(tmp_path / "s")).collect()} == {("x.wav", 44 + 24), ("y.f32", 4)}
    sound.register(spark)
    got = {(r.file, r.block): list(r.samples) for r in spark.read.format("samples").option("block", 4).load(str(tmp_path / "s")).collect()}
    assert got == {("x.wav", 0): [0.0, 0.5, 1.0, 1.5], ("x.wav", 1): [2.0, 2.5], ("y.f32", 0): [1.0]}


def test_step_by_all_places(spark):
    r = random.Random(5)
    groups = {g: [(x, r.choice([0.0, 0.1]) + (3.0 if g % 3 and x > g else 0.0) + 1000 * (g == 8)) for x in range(r.randrange(1, 12))] for g in range(1, 12)}
    rows = [(g, x, y) for g, v in groups.items() for x, y in v] + [(1, None, 5.0), (1, 3, None), (99, None, None)]
    got = {x.g: x for x in probes.step(spark.createDataFrame(rows, "g int, x int, y double"), "g", "x", "y").collect()}
    assert set(got) == set(groups)
    square = lambda v: sum((y - sum(v) / len(v)) ** 2 for y in v) if v else 0.0
    for g, v in groups.items():
        ys = [y for _, y in v]
        costs = [(round(square(ys[: i + 1]) + square(ys[i + 1 :]), 9), v[i][0]) for i in range(len(ys) - 1)]
        kind = "constant" if square(ys) / len(ys) <= 0.12 else "step" if costs and min(costs)[0] / len(ys) <= 0.12 else "unsettled"
        assert (got[g].n, got[g].kind) == (len(ys), kind)
        assert got[g].at == (min(costs)[1] if kind == "step" else None)
    assert {x.kind for x in got.values()} == {"constant", "step"}
    assert probes.step(spark.createDataFrame([], "g int, x int, y double"), "g", "x", "y").collect() == []


def test_places_of_probes(spark):
    files = spark.createDataFrame([(1, 600.0), (2, 30.0), (3, 0.0), (4, None)], "match long, duration_s double")
    got = {(x.match, x.segment): (x.center_s, x.begin_s, x.length_s) for x in probes.spread_over(files, 2).collect()}
    assert got == {(1, k): (150.0 * (k + 1), 150.0 * (k + 1) - 15, 30.0) for k in range(3)} | {(2, k): (7.5 * (k + 1), 7.5 * (k + 1) - 5, 10.0) for k in range(3)}
    ranges = spark.createDataFrame([(1, 0, 4.0, 4.1), (1, 2, 100.0, 140.0), (2, 0, None, 1.0)], "match long, range_ long, start_s double, end_s double")
    got = {(x.range_, x.segment): (x.center_s, x.begin_s, x.length_s) for x in probes.within(ranges).collect()}
    assert got == {(0, k): (4 + 0.125 * (k + 1), 0.0, 10.0) for k in range(3)} | {(2, 6 + k): (100 + 10.0 * (k + 1), 88 + 10.0 * (k + 1), 24.0) for k in range(3)}
    probed = spark.createDataFrame([(1, 0, 0.0), (1, 0, 0.0), (1, 0, 1.5), (1, 1, 2.0), (2, 0, 0.1), (2, 0, 0.2)], "match long, range_ long, delay_s double")
    found = probes.agreeing(probed)
    assert {(x.match, x.range_): x.agrees for x in found.collect()} == {(1, 0): False, (1, 1): True, (2, 0): True}
    every = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "match long, all_torn boolean")
    assert {tuple(x) for x in probes.settled(every, found).collect()} == {(1, False), (2, True), (3, True)}


def test_cascade_of_two_parents(spark):
    t = {
        "shelf": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, name string"), "owner": spark.createDataFrame([(7,), (8,)], "who int"),
        "book": spark.createDataFrame([(10, 1, 7), (11, 2, 7), (12, 2, 8), (13, 3, 8), (14, None, 8), (15, 9, 8), (13, 3, 8)], "id int, shelf int, who int"), "page": spark.createDataFrame([(10, 0), (11, 0), (12, 0), (13, 0), (99, 0)], "book int, n int")}
    links = [Link("shelf", "id", "book", "shelf"), Link("owner", "who", "book", "who"), Link("book", "id", "page", "book")]
    doomed = {"shelf": spark.createDataFrame([(1,), (1,)], "id int"), "owner": spark.createDataFrame([(7,)], "who int"), "book": spark.createDataFrame([(12,)], "id int")}
    kept, lost = catalog.cascade(t, links, doomed)
    assert sorted(tuple(r) for r in kept["book"].collect()) == [(13, 3, 8), (13, 3, 8)]
    assert {(r.id, r.reason) for r in lost["book"].collect()} == {(10, "cascade"), (11, "cascade"), (12, "deleted"), (14, "orphan"), (15, "orphan")}
    assert [tuple(r) for r in kept["page"].collect()] == [(13, 0)]
    assert {(r.book, r.reason) for r in lost["page"].collect()} == {(10, "cascade"), (11, "cascade"), (12, "cascade"), (99, "orphan")}
    assert {r.id for r in kept["shelf"].collect()} == {2, 3} and [r.who for r in kept["owner"].collect()] == [8]
    assert kept["page"].columns == ["book", "n"] and lost["page"].columns == ["book", "n", "reason"]


FILES = "folder_id int, episode long, id long, nom string, weight int, size long, holds long"


def in_turn(files):
    """Each file tries the candidates of its episode, heaviest first: candidates and failures by lists."""
    held, failed = {}, []
    for folder, episode, _, nom, weight, size, holds in files:
        mine = held.setdefault((folder, episode), [])
        for c in sorted(mine, key=lambda c: -c["weight"]):  # stable: the earlier of equal weights
            if not c["holds"] & holds:
                failed.append((folder, episode, nom, c["nom"]))
                continue
            if weight > c["weight"] or (weight == c["weight"] and size >= c["size"]):
                c |= {"nom": nom, "weight": weight, "size": size}
            c["holds"] |= holds
            break
        else:
            mine.append({"nom": nom, "weight": weight, "size": size, "holds": holds})
    return {(*k, i, *c.values()) for k, v in held.items() for i, c in enumerate(v)}, sorted(failed)


def test_candidates_over_batches_and_restarts(spark):
    r = random.Random(9)
    files = [(r.randrange(2), r.randrange(3), i, f"f{i}", r.randrange(3), r.randrange(3), r.choice([0, 1, 2, 4, 8, 6])) for i in range(60)]
    state = Candidates(spark)
    for part in (files[:20], files[20:21], files[21:60]):
        again = Candidates(spark, state.folder)  # nothing but the folder is carried over
        again.add(spark.createDataFrame(part[::-1], FILES))
        again.run()
        again.run()  # nothing new: nothing happens
    want, failed = in_turn(files)
    assert {tuple(x) for x in candidates.standing(state.events()).collect()} == want
    assert sorted((x.folder_id, x.episode, x.nom, x.other) for x in state.errors().collect()) == failed
    assert {x.reason for x in state.errors().collect()} == {"nothing in common"}
    merged = state.events().where("kind = 'merged'").count()
    assert merged + len(want) == len(files)


def test_candidates_are_written_again_now_and_then(spark, monkeypatch):
    """One row of each batch, so that every episode's candidates come from earlier batches, some of them written again since."""
    monkeypatch.setattr(candidates, "FOLD", 2)
    files = [(1, 1, 0, "a", 1, 1, 1), (1, None, 1, "n", 1, 1, 2), (1, 1, 2, "b", 2, 1, 2), (2, 1, 3, "c", 1, 1, 1), (1, None, 4, "m", 3, 1, 3), (1, 1, 5, "d", 0, 1, 6)]
    state = Candidates(spark)
    for f in files:
        state.add(spark.createDataFrame([f], FILES))
        state.run()
    want, failed = in_turn(files)
    assert {tuple(x) for x in candidates.standing(state.events()).collect()} == want
    assert sorted(((x.folder_id, x.episode, x.nom, x.other) for x in state.errors().collect()), key=repr) == sorted(failed, key=repr)
    steps = [(x.folder_id, x.episode, x.step) for x in state.events().collect()]
    assert len(steps) == len(set(steps))
    held = state.log().where("kind = 'held'").groupBy("epoch").count().collect()
    assert {x.epoch: x["count"] for x in held} == {0: 1, 1: 2, 2: 2, 3: 4, 4: 1, 5: 4}
