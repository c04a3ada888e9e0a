"""Refined cuts, spliced tracks, rewritten tracks and keyed state on small hand-made rows."""

import pandas as pd

from tracklake.operators import merging, refine, rewriting
from tracklake.streaming.keyed import changes

RANGE = "k int, begin_s double, end_s double, fps_main double, fps_target double, gap_begin int, gap_end int, scene_s array<double>, lag_s double"


def test_ways_in_order(spark):
    rows = [
        (1, 10.0, 14.0, 25.0, 25.0, 50, 100, [11.0], 1.0), (2, 10.0, 14.0, 25.0, 24.0, 50, 100, [10.5, 11.0, 13.9], 1.0), (3, 10.0, 14.0, None, None, None, None, [], 1.5),
        (4, 10.0, 14.0, None, 24.0, None, None, None, None), (5, None, 14.0, 25.0, 25.0, 1, 2, [1.0], 0.0), (6, 1.0, 1.1, 25.0, 25.0, 0, 5, None, None)]
    got = {r.k: (r.method, r.start_s, r.end_at_s, r.start_frame) for r in refine.refined(spark.createDataFrame(rows, RANGE)).collect()}
    assert got[1] == ("frames", 10.0, 12.0, 250)
    assert got[2] == ("scene", 10.2, 11.8, 245)
    assert got[3] == ("sound", 11.5, 15.5, 288)
    assert got[4] == ("sound", 10.0, 14.0, 240)
    assert got[5] == (None, None, None, None)
    assert got[6][:2] == ("frames", 0.75)


def test_verdicts(spark):
    seg = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 2), (3, 0.9, 2), (4, 0.8, 1), (5, 0.9, 1), (7, 0.2, 1)], "g int, fidelity double, offsets int")
    rng = spark.createDataFrame([(2, "frames", None), (3, "sound", 0.1), (3, "sound", 0.2), (4, "scene", 0.0), (5, None, 0.0), (6, "scene", 0.0)], "g int, method string, lag_s double")
    got = {r.g: (r.cuts, r.reason) for r in refine.verdict(seg, rng, "g").collect()}
    assert got == {1: (0, None), 2: (1, "conflicting offsets"), 3: (2, None), 4: (1, "low fidelity"), 5: (1, "range not refined"), 6: (1, "no measurement"), 7: (0, None)}


def test_splice_takes_both_sides(spark):
    blocks = spark.createDataFrame([("f", b, [float(x) for x in range(b * 8, b * 8 + 8)]) for b in range(30)], "file string, block int, samples array<double>")
    cuts = spark.createDataFrame([("f", 0, 2.0, 4.0), ("f", 1, 0.0, 1.0), ("f", 2, 500.0, 600.0), ("g", 0, 1.0, 2.0), ("f", 3, None, 1.0)], "file string, cut int, start_s double, end_s double")
    got = {(r.file, r.cut): r.samples for r in refine.spliced(blocks, cuts, 20, 8).collect()}
    assert set(got) == {("f", 0), ("f", 1)}
    assert got["f", 0] == [*map(float, range(30, 41)), *map(float, range(80, 180))]
    assert got["f", 1] == [*map(float, range(20, 120))]


TRACK = "grp int, file int, kind string, stream_order string, language string, keep boolean, md5 string, stream_size long, duration_s double, format string, delay double"


def test_rewriting(spark):
    rows = [
        (1, 0, "audio", "10", "en", True, "a", None, None, "aac", None), (1, 0, "audio", "2", "en", True, "a", 5, 1.0, "aac", 3.0), (1, 0, "commentary", "3", "en", False, "b", 5, 1.0, "aac", 0.0), (1, 0, "audio", "4", "en", True, "b", 5, 1.0, "aac", 0.0),
        (1, 1, "subtitle", "1", "en", True, "a", 5, 0.0, "srt", 0.0), (1, 1, "subtitle", "2", "en", True, "a", 5, 1.0, "SRT", 0.0), (1, 1, "subtitle", "3", "xx", True, "", 5, 1.0, "ass", 0.0), (1, 1, "subtitle", "4", None, True, "", 5, 1.0, "ass", 0.0),
        (1, 1, "subtitle", "5", "en", True, None, 5, 1.0, "xsub", 0.0)]
    chosen = rewriting.selection(spark.createDataFrame(rows, TRACK), ["xx"])
    got = {(r.file, r.stream_order): r.reason for r in chosen.collect()}
    assert got == {(0, "10"): "same hash", (0, "2"): None, (0, "3"): "not kept", (0, "4"): None, (1, "1"): "empty", (1, "2"): None, (1, "3"): "language", (1, "4"): None, (1, "5"): None}
    first = {(r.file, r.stream_order): (r.place, r.codec) for r in rewriting.first_pass(chosen).collect()}
    assert first == {(0, "2"): (0, "copy"), (0, "4"): (1, "copy"), (1, "2"): (0, "srt"), (1, "4"): (1, "ass"), (1, "5"): (2, "copy")}
    late = rewriting.times(spark.createDataFrame([(1500, 10.0), (-250, 10.0), (None, 10.0)], "delay_ms int, duration_s double")).collect()
    assert [(r.first_length_s, r.offset_s, r.seek_s) for r in late] == [(8.5, 1.5, 0.0), (10.25, 0.0, 0.25), (10.0, 0.0, 0.0)]


def test_empty_tables(spark):
    assert refine.refined(spark.createDataFrame([], RANGE)).count() == 0
    assert rewriting.first_pass(rewriting.selection(spark.createDataFrame([], TRACK), [])).count() == 0


def test_keyed_state_over_batches(spark, tmp_path):
    schema = "folder_id int, episode long, nom string, weight int, id long"
    for i, rows in enumerate([[(1, 1, "a", 3, 10), (1, 1, "b", 3, 9), (2, 5, "c", 1, 1)], [(1, 1, "d", 2, 1), (2, 5, "e", 4, 2)], [(1, 1, "f", 9, 30)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/batch={i}")
    seen: list[pd.DataFrame] = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    changes(stream).writeStream.foreachBatch(lambda b, _: seen.append(b.toPandas())).outputMode("update").option("checkpointLocation", f"{tmp_path}/p").trigger(availableNow=True).start().awaitTermination()
    rows = sorted(tuple(r) for f in seen for r in f[["folder_id", "episode", "nom", "version"]].itertuples(index=False))
    assert rows == [(1, 1, "b", 1), (1, 1, "f", 2), (2, 5, "c", 1), (2, 5, "e", 2)]


def test_cliques_by_first_fit(spark):
    members = spark.createDataFrame([("x", m) for m in (3, 1, 2, 4, 4, 5)] + [("y", 7)], "grp string, member int")
    pairs = spark.createDataFrame([("x", 1, 3), ("x", 1, 4), ("x", 2, 4), ("x", 2, 5), ("x", 4, 5), ("z", 1, 2)], "grp string, i int, j int")
    got = {(r.grp, r.member): r.clique for r in merging.cliques(members, pairs).collect()}
    assert got == {("x", 1): 1, ("x", 3): 1, ("x", 2): 2, ("x", 4): 2, ("x", 5): 2, ("y", 7): 7}
    assert merging.cliques(members.where("false"), pairs).count() == 0
