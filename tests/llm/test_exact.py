"""Exact duplicates as a stream against plain Python: any digest, many batches, restarts, odd rows."""

import hashlib
import re
import shutil
from collections import defaultdict

import pytest

from tests.llm.test_llm import SF, texts
from tests.oracle import connect, same
from tracklake.llm import entry
from tracklake.llm.exact_dedup import ExactDedup, exact_duplicates, pattern


def expected(rows):
    """rows: (doc_id, text) -> sorted (doc_id, keep_id, group_size, kept) and digests; repeated rows tie."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i, t))
    out = []
    for norm, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1], m[2] or 0))
        sha = hashlib.sha256(norm.encode()).hexdigest()
        for n, (_, _, i, _) in enumerate(members):
            out.append((i, members[0][2], len(members), n == 0, sha))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    some = [(i * 7 % 1009, t) for i, t in enumerate(texts())]
    copies = [(2000 + i, "the same\t text" + " " * (i % 3)) for i in range(700)]
    return [*some, *copies, (5, "a b"), (5, "a b"), (None, "ab"), (None, "only null"), (9000, None), (9001, "x\x00y"), (9002, "x\x0b\x00 y"), (9003, "x y"), (9004, "x y")]


def write(spark, rows, path, parts=4):
    spark.createDataFrame([(i, t, 1, "d", "f") for i, t in rows], "doc_id long, text string, n long, digest string, file string").repartition(parts).write.parquet(path)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_all_at_once(spark, rows, tmp_path):
    write(spark, rows, f"{tmp_path}/docs")
    assert result(exact_duplicates(spark, f"{tmp_path}/docs")) == expected(rows)


@pytest.mark.parametrize("width", [1, 2, 64])
def test_weak_digests_are_told_apart_by_bytes(spark, rows, tmp_path, width):
    write(spark, rows, f"{tmp_path}/docs")
    dedup = ExactDedup(spark, f"{tmp_path}/docs", width=width, files=1)
    dedup.advance()
    assert result(dedup.duplicates()) == expected(rows)
    assert dedup._log("unequal", "digest string, epoch int").isEmpty() == (width == 64)


def test_batches_and_restarts(spark, rows, tmp_path):
    source, home = f"{tmp_path}/docs", f"{tmp_path}/home"
    third = len(rows) // 3
    for n in range(3):
        part = f"{tmp_path}/part{n}"
        write(spark, rows[n * third : (n + 1) * third if n < 2 else None], part, 2)
        shutil.copytree(part, source, dirs_exist_ok=True, ignore=shutil.ignore_patterns("_SUCCESS", "*.crc"))
        dedup = ExactDedup(spark, source, home, files=1)  # a new object each time: all state is on disk
        dedup.arrive()
        if n == 1:  # stopped between two steps, and begun again
            dedup = ExactDedup(spark, source, home, files=1)
        dedup.advance()
        assert result(dedup.duplicates()) == expected(rows[: (n + 1) * third] if n < 2 else rows)
    before = result(dedup.duplicates())
    dedup.advance()  # nothing new
    assert result(dedup.duplicates()) == before


def test_state_keeps_the_first_row(spark, tmp_path):
    write(spark, [(9, "a")], f"{tmp_path}/docs", 1)
    dedup = ExactDedup(spark, f"{tmp_path}/docs", f"{tmp_path}/home")
    dedup.advance()
    write(spark, [(3, "a "), (4, " a")], f"{tmp_path}/more", 1)
    shutil.copytree(f"{tmp_path}/more", f"{tmp_path}/docs", dirs_exist_ok=True, ignore=shutil.ignore_patterns("_SUCCESS", "*.crc"))
    dedup.advance()
    (known,) = dedup.known().collect()
    assert (known.n, known.first.doc_id, known.best.doc_id) == (3, 9, 3)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    df = exact_duplicates(spark, f"{tmp_path}/docs")
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0


def test_single_file_and_settings(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    same(entry.QUERIES["op13_exact_dedup"](spark, SF), connect(SF), entry.ORACLE["op13_exact_dedup"])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert pattern("/a/b.parquet") == "/a/b.parque[t]"
