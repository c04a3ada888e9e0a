"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import array
import base64
import hashlib
import pathlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.oracle import connect, same
from tracklake.llm import ann, bpe, common, entry, langid, media, near_dedup, packing, pii, resample, suffix_dedup, url_rules
from tracklake.sources import tables

SF = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n\t", "x", "Été d'été", "a" * 5000, "ab " * 3000, "one two", "ONE two", "one\ttwo", "😀 日本語 x", "İ!! ΣΑΣ", "tel +1 (269) 555-3296 4524132264652876 end", "a.b@c.de@f.gh 1.2.3.4.5.6.7.8 999.1.1.1", "<|endoftext|> hello", "a<|startoftext|>b \x1c c\x1dd it's\x85WE'LL e\xa0f", "word\x00zero"]


def texts(seed: int = 5, n: int = 60) -> list:
    """Odd texts, random prose, exact and near copies, and shared passages."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    out = list(ODD)
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    for i in range(n):
        w = [r.choice(vocabulary) for _ in range(r.randrange(1, 250))]
        out.append(" ".join(w))
        if i % 4 == 0:
            out.append(" ".join(w))
        if i % 3 == 0 and len(w) > 50:
            for _ in range(3):
                v = list(w)
                for _ in range(max(1, len(v) // 60)):
                    v[r.randrange(len(v))] = "changed"
                out.append(" ".join(v))
        if i % 5 == 0:
            out.append(" ".join(w[:10]) + " " + passage + " " + " ".join(w[10:20]))
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 + 1, t) for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With further columns whose names clash with those that operators make."""
    data = [(i, t, "en", "s", 0, 1, "h", True) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, n long, h string, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, k, percent).collect()}
    assert got == components(rows, k, percent)


def test_near_duplicates_of_a_base_with_unlike_copies(spark):
    """Copies that are linked with their base alone must meet it, wherever it stands."""
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(120):
        v = list(base)
        for k in r.sample(range(200), 5):
            v[k] = f"c{i}x{k}"
        made.append((i, " ".join(v)))
    made.append((500, " ".join(base)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == components(made, 3, 85)


@pytest.mark.parametrize("n,edits", [(100, 5), (700, 5)])
def test_near_duplicates_of_copies_without_their_base(spark, monkeypatch, n, edits):
    """Few of the copies are alike enough, and no text is the hub of those links."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    r = random.Random(n)
    base = [f"w{i}" for i in range(300)]
    made = []
    for i in range(n):
        v = list(base)
        for k in r.sample(range(300), edits):
            v[k] = f"c{i}x{k}"
        made.append((i, " ".join(v)))
    want = components(made, 3, 85)
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(df, 3, 85).collect()}
    assert got == want


def family(n, shared, own, planted, seed=1):
    """n texts of one template: shared words of `shared`, and `own` words of each text's own; every two make a planted pair."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(shared + own)]
    places = sorted(r.sample(range(shared + own), own))
    made = []
    for i in range(0, n, 2):
        v = list(template)
        for k in places:
            v[k] = f"o{i}x{k}"
        w = list(v)
        for k in r.sample(range(len(w)), planted):
            w[k] = f"p{i}x{k}"
        made += [(i, " ".join(v)), (i + 1, " ".join(w))]
    return made


@pytest.mark.parametrize("dear", [near_dedup.DEAR, 10**12, 0])
def test_near_duplicates_of_a_family(spark, dear, monkeypatch):
    """Pairs planted in a template's family, under rare shingles and in blocks."""
    monkeypatch.setattr(near_dedup, "DEAR", dear)
    monkeypatch.setattr(near_dedup, "PLAIN", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    made = family(400, 200, 40, 3)
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string").repartition(3), 3, 85).collect()}
    want = components(made, 3, 85)
    assert got == want and sum(k for *_, k in want.values()) == 200


def test_small_runs_stay_whole(spark, monkeypatch):
    """Neither the batches nor the tasks of the sorted trees cut a run of four values that isn't a large one."""
    monkeypatch.setattr(near_dedup, "HELD", 50)
    order = ["tree", *(f"s{i}" for i in range(near_dedup.DEPTH))]
    made = [(0, 1, 1, run, 1, j, 0, 0, 0) for run in range(40) for j in range(3)] + [(0, 1, 1, 99, 1, j, 0, 0, 0) for j in range(300)]
    table = pa.table(dict(zip(order, map(list, zip(*made)), strict=True)))
    out = list(near_dedup._whole(table.to_batches(max_chunksize=25)))
    assert sum(b.num_rows for b in out) == len(made)
    assert not any(a.column("s2")[-1] == b.column("s2")[0] != pa.scalar(99) for a, b in zip(out, out[1:]))
    trees = spark.createDataFrame(made, ", ".join(f"{c} int" for c in order))
    large = spark.createDataFrame([(0, 1, 1, 99, 1)], ", ".join(f"{c} int" for c in near_dedup.RUN))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = near_dedup.dealt(trees, large).select("s2", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == len(made) and len({r.task for r in parts}) > 1
    assert len({(r.s2, r.task) for r in parts if r.s2 != 99}) == 40 and len({r.task for r in parts if r.s2 == 99}) > 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90)], "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 90, 90: 90}


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover, new = bytearray(len(b)), set()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            if w in seen:
                cover[p : p + 50] = b"\1" * 50
            new.add(w)
        seen |= new
        runs = sum(c and not (p and cover[p - 1]) for p, c in enumerate(cover))
        out[i] = (len(b), sum(cover), runs, bytes(c for c, g in zip(b, cover, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot,many", [(4096, 64), (1, 64), (4096, 2), (3, 2)])
def test_suffix_dedup(docs, rows, hot, many, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, many=many).collect()}
    assert got == removed(rows)


def test_suffix_dedup_of_common_anchors(spark):
    """Sixteen bytes that stand in nearly every text, in different company, dealt by anchor and by context."""
    r = random.Random(12)
    made = [(i, "".join(r.choice("xyz ") for _ in range(r.randrange(40, 60))) + "aaaaaaaaaaaaaaaa" + "".join(r.choice("xyz ") for _ in range(r.randrange(20, 60)))) for i in range(200)]
    made += [(500 + i, "q" + made[i * 3][1][5:] + "w" * 20) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(5)
    for many in (64, 8):
        got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.remove_repeats(df, many=many).collect()}
        assert got == removed(made)


def test_suffix_order():
    r = np.random.default_rng(1)
    raw = r.integers(0, 2, (500, 56)).astype(np.uint8)
    raw[100:300] = raw[:200]
    raw[300:400, :40] = raw[0, :40]
    words = raw.reshape(500, 7, 8)[:, :, ::-1].copy().view(np.uint64).reshape(500, 7)
    order, group = suffix_dedup.deep_shallow(words)
    sorted_rows = [raw[i].tobytes() for i in order]
    assert sorted_rows == sorted(x.tobytes() for x in raw)
    assert all((group[i] == group[i + 1]) == (sorted_rows[i] == sorted_rows[i + 1]) for i in range(499))


def test_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(entry.RANKS, "rb"))}
    real = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_decode(docs, entry.RANKS).collect()}
    for i, t in rows:
        ids = real.encode_ordinary(t or "")
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_packing(docs, rows):
    real = Tokenizer.from_file(entry.WORDS)
    pieces = packing.pack_documents(docs, entry.WORDS).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for i, t in rows:
        ids = real.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(array.array("I", ids[at : at + p.length]).tobytes())
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW


def test_sum_of_squares_choice():
    r = random.Random(4)
    levels = packing.Levels(16)
    count = [0] * 17
    fill = {}
    for _ in range(2000):
        size = r.randrange(1, 17)
        before = list(count)

        def cost(h, size=size, before=before):
            c = list(before)
            if h:
                c[h] -= 1
            if h + size < 16:
                c[h + size] += 1
            return sum(x * x for x in c)

        least = min(cost(h) for h in range(0, 17 - size) if h == 0 or count[h])
        number, level, whole = levels.place(size)
        assert whole == size and cost(level) == least and fill.get(number, 0) == level
        fill[number] = level + size
        if level:
            count[level] -= 1
        if level + size < 16:
            count[level + size] += 1
    while sum(count):  # pieces that may be cut fill the gaps by the same rule
        number, level, part = levels.place(5, True)
        costs = {h: sum(x * x for x in count) - 2 * count[h] + 1 + (2 * count[h + 5] + 1 if h + 5 < 16 else 0) for h in range(1, 16) if count[h]}
        assert part == min(5, 16 - level) and fill[number] == level and costs[level] == min(costs.values())
        fill[number] += part
        count[level] -= 1
        if level + part < 16:
            count[level + part] += 1
    assert levels.place(5, True)[1:] == (0, 5)


def test_media(docs, rows):
    for r in media.store(docs).collect():
        raw = (dict(rows)[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64 or 64 * (not raw))
        assert bytes(r.payload) == padded and r.n_bytes == len(raw) and bytes(r.media[-len(padded) :]) == padded
        assert r.codec == "raw" and r.seconds == len(padded) / media.RATE
        assert all(bytes(r.media[k.start : k.end]) == padded[i * 1024 : i * 1024 + 64] for i, k in enumerate(r.keyframes))
    with pytest.raises(ValueError):
        list(media.walk(b"\0\0\0\x40moov"))
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    raw = dict(rows)
    for i, r in got.items():
        b = (raw[i] or "").encode()
        b += bytes(-len(b) % 64 or 64 * (not b))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), hashlib.sha256(b).hexdigest(), zlib.crc32(b[-64:]))


def plain_nearest(data, k=20):
    """Brute force over (vec_id, vector) rows; near ties in score are told by id after rounding."""
    v = {}
    for i, x in data:
        if x and len(x) == 24 and all(c is not None and np.isfinite(c) for c in x) and any(x):
            v[i] = min(v.get(i, x), x)
    ids = np.array(sorted(v))
    w = np.array([v[i] for i in ids.tolist()], np.float64)
    return {q: [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != q][:k] for q in ids.tolist() if q % 20 == 0 for score in (w @ v[q],)}


@pytest.mark.parametrize("copies", [0, 300])
def test_ann(spark, copies):
    """Plain rows, and such that a third or more are near or exact copies of one vector."""
    r = np.random.default_rng(3)
    v = r.standard_normal((400 + copies, 24)).astype(np.float32)
    v[50:90] = v[10]
    for i in range(400, 400 + copies):
        v[i] = v[11] if i % 2 else v[11] + r.standard_normal(24).astype(np.float32) * 1e-4
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2001, [0.0] * 24), (2020, [float("nan")] * 24), (2040, [None] * 24), (2060, [1.0]), (2080, [float("inf")] * 24), (20, v[20].tolist()), (40, v[41].tolist())]
    df = spark.createDataFrame([(*x, 0, 1) for x in data], "vec_id long, embedding array<float>, label int, score int").repartition(5)
    got = {}
    for x in ann.nearest(df, 20, 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = plain_nearest(data)
    assert got.keys() == want.keys() and all(len(got[q]) == 20 for q in got)
    for q in want:
        assert all(abs(a[1] - b[1]) < 1e-5 for a, b in zip(got[q], want[q], strict=True))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.97 * sum(map(len, want.values()))
    if copies:  # of exact copies those of the smallest ids
        assert [i for i, _ in got[100]] == [i for i, _ in want[100]]


def test_bounds_leave_rows_out():
    """Most rows are told apart by their codes alone, and what is left out isn't among the nearest."""
    r = np.random.default_rng(5)
    v = r.standard_normal((6000, 32))
    v[:, 0] += 3
    mean, turn = v.mean(axis=0), ann.rotation(32)
    x = v - mean
    norm = np.linalg.norm(x, axis=1)
    o = (x / norm[:, None]) @ turn
    fit = np.abs(o).sum(axis=1) / np.sqrt(o.shape[1])
    code = [c.tobytes() for c in np.packbits(o > 0, axis=1)]
    ids = np.arange(6000)
    search = ann.Search(ids[:50], v[:50], mean, turn, 20)
    for s in range(0, 6000, 1000):
        search.see(ids[s : s + 1000], v[s : s + 1000], code[s : s + 1000], norm[s : s + 1000], fit[s : s + 1000])
    want = np.argsort(-np.where(ids[:50, None] == ids, -np.inf, v[:50] @ v.T), axis=1)[:, :20]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(search.vec, want, strict=True)]) >= 19.5
    assert search.reranked < 0.35 * 50 * 6000


def test_ann_of_few_rows(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    got = ann.nearest(spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.1, 2.0]), (2, [0.3, 0.3])], schema)).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 2), (0, 2, 1)]
    assert got[0].score == 1.0 * 0.3 + 0.1 * 0.3 or got[1].score == 1.0 * 0.3 + 0.1 * 0.3


def test_language(spark):
    df = entry.op8_language(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = df.where("held_out").collect()
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_language_of_odd_texts(docs, rows):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    for i, t in rows:
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def plain_rank(text):
    """Rank order by a plain count."""
    from collections import Counter

    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        grams.update(w)
        p = f" {w} "
        grams.update(p[i : i + 2] for i in range(len(p) - 1))
        grams.update(p[i : i + 3] for i in range(len(p) - 2))
    return grams


def test_ngram_counts():
    for t in ("Der Hund, der bellt.", "a", "ab  cd\nef", "été"):
        _, _, n = langid.counted([t])
        assert sorted(n) == sorted(plain_rank(t).values())


def plain_hash(gram):
    """The 31-bit hash of an n-gram, with whole numbers; an edge is 0."""
    most = (1 << 64) - 1
    x = 0
    for c in gram:
        x = (x << 21) | (0 if c == " " else ord(c))
    x = (x + (1 << 60) if len(gram) == 2 else x) & most
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> 33
        x = x * m & most
    return (x ^ x >> 33) & langid.GRAM


def plain_profile(grams):
    """n-gram hash to rank of the most frequent ones."""
    order = sorted((-n, plain_hash(g)) for g, n in grams.items())[: langid.TOP]
    return {h: rank for rank, (_, h) in enumerate(order)}


def test_language_against_brute_force(spark, rows):
    """Profiles, ranks, distances and predictions by plain counting."""
    from collections import Counter

    languages = ["de", "en", "fr"]
    r = random.Random(9)
    vocabulary = {x: ["".join(r.choice("abcdefghijklmnopß éè"[k : k + 14].replace(" ", "")) for _ in range(r.randrange(2, 7))) for _ in range(80)] for k, x in enumerate(languages)}
    made = [(i, " ".join(r.choice(vocabulary[x]) for _ in range(r.randrange(1, 60))), x) for i in range(120) for x in [languages[i % 3]]]
    made += [(i + 1000, t, None) for i, t in rows] + [(5000, made[0][1] + " " + made[1][1], "fr"), (5001, "ab", None), (5001, "ab", None), (5002, None, "de")]
    counts = {x: Counter() for x in languages}
    for i, t, x in made:
        if x and t and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[x].update(plain_rank(t))
    profiles = {x: plain_profile(c) for x, c in counts.items()}
    got = langid.identify(spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)).collect()
    assert len(got) == len(made)
    by_id = {x.doc_id: x for x in got}
    for i, t, _ in made:
        own = plain_profile(plain_rank(t or ""))
        far = {x: sum(abs(p[h] - rank) if h in p else langid.TOP for h, rank in own.items()) for x, p in profiles.items()}
        want = min(languages, key=lambda x: (far[x], x)) if own else "und"
        assert by_id[i].lang_pred == want, t
        assert by_id[i].score == pytest.approx(1 - far[want] / (len(own) * langid.TOP) if own else 0.0)


def test_counts_of_very_long_texts_rank():
    """Counts beyond 2^20 still decide, before the hash does."""
    d, h, count = np.array([0, 0, 0, 0, 1, 1]), np.array([1, 2, 3, 9, 2, 5]), np.array([1 << 20, 1 << 33, (1 << 20) + 5, 1 << 33, 1, 7])
    assert [x.tolist() for x in langid.ranked(d, h, count)] == [[0, 0, 0, 0, 1, 1], [2, 9, 3, 1, 5, 2], [0, 1, 2, 3, 0, 1]]


def test_pii_patterns(spark):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    r = random.Random(3)
    some = [t or "" for t in ODD] + ["".join(r.choice("0123456789.@+ -()ab%_é") for _ in range(r.randrange(80))) for _ in range(3000)]
    for text in some:
        want = {}
        for kind, p in plain.items():
            want[kind] = []
            for m in re.finditer(p, text):
                digits = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                    want[kind].append(m.span())
        assert pii.base_spans(text) == want


def test_pii_field(spark, docs, empty):
    model = pii.fit(pii.labelled(spark))
    (_, every), (_, clean) = pii.spans_of([ODD[12], "Plain words in 2024, page 12 of 30."], *model)
    assert [k for k, _, _ in every] == ["card", "phone"] and clean == []
    for text in ("1" * 50000, "x@" * 20000, "a " * 20000 + "+1", "12 34567 " * 5000):
        pii.spans_of([text], *model)  # linear time
    out = pii.redact(docs, model)
    assert out.columns == docs.columns and "[PHONE] [CARD] end" in {(r.text or "")[4:] for r in out.collect()}
    assert pii.find(empty, model).count() == 0


@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(pii.labelled(spark))


def test_field_finds_its_own_templates(field):
    """Each template with digits not seen, announced and unannounced: found whole; what is no personal data is left alone."""
    import random

    r = random.Random(7)
    filled = lambda x: "".join(r.choice("0123456789") if c == "d" else c for c in x)
    for kind in pii.KINDS:
        for template in pii.CASES[kind]:
            for frame in ("we saw that {} was here", f"please {pii.ANNOUNCED[kind][0]} {{}} today"):
                found = 0
                for _ in range(20):
                    x = template if kind == "email" else filled(template)
                    at = frame.index("{")
                    found += (kind, at, at + len(x)) in pii.field_spans([frame.format(x)], *field)[0]
                assert found >= 19, (kind, template, frame, found)
    for template in pii.CASES[""]:
        for _ in range(20):
            (base, every), = pii.spans_of([f"we saw that {filled(template)} was here"], *field)
            assert len(every) == sum(map(len, base.values())), (template, every)


def test_shapes():
    assert [pii.shape(x) for x in ("ab12-Cd", "4111", "é9_x", "")] == ["add-a", "dddd", "ad_a", ""]


def test_field_on_forms_not_seen(field):
    """Sentences of other words and digits, in forms that the patterns don't know, and some that are no personal data."""
    found = {
        "please ring 0171 555 0134 today.": [("phone", 12, 25)], "tel 0044 20 7946 0958 now": [("phone", 4, 21)], "Fax (555) 123-4567, then": [("phone", 4, 18)],
        "my card 4111 1111 1111 1112 ok": [("card", 8, 27)], "the host 300.1.2.3 is up": [("ip", 9, 18)], "mail to me: 555-867-5309!": [("phone", 12, 24)]}
    for text, spans in found.items():
        (base, every), = pii.spans_of([text], *field)
        assert every == spans and not any(base.values()), text
    for text in ("ssn 123-45-6789 is", "Pages 12 of 30 in 2024", "order 12345678", "1,234 items in 12.5 kg on 2024-01-02 at 10:30", "id 1234567890 x", "call the card host"):
        assert pii.spans_of([text], *field)[0][1] == [], text


def test_field_gradient():
    """The gradients of the likelihood against differences."""
    r = np.random.default_rng(4)
    tags = pii.TAGS.index
    data = pii.grouped([(["call", "555-1234", "now"], [0, tags("B-phone"), 0]), (["a", "1.2.3.4"], [0, tags("B-ip")]), (["x@y.z", "12", "34"], [tags("B-email"), tags("B-card"), tags("I-card")])])
    w, t = r.standard_normal((pii.FEATURES, len(pii.TAGS))), r.standard_normal((len(pii.TAGS), len(pii.TAGS)))
    _, dw, dt = pii.likelihood(data, w, t)
    for grad, m in ((dw, w), (dt, t)):
        for i, j in zip(*np.nonzero(np.abs(grad) > 1e-3), strict=True):
            if r.random() < 0.2:
                keep = m[i, j]
                m[i, j] = keep + 1e-5
                up = pii.likelihood(data, w, t)[0]
                m[i, j] = keep - 1e-5
                assert (up - pii.likelihood(data, w, t)[0]) / 2e-5 == pytest.approx(grad[i, j], abs=1e-5)
                m[i, j] = keep


def test_windows_decode_as_whole_texts(field):
    w, t = field
    r = random.Random(1)
    some = ["a", "the", "tel", "card", "12", "4111", "(555)", "555-1234", "x@y.z", "+49", "host", "1.2.3.4", "2024", "order", "9", "0171"]

    def tagged(text, spans):
        path = pii.viterbi(pii.scores(pii.window_slots(text, spans), w)[None], t)[0]
        return [(spans[i], int(k)) for i, k in enumerate(path) if k]

    for _ in range(500):
        text = " ".join(r.choice(some if r.random() < 0.4 else some[:4]) for _ in range(r.randrange(1, 60)))
        whole = tagged(text, [m.span() for m in pii.WORD.finditer(text)])
        assert sorted(x for spans in pii.windows(text) for x in tagged(text, spans)) == whole


def test_viterbi_is_exact():
    r = np.random.default_rng(0)
    e, t = r.standard_normal((5, 4, 3)), r.standard_normal((3, 3))
    import itertools

    for x, path in zip(e, pii.viterbi(e, t), strict=True):
        best = max(itertools.product(range(3), repeat=4), key=lambda p: sum(x[i, p[i]] for i in range(4)) + sum(t[p[i], p[i + 1]] for i in range(3)))
        assert tuple(path) == best


def test_resampling(spark):
    df = entry.op10_resample(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").distinct(), "doc_id")
    kept = {r.quality: r.k for r in df.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("k")).collect()}
    assert kept[1] > 0.85 and kept[0] < 0.2
    keys = spark.range(50_000).select(F.col("id").alias("doc_id"), (F.pmod(F.xxhash64("id"), F.lit(2000)) / 1.0).alias("key"))
    for k in (1, 777, 30_000, 50_000):
        key, doc = resample.bar(keys, k)
        assert keys.where((F.col("key") > key) | ((F.col("key") == key) & (F.col("doc_id") <= doc))).count() == k


def test_resampling_against_brute_force(spark, rows):
    """Models, weights, draws and the kept set by plain counting."""
    import math

    made = [(i, t) for i, t in rows] + rows[:3]
    labels = [(i, int(i % 4 == 1), int(i % 5 == 0)) for i, _ in rows[::2]] + [(10**9, 1, None), (None, 1, 0), (rows[1][0], None, 1)]

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
        h = [int(common.words(*common.utf8(pa.array([x])))[0][0]) for x in w]
        pair = [int(common.mix(np.array([a], np.uint64) + common.mix(np.array([b], np.uint64) + np.uint64(1)))[0]) for a, b in zip(h, h[1:])]
        return [x % resample.BUCKETS for x in h + pair]

    good = {i for i, q, t in labels if i is not None and q == 1 and not t}
    every, target = [1] * resample.BUCKETS, [1] * resample.BUCKETS
    of = {}
    for i, t in made:
        of[i] = grams(t)
        for b in of[i]:
            every[b] += 1
            target[b] += i in good
    n, m = sum(every), sum(target)
    got = resample.resample(spark.createDataFrame(made, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(made)
    for r in got:
        weight = sum(math.log(target[b] / m) - math.log(every[b] / n) for b in of[r.doc_id])
        u = ((int(common.mix(common.mix(np.array([r.doc_id], np.uint64)) + np.uint64(11))[0]) >> 11) + 0.5) / (1 << 53)
        assert r.log_weight == pytest.approx(weight, abs=1e-9) and r.key == pytest.approx(weight - math.log(-math.log(u)), abs=1e-9)
    k = round(len(made) * sum(q == 1 and t != 1 for _, q, t in labels) / len(labels))
    order = sorted(((-r.key, r.doc_id) for r in got))
    assert {(r.key, r.doc_id) for r in got if r.kept} == {(-x, i) for x, i in order if (x, i) <= order[k - 1]}


def test_resampling_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept and r.log_weight == 0 for r in resample.resample(docs, none).collect())


URLS = [None, "no scheme", "http://", "https://A.Example.NET/en/x?q=1#f", "https://x.net", "https://x.net/?a", "http://notnet/x", "http://example.com/de/1", "http://b.example.com/fr/1", "http://q.org/fr/", "http://net/", "ftp://u@h:80/p/q.html"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*URLS, URLS[3]])], "page_id long, url string, rule string")
    labelled = spark.createDataFrame([(f"https://bad{i % 2}.example.com/win/{i}", True) for i in range(30)] + [(f"https://ok.example.com/news/{i}", False) for i in range(60)], "url string, bad boolean")
    got = {r.page_id: r for r in url_rules.judge(pages, labelled).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate([*URLS, URLS[3]]):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest)[0].translate(UPPER)
        path = re.split(r"[?#]", rest[len(host) :])[0]
        fits = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best[0])
        assert best[1] in (None, got[i].verdict)
    more = spark.createDataFrame([(1, "https://bad1.example.com/win/99"), (2, "https://ok.example.com/news/9")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in url_rules.judge(more, labelled).collect()} == {1: "block", 2: "allow"}
    assert url_rules.judge(more, labelled.limit(0)).where("verdict = 'allow'").count() == 2


def test_mined_rules_match_brute_force(spark):
    """All rules over the bounds, less those that a shorter one covers, and what they say of each url."""
    import itertools

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    labelled = pages.select("url", (F.col("page_id") % 3 == 0).alias("bad"))
    bounds = dict(support=0.05, confidence=0.4, least=1, lift=0.0, sure=0.0)
    mined = {frozenset(r.rule): r.confidence for r in url_rules.mine(labelled, **{**bounds, "sure": -99.0}).collect()}
    sets = [(frozenset(r.t), r.bad) for r in labelled.select(url_rules.tokens(F.col("url")).alias("t"), "bad").collect()]
    seen, hit = {}, {}
    for t, bad in sets:
        for size in range(1, len(t) + 1):
            for rule in map(frozenset, itertools.combinations(sorted(t), size)):
                seen[rule] = seen.get(rule, 0) + 1
                hit[rule] = hit.get(rule, 0) + bad
    every = {x: hit[x] / seen[x] for x in seen if hit[x] >= 0.05 * len(sets) - 1e-9 and hit[x] / seen[x] >= 0.4}
    want = {x: c for x, c in every.items() if not any(y < x and every[y] >= c for y in every)}
    assert mined == {x: pytest.approx(c) for x, c in want.items()} and len(want) > 3
    got = {r.page_id: r.confidence for r in url_rules.judge(pages, labelled, [], **{**bounds, "sure": -99.0}).collect()}
    for r in pages.select("page_id", url_rules.tokens(F.col("url")).alias("t")).collect():
        best = max((c for x, c in want.items() if x <= set(r.t)), default=None)
        assert got[r.page_id] == (best if best is None else pytest.approx(best))


@pytest.mark.parametrize("few", [url_rules.FEW, 0])
def test_mined_rules_on_pages_not_mined(spark, few, monkeypatch):
    """Rules from one half of the pages judge the other; chance alone makes none."""
    monkeypatch.setattr(url_rules, "FEW", few)
    r = random.Random(6)
    made = [(i, f"https://www{r.randrange(9)}.{'spam' if i % 4 == 0 else 'site'}{r.randrange(3)}.example.org/{r.choice(['a', 'b', 'c'])}/{i}/{'x' * 200 if i % 5 == 0 else 'y'}/z.html", (i % 4 == 0) if r.random() < 0.95 else r.random() < 0.5) for i in range(1200)]
    df = spark.createDataFrame(made, "page_id long, url string, bad boolean").cache()
    got = {x.page_id: x.verdict for x in url_rules.judge(df.where("page_id % 2 = 1 or page_id % 8 = 4"), df.where("page_id % 8 in (0, 2, 3, 5, 6)"), []).collect()}
    right = sum((got[i] == "block") == (i % 4 == 0) for i in got)
    assert right >= 0.98 * len(got)
    noise = df.select("url", (F.xxhash64("page_id") % 2 == 0).alias("bad"))
    assert url_rules.mine(noise).count() == 0


def test_empty_tables(empty, spark):
    model = pii.fit(pii.labelled(spark))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (near_dedup.near_duplicates(empty), suffix_dedup.remove_repeats(empty), packing.pack_documents(empty, entry.WORDS), media.digests(empty), media.store(empty), bpe.encode_decode(empty, entry.RANKS), langid.identify(empty), resample.resample(empty, labels), pii.find(empty, model), pii.redact(empty, model)):
        assert df.count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(pages, pages.select("url", F.lit(True).alias("bad"))).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty.drop("n", "h", "kept"), SF).count() == 0


def test_repeated_rows(spark, docs, rows):
    """Each operator's promise for a document that comes twice, in other partitions."""
    twice = docs.union(docs.where("doc_id % 2 = 0")).repartition(4)
    again = sum(i % 2 == 0 for i, _ in rows)
    model = pii.fit(pii.labelled(spark))
    for op in (lambda d: pii.find(d, model), lambda d: bpe.encode_decode(d, entry.RANKS), media.digests, lambda d: langid.predict(d, langid.fit(docs))):
        got = [tuple(r) for r in op(twice).collect()]
        assert len(got) == len(rows) + again and set(got) == {tuple(r) for r in op(docs).collect()}
    near = {tuple(r) for r in near_dedup.near_duplicates(twice).collect()}
    assert near == {tuple(r) for r in near_dedup.near_duplicates(docs).collect()}
    cut = {(r.doc_id, r.n_removed, bytes(r.kept)) for r in suffix_dedup.remove_repeats(twice).collect()}
    assert cut == {(i, x[1], x[3]) for i, x in removed(rows).items()}
    pieces = packing.pack_documents(twice, entry.WORDS).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t * (2 if r.doc_id % 2 == 0 else 1) for r in pieces) and len(pieces) == len(rows)


def test_word_kernel():
    import pyarrow as pa

    some = [t or "" for t in ODD]
    w, doc = common.words(*common.utf8(pa.array(some)))
    want = [(i, x) for i, t in enumerate(some) for x in re.findall(r"[^\x20\x09-\x0D]+", t.translate(UPPER))]
    assert doc.tolist() == [i for i, _ in want]
    names = {}
    assert all(names.setdefault(x, h) == h for (_, x), h in zip(want, w.tolist(), strict=True)) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_sql(spark, name):
    same(entry.QUERIES[name](spark, SF), connect(SF), entry.ORACLE[name])


def redacted(text, spans):
    """The text with each span replaced; of overlapping ones the first by place, then the longest."""
    out, at = "", 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += text[at:s] + f"[{kind.upper()}]"
        at = max(at, e)
        text = text[:at] + text[at:]
    return out + text[at:]


def test_pipeline_against_brute_force(spark, tmp_path, rows):
    """Whole stages on odd, repeated and clashing rows, with a further column; of clashing rows the smallest text stays."""
    clash = [(rows[0][0], "zz " + (rows[0][1] or "")), (9001, "one more text of some words here"), (9001, "another text of the same id, longer by far"), (9002, "call me at +49 170 5550 1234 now, or ring 0171 555 0134 or mail a.b@c.de, now")]
    data = [(i, t, "en", "s", len(t or ""), True) for i, t in [*rows, *rows[:3], *clash[1:]]]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept boolean").repartition(3)
    (tmp_path / "sf").mkdir()
    df.write.parquet(f"{tmp_path}/sf/documents.parquet")
    once = dict(sorted(rows + clash[1:], key=lambda x: (x[0], x[1] or ""), reverse=True))
    kept = [(i, t) for i, t in once.items() if any(c.isalpha() for c in t or "")]
    near = components(kept, 5, 80)
    kept = [(i, t) for i, t in kept if near[i][2]]
    cut = removed(kept)
    kept = [(i, cut[i][3].decode(errors="ignore")) for i, _ in kept if cut[i][1] < cut[i][0] or not cut[i][0]]
    model = pii.fit(pii.labelled(spark))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "sf"))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    want = {i: redacted(t, every) for (i, t), (_, every) in zip(kept, pii.spans_of([t for _, t in kept], *model), strict=True)}
    got = docs.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want)
    assert all(r.n_chars == len(r.text) for r in got) and want[9002] == "call me at [PHONE] now, or ring [PHONE] or mail [EMAIL], now"
    final = corpus_pipeline.run(spark, str(tmp_path / "sf"))
    assert {r.doc_id for r in final.select("doc_id").distinct().collect()} == set(want)


def shuffled(spark):
    """The shuffle files of a local session."""
    places = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in places for f in pathlib.Path(d).rglob("shuffle_*.data")}


def test_tables_and_shuffles_go_once_done_with(spark, docs, rows):
    """Only the last table of an operator stays, and a table's shuffle files go when it is written."""
    place, before = pathlib.Path(tables.shared_dir(spark)), shuffled(spark)
    there = set(place.iterdir())
    left = suffix_dedup.remove_repeats(docs)
    assert len(set(place.iterdir()) - there) == 1
    for _ in range(100):
        if shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffled(spark) <= before
    near = near_dedup.near_duplicates(docs)
    assert len(set(place.iterdir()) - there) == 2
    assert left.count() == near.count() == len(rows)
