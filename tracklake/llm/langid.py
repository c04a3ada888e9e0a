"""Language identification by rank-order profiles.

A profile is the list of the `TOP` most frequent letter n-grams (one to three letters, a word's edges
counting as a letter), most frequent first. A document takes the language whose profile is nearest
by the out-of-place distance: the sum over its own n-grams of how far each is from its place in the
profile, `TOP` if it is not there. The score is one less the distance's share of the largest possible.

Profiles are fitted to a bounded sample: about `SAMPLE` labelled texts a language, chosen by a hash of
doc_id, of the `LANGS` languages with most texts. Defined cases: a text that is null or has no letter gives `und`
with score 0; n-grams of equal count rank by their hash; ties go to the language first in the alphabet; without any
labelled text all are `und`; very long texts are counted whole, without a bound on counts; repeated rows give equal results; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.llm.common import U, mix, rows, slices, text_only

TOP, SAMPLE, LANGS = 300, 2000, 4096
GRAM = (1 << 31) - 1
_letters: list[np.ndarray] = []


def is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][points]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers (below 8192) and 31-bit n-gram hashes, in no order."""
    low = [t.lower() for t in texts]
    points = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    letter = is_letter(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True  # of several other characters in a row the first stays, as an edge
    point = np.where(letter, points, 0).astype(np.uint64)[keep]
    doc = np.concatenate([doc, doc[-1:] if len(doc) else [0]])[keep]
    here = point > 0
    parts = [(doc[here], mix(point[here]))]
    if len(point) > 1:
        pair = (point[:-1] << U(21)) | point[1:]
        ok = here[:-1] | here[1:]
        # an edge before a word belongs to the word's text
        parts.append((np.where(here[:-1], doc[:-1], doc[1:])[ok], mix(pair[ok] + U(1 << 60))))
    if len(point) > 2:
        ok = here[1:-1]
        parts.append((doc[1:-1][ok], mix((pair[:-1][ok] << U(21)) | point[2:][ok])))
    d, h = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    return d, h & U(GRAM)


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and count of each n-gram of each text."""
    d, h = grams(texts)
    key = (d.astype(np.uint64) << U(31)) | h
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> U(31)).astype(np.int64), (key[first] & U(GRAM)).astype(np.int64), count


def ranked(d: np.ndarray, h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, n-gram and rank of the TOP most frequent n-grams of each text; ties by hash.

    The n-grams come in order of text and hash, as `counted` gives them.
    """
    # no text has 2^40 n-grams; the sort is stable, so equal counts stay in the order of the hash
    order = np.argsort((d.astype(np.uint64) << U(40)) | (U(1 << 40) - count.astype(np.uint64)), kind="stable")
    d, h = d[order], h[order]
    rank = np.arange(len(d)) - np.searchsorted(d, d)
    keep = rank < TOP
    return d[keep], h[keep], rank[keep]


def fit(labelled: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """For each language (column lang) its profile: n-grams in order, and their ranks."""
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    shares = sizes.select("lang", F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n")).alias("share")).collect()  # a row a language, at most LANGS
    if not shares:
        return []
    shares = F.broadcast(labelled.sparkSession.createDataFrame(shares, "lang string, share double"))
    chosen = labelled.join(shares, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def run(batches):
        schema = [("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())]
        for b in slices(batches):
            lang = np.array(b.column("lang").to_pylist(), object)
            for one in sorted(set(lang)):
                text = "\n".join(t for t, x in zip(b.column("text").to_pylist(), lang, strict=True) if x == one)
                _, h, n = counted([text])
                yield rows(schema, [one] * len(h), h, n)

    counts = chosen.select("text", "lang").mapInArrow(run, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))
    top = counts.withColumn("rank", place - 1).where(F.col("rank") < TOP).collect()  # TOP rows a language
    out = []
    for lang in sorted({r.lang for r in top}):
        own = sorted((r.h, r.rank) for r in top if r.lang == lang)
        out.append((lang, np.array([h for h, _ in own]), np.array([k for _, k in own])))
    return out


def score(texts: list[str], profiles: list) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n = len(texts)
    d, h, rank = ranked(*counted(texts))
    own = np.bincount(d, minlength=n)
    if not profiles:
        return ["und"] * n, np.zeros(n)
    far = np.empty((len(profiles), n))
    for i, (_, grams_, ranks) in enumerate(profiles):
        k = np.minimum(np.searchsorted(grams_, h), len(grams_) - 1)
        apart = np.where(grams_[k] == h, np.abs(ranks[k] - rank), TOP)
        far[i] = np.bincount(d, weights=apart, minlength=n)
    best = far.argmin(axis=0)
    names = [profiles[b][0] if c else "und" for b, c in zip(best, own, strict=True)]
    return names, np.where(own > 0, 1 - far.min(axis=0) / np.maximum(own * TOP, 1), 0.0)


def predict(docs: DataFrame, profiles: list) -> DataFrame:
    """doc_id, lang_pred and score; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # TOP n-grams a language
    schema = [("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]

    def run(batches):
        for b in slices(batches):
            yield rows(schema, b.column("doc_id"), *score(b.column("text").to_pylist(), shared.value))

    return text_only(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, profiles: list) -> DataFrame:
    """The documents (all their columns) whose text has a language."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)  # TOP n-grams a language

    def run(batches):
        for b in slices(batches):
            names, _ = score([t or "" for t in b.column("text").to_pylist()], shared.value)
            yield b.filter(pa.array([x != "und" for x in names], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score, learned from the documents that are not held out."""
    learn = docs.select("doc_id", "text", "lang").where(~held_out())
    return predict(docs, fit(learn)).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
