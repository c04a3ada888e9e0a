"""Packing tokenised documents into windows by the sum-of-squares rule.

A document's ids are cut into full windows and a rest. Within a block of documents (dealt by a hash
of the id, about `BLOCK` documents each) the pieces arrive in the order of their ids; a piece goes to
the fill level, or to a new window, for which the sum over all levels of the squared count of
partially filled windows becomes least. The counts live in an array by level, with a stack of open
windows for each level. One document in `FLUID`, by a hash of its id, comes last in its block; its rest
may be cut. The same rule places it: at each level the choices are to go there whole or, where the gap is
smaller, to fill it with a first part, and what is left is placed again.
Windows still open at the block's end are padded, as a rule one a block.

Defined cases: a null or empty text has the end id alone; very long texts fill several windows; the names of
special tokens in a text become those tokens, as the tokenizer does by default; of equally good levels the
fullest is taken; repeated rows are packed as rows of their own, in any order; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklake.llm.common import U, blocks_for, cut, mix, rows, slices, text_only

WINDOW, END, BLOCK, MEMO, FLUID = 2048, 1, 8192, 400_000, 8
# The tokenizer's own split of lower-cased texts without UNSURE characters (of these, three digits and three fractions are
# the only numbers beyond 0-9).
SPLIT = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\t-\r\x20\x85\xa0]|_)+")

# Characters outside these blocks of letters, punctuation and symbols go to the tokenizer with their whole text.
UNSURE = regex.compile(r"[^\x00-\u012f\u0131-\u017e\u0180-\u024f\u0391-\u03a1\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3040-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")

SPLIT_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\t-\r\x20a-z0-9]+")
SIGMA = "\u03a3"  # str.lower looks at what stands about it, the tokenizer doesn't


class Words:
    """Ids of texts by a word tokenizer whose pre-tokens are encoded each by itself, once per worker."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, new: list[str]) -> None:
        """Notes the ids of each lower-case pre-token: encoded as one text, cut after the ids that end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(cuts) == len(new) and cuts[-1] == 4 * len(ids):
            raw = ids.tobytes()
            out = [raw[s:e] for s, e in zip([0, *cuts], cuts, strict=False)]
        else:
            out = [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.memo.update(zip(new, out, strict=True))

    def parts(self, text: str) -> list[str] | None:
        """The pre-tokens of a text, lower-cased as the tokenizer does; None: the text goes to the tokenizer whole."""
        if self.special.search(text):
            return None
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        return None if unsure(text) or SIGMA in text else SPLIT.findall(text.lower())

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. Each pre-token is looked up once; those not known are learned together."""
        split = [self.parts(t) for t in texts]
        every = [p for parts in split if parts for p in parts]
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        found = list(map(self.memo.get, every))
        if None in found:
            where = [i for i, x in enumerate(found) if x is None]
            new = {every[i] for i in where}
            if self.old:
                again = {p: self.old[p] for p in new if p in self.old}
                self.memo.update(again)
                new.difference_update(again)
            if new:
                self.learn(list(new))
            for i in where:
                found[i] = self.memo[every[i]]
        out, at = [], 0
        for text, parts in zip(texts, split, strict=True):
            if parts is None:  # special tokens are to be found, normalising may join or split pre-tokens, or the libraries' Unicode versions differ
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
            else:
                out.append(b"".join(found[at : at + len(parts)]))
                at += len(parts)
        return out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]


def unsure(text: str) -> bool:
    return not text.isascii() and (UNSURE.search(text) is not None or not unicodedata.is_normalized("NFC", text))


@lru_cache(2)
def tokenizer(path: str) -> Words:
    return Words(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """The pieces of each document: full windows, then the rest; ids: those of a rest that may be cut."""
    schema = [(c.split()[0], pa.int64()) for c in PIECES.split(", ")] + [("ids", pa.binary())]
    end = array("I", [END]).tobytes()

    def run(batches):
        own = tokenizer(path)
        for b in slices(batches, limit=1 << 18):
            out, kept = [], []
            doc_ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            fluid = mix(doc_ids.view(np.uint64)) % U(FLUID) == 0
            for doc, ids, cut_it in zip(doc_ids.tolist(), own.many(b.column("text").to_pylist()), fluid.tolist(), strict=True):
                ids += end
                for s in range(0, len(ids), 4 * WINDOW):
                    part = ids[s : s + 4 * WINDOW]
                    out.append((doc, s // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4))
                    kept.append(part if cut_it and len(part) < 4 * WINDOW else None)
            yield rows(schema, *np.array(out, dtype=np.int64).T, kept)
        own.old = {}  # the worker lives on for other stages; what they need is memory

    return text_only(docs).mapInArrow(run, PIECES + ", ids binary")


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # of the windows at each level; 0 and the last stay 0
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.made = 0

    def place(self, size: int, cuttable: bool = False) -> tuple[int, int, int]:
        """Window number, offset and length of the next piece, or of its first part if it is cuttable and a gap holds no more."""
        if size == self.window:
            self.made += 1
            return self.made - 1, 0, size
        c = self.count
        room = self.window - size  # the highest level with room
        # moving a window from level h to h + size changes the sum by 2 (c[h+size] - c[h]) + 2; a new one by 2 c[size] + 1
        high = self.window - 1 if cuttable else room
        change = np.empty(high, np.int64)
        change[:room] = 2 * (c[size + 1 : self.window + 1] - c[1 : room + 1]) + 2
        change[room - 1 :] = 1 - 2 * c[room : high + 1]  # a full window leaves the sum
        change = np.where(c[1 : high + 1] > 0, change, np.iinfo(np.int64).max)
        level = high - int(change[::-1].argmin())  # of equals the fullest level
        is_open = c[level] > 0
        if is_open and (cuttable or change[level - 1] <= 2 * c[size] + 1):
            c[level] -= 1
            number = self.open[level].pop()
        else:
            level, number = 0, self.made
            self.made += 1
        size = min(size, self.window - level)
        if level + size < self.window:
            c[level + size] += 1
            self.open[level + size].append(number)
        return number, level, size


def pack(parts: DataFrame, blocks: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    schema = [(c.split()[0], pa.int64()) for c in PIECES.split(", ")] + [("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        block, levels = None, Levels()
        for b in batches:
            out = []
            for k, doc, start, size, crc, total, ids in zip(*(b.column(c).to_pylist() for c in ("block", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")), strict=True):
                if k != block:
                    block, levels = k, Levels()
                at = 0
                while at < size:
                    number, offset, n = levels.place(size - at, ids is not None)
                    out.append((doc, start + at, n, crc if n == size else zlib.crc32(ids[4 * at : 4 * (at + n)]), total, (k << 40) + number, offset))
                    at += n
            if out:
                yield rows(schema, *np.array(out, dtype=np.int64).T)

    dealt = parts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    last = F.col("ids").isNotNull()
    return dealt.repartition(blocks, "block").sortWithinPartitions("block", last, "doc_id", "start").mapInArrow(run, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str) -> DataFrame:
    """Pieces of all documents with their places; path: a tokenizer file every executor has."""
    return pack(cut(pieces(docs, path)), blocks_for(docs, BLOCK))
