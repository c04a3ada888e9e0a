"""Byte-level BPE by a sentencepiece model that is serialised here straight from a rank file.

Each byte is mapped to a character of its own, each token to the piece of its bytes' characters,
scored by its negative rank, so that sentencepiece merges in the order of the ranks; normalisation
is the identity. Texts are split into pre-tokens first; each distinct pre-token is encoded once per
Python worker (a memo of two generations of about `MEMO` entries). Decoding maps ids back to bytes.

Defined cases: a null text is empty and has no ids; texts of any length; each piece has a rank of its own, so merges
have no ties; repeated rows give equal results; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from tracklake.llm.common import rows, slices, text_only

MEMO = 120_000
# White space as the Unicode property has it, which the pattern's \s stands for.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
# A byte's character: letters from U+0100 on, none of which sentencepiece treats apart.
CHARS = [chr(0x100 + b) for b in range(256)]
GAP = chr(0x3000)


def pattern(source: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pre-token pattern with \\s and \\S spelled out."""
    inside = source.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]")
    return regex.compile(inside.replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))


def splitter():
    """Gives the pre-tokens of a text; the same pattern for ASCII alone is faster."""
    every = pattern().findall
    plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r\x20A-Za-z0-9]+|[\t-\r\x20]+(?![^\t-\r\x20])|[\t-\r\x20]+").findall
    return lambda text: (plain if text.isascii() else every)(text)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks, which are their ids."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [found[i] for i in range(len(found))]


def _field(number: int, kind: int, payload: bytes) -> bytes:
    return _varint(number << 3 | kind) + (_varint(len(payload)) if kind == 2 else b"") + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file: the tokens' pieces by rank, then the unknown piece."""
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(CHARS[b] for b in token).encode()
        out += _field(1, 2, _field(1, 2, piece) + _field(2, 5, struct.pack("<f", -float(rank))))
    out += _field(1, 2, _field(1, 2, b"<unk>") + _field(3, 0, _varint(2)))
    trainer = _field(3, 0, _varint(2)) + _field(4, 0, _varint(len(tokens) + 1))  # BPE, vocabulary size
    trainer += _field(40, 0, _varint(len(tokens))) + b"".join(_field(n, 0, _varint((1 << 64) - 1)) for n in (41, 42, 43))
    out += _field(2, 2, trainer)
    normalizer = _field(1, 2, b"identity") + b"".join(_field(n, 0, _varint(0)) for n in (3, 4, 5))
    return bytes(out + _field(3, 2, normalizer))


class Codec:
    """Encodes pre-tokens to ids joined by spaces, and back."""

    def __init__(self, path: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.bytes_of = {str(i): t for i, t in enumerate(self.tokens)}
        self.gap = f" {len(self.tokens)} "
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        ask = []
        for token in new:
            raw = token.encode()
            if raw in self.whole:
                self.memo[token] = str(self.whole[raw])
            else:
                ask.append(token)
        for s in range(0, len(ask), 1000):  # one call for many: the unknown character between them stays a piece by itself
            some = ask[s : s + 1000]
            mapped = GAP.join([t.encode().decode("latin-1").translate(_TO_CHARS) for t in some])
            found = " ".join(map(str, self.model.encode(mapped))).split(self.gap)
            self.memo.update(zip(some, found, strict=True))

    def encode(self, texts: list[str], split) -> list[str]:
        """Each text's ids, joined by spaces; split: gives a text's pre-tokens."""
        parts = [split(t) for t in texts]
        every = [p for some in parts for p in some]
        if len(self.memo) > MEMO:
            self.old, self.memo = self.memo, {}
        found = list(map(self.memo.get, every))  # each pre-token is looked up once; those not known are learned together
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
        for some in parts:
            out.append(" ".join(found[at : at + len(some)]))
            at += len(some)
        return out

    def decode(self, ids: str) -> bytes:
        of = self.bytes_of
        return b"".join(map(of.__getitem__, ids.split(" "))) if ids else b""


_TO_CHARS = {b: CHARS[b] for b in range(256)}


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text; path: a rank file every executor has."""
    schema = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]

    def run(batches):
        own, split = codec(path), splitter()
        for b in slices(batches, limit=1 << 18):
            out = []
            for ids in own.encode(b.column("text").to_pylist(), split):
                out.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield rows(schema, b.column("doc_id").to_numpy(zero_copy_only=False), *map(list, zip(*out, strict=True)))

    return text_only(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
