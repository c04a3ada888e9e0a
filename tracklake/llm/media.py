"""Media columns: texts as the samples of ISO media files, and features read from the boxes alone.

A payload (UTF-8, zeros appended up to a positive multiple of 64) is stored as one track of raw
8-bit samples, 64 of them an access unit; every `SYNC`-th unit is a sync sample. `describe` walks the
nested boxes and the sample tables (stsd, mdhd, stts, stsc, stsz, stco or co64, stss) and gives
codec, duration and the byte ranges of sync samples without looking at the payload; `payload`
gathers the bytes of all samples.

Defined cases: a null text is empty and is stored as 64 zeros; equal texts give equal bytes; texts
of any length below 4 GB; a file with a broken box raises ValueError; repeated rows give equal rows; an empty
table gives an empty result; extra columns are ignored. `digests` reads each file back in the task that made it, so
no media bytes leave the task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tracklake.llm.common import rows, slices, text_only

UNIT, RATE, SYNC, CHUNK = 64, 8000, 16, 32
PARENTS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def mux(payload: bytes) -> bytes:
    """An ISO media file with the payload (a multiple of UNIT bytes) as raw 8-bit samples."""
    units = len(payload) // UNIT
    chunks, rest = divmod(units, CHUNK)
    to_chunk = [(1, CHUNK)] * bool(chunks) + [(chunks + 1, rest)] * bool(rest)
    sync = range(1, units + 1, SYNC)
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    head = box(b"ftyp", b"isom", bytes(4), b"isommp42")

    def moov(at: int) -> bytes:
        places = [at + i * CHUNK * UNIT for i in range(chunks + bool(rest))]
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, units, UNIT)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(to_chunk)), *(struct.pack(">III", f, n, 1) for f, n in to_chunk)),
            full(b"stsz", struct.pack(">II", UNIT, units)),
            full(b"stco", struct.pack(f">I{len(places)}I", len(places), *places)),
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", struct.pack(">I", 1)))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(payload), 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        tkhd = box(b"tkhd", struct.pack(">I", 7), struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(payload), 0, 0, 256, 0), matrix, bytes(8))
        mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, len(payload), 1 << 16, 256), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    return head + moov(len(head) + len(moov(0)) + 8) + box(b"mdat", payload)


def walk(data, start: int = 0, end: int | None = None, path: tuple = ()):
    """(path, start, end) of each box's content, nested boxes after their parent."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError(f"box header cut at byte {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        begin = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, begin)
            begin += 8
        size = size or end - start
        if start + size > end or begin > start + size:
            raise ValueError(f"box of {size} bytes at byte {start} exceeds its parent")
        yield (*path, kind), begin, start + size
        if kind in PARENTS:
            yield from walk(data, begin, start + size, (*path, kind))
        start += size


def tables(data) -> list[dict]:
    """For each track: codec, rate, duration, and offset, size, time and sync of its samples."""
    tracks: list[dict] = []
    for path, s, e in walk(data):
        if path[-1] == b"trak":
            tracks.append({})
        if not tracks or b"trak" not in path:
            continue
        t, u32 = tracks[-1], (lambda at, n, s=s: struct.unpack_from(f">{n}I", data, s + at))
        if path[-1] == b"mdhd":
            t["rate"], t["duration"] = struct.unpack_from(">16xIQ" if data[s] else ">8xII", data, s + 4) if data[s] else struct.unpack_from(">II", data, s + 12)
        elif path[-1] == b"stsd":
            t["codec"] = bytes(data[s + 12 : s + 16]).decode("latin-1")
        elif path[-1] == b"stts":
            t["times"] = [u32(8 + 8 * i, 2) for i in range(u32(4, 1)[0])]
        elif path[-1] == b"stss":
            t["sync"] = list(u32(8, u32(4, 1)[0]))
        elif path[-1] == b"stsc":
            t["chunks"] = [u32(8 + 12 * i, 2) for i in range(u32(4, 1)[0])]
        elif path[-1] == b"stsz":
            one, n = u32(4, 2)
            t["sizes"] = [one] * n if one else list(u32(12, n))
        elif path[-1] in (b"stco", b"co64"):
            n = u32(4, 1)[0]
            t["places"] = list(struct.unpack_from(f">{n}{'Q' if path[-1] == b'co64' else 'I'}", data, s + 8))
    for t in tracks:
        t["offsets"], k, runs = [], 0, [*t.get("chunks", []), (len(t.get("places", [])) + 1, 0)]
        for (first, n), (after, _) in zip(runs, runs[1:], strict=False):
            for c in range(first - 1, after - 1):
                at = t["places"][c]
                for size in t["sizes"][k : k + n]:
                    t["offsets"].append(at)
                    at += size
                k += n
    return tracks


def described(track: dict) -> dict:
    """Codec, duration in seconds, samples, and the byte ranges of sync samples, of a track's tables."""
    t = track
    sync = t.get("sync") or range(1, len(t["sizes"]) + 1)  # without a table all samples are sync samples
    ranges = [(t["offsets"][i - 1], t["offsets"][i - 1] + t["sizes"][i - 1]) for i in sync]
    return {"codec": t["codec"].strip(), "seconds": sum(n * d for n, d in t["times"]) / t["rate"], "samples": len(t["sizes"]), "keyframes": ranges}


def gathered(data, track: dict) -> bytes:
    """The bytes of all samples of a track, in order."""
    return b"".join([bytes(data[o : o + n]) for o, n in zip(track["offsets"], track["sizes"], strict=True)])


def describe(data) -> dict:
    """What the boxes of the first track tell, without a look at the payload."""
    return described(tables(data)[0])


def payload(data) -> bytes:
    return gathered(data, tables(data)[0])


def stored(text: str) -> tuple[int, bytes, bytes, dict]:
    """Bytes of a text, its media file, and what is read back from that: payload and description."""
    raw = text.encode()
    media = mux(raw + bytes(-len(raw) % UNIT if raw else UNIT))
    track = tables(media)[0]
    return len(raw), media, gathered(media, track), described(track)


MEDIA = "doc_id long, n_bytes long, media binary, payload binary, codec string, seconds double, samples long, keyframes array<struct<start:long,end:long>>"


def store(docs: DataFrame) -> DataFrame:
    """Each text's media file with the columns read from its boxes; payload: the bytes read back."""
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", pair)]

    def run(batches):
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                n, media, back, d = stored(text)
                out.append((n, media, back, d["codec"], d["seconds"], d["samples"], [{"start": s, "end": e} for s, e in d["keyframes"]]))
            yield rows(schema, b.column("doc_id"), *map(list, zip(*out, strict=True)))

    return text_only(docs).mapInArrow(run, MEDIA)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, lengths, checksums and a feature string for each text, as `store` would write and read it."""
    schema = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def run(batches):
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                n, media, back, d = stored(text)
                first, last = d["keyframes"][0], d["keyframes"][-1]
                feature = f"codec={d['codec']};seconds={d['seconds']:.6f};samples={d['samples']};keyframes={len(d['keyframes'])};first={first[0]}-{first[1]};last={last[0]}-{last[1]}"
                out.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield rows(schema, b.column("doc_id"), *map(list, zip(*out, strict=True)))

    return text_only(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
