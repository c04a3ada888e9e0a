"""Files of samples as a data source: WAV or raw little-endian 32-bit float, read by ranges of bytes.

    sound.register(spark)
    spark.read.format("samples").option("block", 4096).load(folder)

A file is cut into ranges of about `bytes` bytes, one partition each, so that one long file is read by many tasks. A task reads
the header of its file (some hundred bytes) and the blocks that begin in its range; nothing but sizes passes the driver.

Rows: file (its name), rate, block (from 0), samples (the first channel; only a file's last block is shorter). Names ending in .wav
are WAV (8, 16 or 32 bits whole, 32 bits float), all others raw with rate from the option. A WAV file that isn't one, or of another
coding, and an empty file give no rows. A partial last sample is left out.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, rate int, block long, samples array<double>"
# fixed values: how a format and bits are stored
CODES = {(1, 8): "u1", (1, 16): "<i2", (1, 32): "<i4", (3, 32): "<f4"}


class Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, size: int):
        super().__init__((path, begin, end, size))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Samples)


class Samples(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def placed(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or an address) and its path there."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def stored(blocks: DataFrame, folder: str) -> DataFrame:
    """Writes files of 32-bit float samples, .wav with a header and others raw: a row (file, bytes) for each.

    blocks: file, block, samples, rate, total (samples in the file). A task writes its files one after the other, block by
    block; a task that runs again writes the same files again.
    """

    def write(batches):
        where, at = placed(folder)
        where.create_dir(at)
        name, out, n = None, None, 0
        for batch in batches:
            for samples, about in zip(batch.column("samples"), batch.select(["file", "rate", "total"]).to_pylist(), strict=True):
                if about["file"] != name:
                    if out is not None:
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "bytes"])
                    name, out, n = about["file"], where.open_output_stream(f"{at}/{about['file']}"), 0
                    if name.lower().endswith(".wav"):
                        size, rate = 4 * about["total"], about["rate"]
                        n = out.write(b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, rate, 4 * rate, 4, 32) + b"data" + struct.pack("<I", size))
                n += out.write(samples.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], names=["file", "bytes"])

    rows = blocks.select("file", "block", "samples", "rate", F.col("total").cast("long").alias("total"))
    return rows.repartition("file").sortWithinPartitions("file", "block").mapInArrow(write, "file string, bytes long")


def layout(file, size: int, path: str, rate: int):
    """(rate, how samples are stored, channels, first byte, end) of a file, or None. Chunks are walked in any order."""
    if not path.lower().endswith(".wav"):
        return rate, "<f4", 1, 0, size
    head = file.read_at(min(12, size), 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= size:
        chunk = file.read_at(8, at)
        kind, length = chunk[:4], int.from_bytes(chunk[4:], "little")
        if kind == b"fmt " and at + 24 <= size:
            form = struct.unpack("<HHIIHH", file.read_at(16, at + 8))
        elif kind == b"data" and form:
            read = CODES.get((form[0], form[5]))
            return None if read is None or not form[1] else (form[2], read, form[1], at + 8, min(size, at + 8 + length))
        at += 8 + length + length % 2
    return None


class Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.block, self.bytes, self.rate = int(options.get("block", 65_536)), int(options.get("bytes", 1 << 26)), int(options.get("rate", 44_100))

    def partitions(self) -> list[Range]:
        where, at = placed(self.folder)
        one = where.get_file_info(at)
        files = [one] if one.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.size and not f.base_name.startswith(("_", ".")))
        return [Range(path, a, min(size, a + self.bytes), size) for path, size in files for a in range(0, size, self.bytes)]

    def read(self, partition: Range):
        path, begin, end, size = partition.value
        where = placed(self.folder)[0]
        with where.open_input_file(path) as file:
            found = layout(file, size, path, self.rate)
            if found is None:
                return
            rate, read, channels, first, last = found
            frame = np.dtype(read).itemsize * channels
            step, frames = self.block * frame, (last - first) // frame
            # the blocks whose first byte lies in the range
            for k in range(max(0, -((first - begin) // step)), -(-max(0, end - first) // step)):
                n = min(self.block, frames - k * self.block)
                if n > 0:
                    raw = np.frombuffer(file.read_at(n * frame, first + k * step), read)
                    samples = raw.reshape(-1, channels)[:, 0].astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([rate], pa.int32()), pa.array([k], pa.int64()), pa.array([samples], pa.list_(pa.float64()))], names=["file", "rate", "block", "samples"])
