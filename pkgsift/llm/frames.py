"""Files of zstandard frames, written and read by Spark's own file sources.

Spark's text writer writes the bytes of a column as they are, one row after the other in
the order of the partition, and needs a non-empty text between rows. An empty skippable
frame is such a text (it is plain ASCII) and is part of the zstandard format, so every
file is a valid zstandard stream whose frames are the rows. Files go through Spark's
commit protocol: a task that is repeated leaves no double and no partial file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Skippable frames: magic number and a length of 4 bytes, little-endian (fixed values of the format).
SKIP_LOW, SKIP_HIGH = 0x184D2A50, 0x184D2A5F
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", SKIP_LOW, 0)


def skippable(payload: bytes, magic: int = SKIP_LOW) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def write_frames(rows: DataFrame, path: str) -> str:
    """Write the binary column ``frame``, one file per partition, rows in their order."""
    rows.select(F.col("frame").cast("string").alias("value")).write.mode("errorifexists") \
        .option("lineSep", SEPARATOR.decode("ascii")).option("compression", "none").option("maxRecordsPerFile", 0).text(path)
    return path


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name, in the order of the partitions that wrote it), content binary."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content"))


def frames(content, decompressor: zstandard.ZstdDecompressor, at: int = 0) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, end, magic of a skippable frame or 0, its payload or the decoded frame), in file order."""
    view = memoryview(content)
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError(f"{len(view) - at} stray bytes at offset {at}")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIP_LOW <= magic <= SKIP_HIGH:
            end = at + 8 + size
            if end > len(view):
                raise ValueError(f"a skippable frame at offset {at} is cut short")
            yield at, end, magic, bytes(view[at + 8:end])
        else:
            one, out, end, step = decompressor.decompressobj(), [], at, 1 << 14
            while not one.eof:
                if end >= len(view):
                    raise ValueError(f"the frame at offset {at} is cut short")
                fed = view[end:end + step]
                try:
                    out.append(one.decompress(fed))
                except zstandard.ZstdError as e:
                    raise ValueError(f"the frame at offset {at} can't be decoded: {e}") from None
                end += len(fed)
                step = min(step * 2, 1 << 20)
            end -= len(one.unused_data)
            yield at, end, 0, b"".join(out)
        at = end


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most ``size`` bytes; with too few samples to train on, their raw bytes."""
    samples = [s for s in samples if s]
    if sum(map(len, samples)) >= 8 * size and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples, k=256, d=8, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def compressor(data: bytes, level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=dictionary(data), write_checksum=True, write_content_size=True)


def decompressor(data: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=dictionary(data))


def bounded_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """About ``bound`` rows (all, if there are fewer), chosen by a hash of ``key`` over the whole table."""
    n = rows.count()
    if n <= bound:
        return rows
    cut = int((1 << 40) * bound / n)
    return rows.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1 << 40)) < cut)
