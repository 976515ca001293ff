"""Token ids in binary shard files: a zstandard frame per document under one shared dictionary.

Layout below the output folder:

``dictionary/``  one file whose first skippable frame holds the dictionary, trained on the
                 serialised ids of a bounded sample of documents;
``shards/``      files in ascending order of doc_id. A shard begins with a skippable frame
                 (JSON: format, id width, SHA-256 of the dictionary), then has one frame per
                 document, and ends with a skippable frame that holds the offset index.

The index is ``doc_ids, offsets, lengths, n_tokens`` (64-bit little-endian arrays) and a
trailer of fixed size, so one document is found by a binary search and one short read.

Defined results: null texts count as empty and hold only the end id; null doc_ids come first
and are read back as null; equal doc_ids keep one frame each, ordered by the hash of their
text. Extra columns are dropped. An empty table gives shards without documents.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import frames as Z
from .common import parts_for, slices, unclash
from .op6_bpe import Vocabulary, codec, default_vocabulary

FORMAT = "token-shard-1"
INDEX_MAGIC = Z.SKIP_LOW + 1
#: n_docs, n_tokens, length of the index (big-endian, so that SQL reads them), end mark.
TRAILER = ">QQQ8s"
TRAILER_BYTES = struct.calcsize(TRAILER)
MARK = b"TOKIDX01"
#: doc_id of a null in the index.
NULL_ID = -(1 << 63)
#: Text bytes per shard, sample of documents and size of the shared dictionary.
SHARD_BYTES = 16 << 20
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 32 << 10


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, end_id: int | None):
    """(doc_ids, ids, offsets) of each piece of the batches, the end id included."""
    c = codec(vocabulary)
    for batch in batches:
        for piece, data, offs in slices(batch, "text"):
            ids, at = c.encode(data, offs)
            if end_id is not None:
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
            yield piece.column(0).to_pylist(), ids, at


def shared_dictionary(docs: DataFrame, vocabulary, end_id: int | None, width: str) -> bytes:
    """Trained in one task on a sample bounded in documents and bytes; only the dictionary reaches the driver."""

    def train(batches):
        samples, total = [], 0
        for _, ids, at in encoded(batches, vocabulary.value, end_id):
            flat = ids.astype(width)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if total < SAMPLE_BYTES:
                    samples.append(flat[a:b][:SAMPLE_BYTES - total].tobytes())
                    total += len(samples[-1])
        yield pa.RecordBatch.from_arrays([pa.array([Z.train_dictionary(samples, DICTIONARY_BYTES)], pa.binary())], names=["data"])

    sample = Z.bounded_sample(docs, "doc_id", SAMPLE_DOCS).repartition(1)
    one = sample.mapInArrow(train, "data binary").first()  # no row if Spark finds the table empty
    return bytes(one["data"]) if one else b""


def write(docs: DataFrame, path: str, vocabulary: Vocabulary, end_id: int | None = 2) -> str:
    """Encode whole texts and write dictionary and shards below ``path`` (a folder that all executors share)."""
    spark = docs.sparkSession
    rows = unclash(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = spark.sparkContext.broadcast(vocabulary)
    width = "<u2" if max(max(vocabulary.vocab.values(), default=0), end_id or 0) < 1 << 16 else "<u4"
    data = shared_dictionary(rows, shared, end_id, width)
    sha = hashlib.sha256(data).hexdigest()
    Z.write_frames(spark.createDataFrame([(Z.skippable(data, Z.DICTIONARY_MAGIC),)], "frame binary").coalesce(1), f"{path}/dictionary")
    head = Z.skippable(json.dumps({"format": FORMAT, "ids": width, "dictionary_sha256": sha}).encode())

    def run(batches):
        press = Z.compressor(data)
        doc_ids, offsets, sizes, counts = [], [], [], []
        pos = len(head) + len(Z.SEPARATOR)
        yield pa.RecordBatch.from_arrays([pa.array([head], pa.binary())], names=["frame"])
        for ids_of, ids, at in encoded(batches, shared.value, end_id):
            flat = memoryview(ids.astype(width).tobytes())
            w = int(width[-1])
            cut = at.tolist()
            out = [press.compress(flat[a * w:b * w]) for a, b in zip(cut[:-1], cut[1:])]
            length = np.array([len(x) for x in out], np.int64)
            step = length + len(Z.SEPARATOR)
            doc_ids.append(np.array([NULL_ID if i is None else i for i in ids_of], np.int64))
            offsets.append(pos + np.cumsum(step) - step)
            sizes.append(length)
            counts.append(np.diff(at))
            pos += int(step.sum())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["frame"])
        flat = [np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8") for x in (doc_ids, offsets, sizes, counts)]
        body = b"".join(x.tobytes() for x in flat)
        body += struct.pack(TRAILER, len(flat[0]), int(flat[3].sum()), len(body), MARK)
        yield pa.RecordBatch.from_arrays([pa.array([Z.skippable(body, INDEX_MAGIC)], pa.binary())], names=["frame"])

    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(parts_for(spark, total, SHARD_BYTES), *order).sortWithinPartitions(*order)
    Z.write_frames(dealt.mapInArrow(run, "frame binary"), f"{path}/shards")
    return path


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    content = Z.read_files(spark, f"{path}/dictionary").select("content").collect()  # one file of DICTIONARY_BYTES
    for row in content:
        for _, _, magic, payload in Z.frames(row["content"], Z.decompressor(b"")):
            if magic == Z.DICTIONARY_MAGIC:
                return payload
    raise ValueError(f"no dictionary below {path}")


def index_of(content: bytes) -> tuple[dict, np.ndarray]:
    """(header, index with rows doc_ids, offsets, lengths, n_tokens) of a shard, checked."""
    magic, size = struct.unpack_from("<II", content, 0)
    header = json.loads(bytes(content[8:8 + size])) if magic == Z.SKIP_LOW else {}
    end = len(content) - len(Z.SEPARATOR)
    n, tokens, length, mark = struct.unpack_from(TRAILER, content, end - TRAILER_BYTES)
    if header.get("format") != FORMAT or mark != MARK or length != 32 * n:
        raise ValueError("not a token shard, or cut short")
    index = np.frombuffer(content, "<i8", 4 * n, end - TRAILER_BYTES - length).reshape(4, n)
    if int(index[3].sum()) != tokens:
        raise ValueError("the index doesn't add up")
    return header, index


def read(spark: SparkSession, path: str, wanted: list[int] | None = None) -> DataFrame:
    """file, pos, doc_id, local_start, ids (array of int): all documents, or the ``wanted`` doc_ids by the index."""
    return _scan(spark, path, wanted, "ids array<int>", lambda ids: ids.astype(np.int32).tolist(), pa.list_(pa.int32()))


def _scan(spark: SparkSession, path: str, wanted, field: str, value, kind: pa.DataType) -> DataFrame:
    data = read_dictionary(spark, path)
    sha = hashlib.sha256(data).hexdigest()

    def run(batches):
        press = Z.decompressor(data)
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                content = memoryview(content.as_buffer())
                header, (doc_ids, offsets, sizes, counts) = index_of(content)
                if header["dictionary_sha256"] != sha:
                    raise ValueError(f"{file} needs another dictionary")
                start = np.cumsum(counts) - counts
                rows = np.arange(len(doc_ids)) if wanted is None else np.flatnonzero(np.isin(doc_ids, np.array(wanted, np.int64)))
                for a in range(0, len(rows), 1000):
                    r = rows[a:a + 1000]
                    out = []
                    for o, s, n in zip(offsets[r].tolist(), sizes[r].tolist(), counts[r].tolist()):
                        ids = np.frombuffer(press.decompress(content[o:o + s]), header["ids"])
                        if len(ids) != n:
                            raise ValueError(f"{file}: {len(ids)} ids at offset {o}, the index has {n}")
                        out.append(value(ids))
                    d = doc_ids[r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(r)), pa.array(r), pa.array(d, mask=d == NULL_ID), pa.array(start[r]), pa.array(counts[r]), pa.array(out, kind)],
                        names=["file", "pos", "doc_id", "local_start", "n_tokens", field.split()[0]])

    return Z.read_files(spark, f"{path}/shards").mapInArrow(run, f"file string, pos long, doc_id long, local_start long, n_tokens long, {field}")


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """file, base: ids in the shards before it, from the trailers (one row per shard)."""
    tail = F.lit(-(TRAILER_BYTES + len(Z.SEPARATOR)))
    count = F.conv(F.hex(F.substring(F.substring("content", tail, F.lit(TRAILER_BYTES)), 9, 8)), 16, 10).cast("long")
    per = Z.read_files(spark, f"{path}/shards").select("file", count.alias("n"))
    return per.select("file", (F.sum("n").over(Window.orderBy(shard_number(F.col("file")))) - F.col("n")).alias("base"))


def shard_number(file: Column) -> Column:
    """The number in ``part-<number>-...``: names stop sorting by it where it gets a sixth digit."""
    return F.regexp_extract(file, r"part-(\d+)[^/]*$", 1).cast("long")


def op5_tokenfile(docs: DataFrame, path: str | None = None, vocabulary: Vocabulary | None = None, end_id: int = 2) -> DataFrame:
    """The query's digest: writes the files, reads them back, and digests what it read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write(docs, path, vocabulary or default_vocabulary(spark, "byte_bpe_50k.json"), end_id)
    rows = _scan(spark, path, None, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4")), pa.int64())
    return rows.join(shard_starts(spark, path), "file").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
