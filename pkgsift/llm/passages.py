"""Passages that may hold a repeated window, gathered by shared anchors.

A window (so many words or bytes in a row) is represented by its anchor: the gram with the
least hash in it. Equal windows have equal anchors at equal offsets, so a window can only repeat
if its anchor does. Most anchors are unique, and with them most of every text is settled
in the first pass. The text around repeated anchors is cut out and dealt to shards in
such a way that all occurrences of an anchor meet in one shard, where an exact method finds
the repeated windows.

All anchors of one passage mostly first occur in one document (their owner), and shards are
dealt by owner, so a copied passage goes to its shard whole and once. Anchors of an owner with more
occurrences than a shard should hold are dealt to several shards; a
passage is then cut into the surroundings of its anchors, each of bounded size.

Hot groups are split and pre-aggregated. An anchor with more than HOT occurrences is dealt by its
surroundings: the windows around it fall into classes by where the anchor lies in them, and a
class goes to the shard that the hash of its core (the text that all its windows share) names. Equal windows
have equal cores. Equal cut-outs that meet in one map task are settled there, so a passage of any
number of copies reaches its shard once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, parts_for

#: Occurrences beyond which an anchor is split by its surroundings; cut-outs that a map task remembers.
HOT, SEEN = 20_000, 200_000
SEGMENTS = "shard int, doc_id long, start int, size int, body binary"
_SEGMENT_KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def scan(docs: DataFrame, run: Callable, fields: str) -> DataFrame:
    """One pass over all texts: doc_id, digest, the fields, grams and spots (arrays of the anchors)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("digest"), "text")
    return materialize(rows.mapInArrow(run, f"doc_id long, digest string, {fields}, grams array<long>, spots array<int>"), "anchors")


def first_copies(scanned: DataFrame) -> DataFrame:
    """digest, first_id of the texts that several ids have; a partial aggregation per digest."""
    return (scanned.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
            .where("first_id != last_id").select("digest", "first_id"))


def routes(scanned: DataFrame, copies: DataFrame, per_shard: int, hot: int | None = None) -> tuple[DataFrame, int]:
    """(hits, shards): doc_id, hits array<struct<shard, spot, hot>> of the repeated anchors of every document that has some.

    ``hot``: occurrences beyond which an anchor is dealt by its surroundings (HOT, if not given).

    Only the first of equal texts counts: the others are settled as copies.
    """
    several = copies.select(F.col("digest").alias("d"), "first_id")
    singles = (scanned.where("doc_id is not null and size(grams) > 0")
               .join(several, F.col("digest") == F.col("d"), "left").where("first_id is null or first_id = doc_id")
               .select("doc_id", "grams", "spots").dropDuplicates(["doc_id"]))
    spots = materialize(singles.select("doc_id", F.explode(F.arrays_zip("grams", "spots")).alias("x")).select("doc_id", F.col("x.grams").alias("gram"), F.col("x.spots").alias("spot")), "spots")
    shared = spots.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")).where("n > 1")
    shared = materialize(shared, "grams")
    per_owner = shared.groupBy("owner").agg(F.sum("n").alias("total"))
    shards = parts_for(scanned.sparkSession, shared.agg(F.sum("n")).first()[0] or 0, per_shard)
    # an owner with too many occurrences has as many sub-keys as it would fill shards
    keyed = shared.join(per_owner, "owner").select("gram", (F.col("n") > (HOT if hot is None else hot)).alias("hot"), F.pmod(F.xxhash64(
        "owner", F.pmod(F.col("gram"), F.ceil(F.col("total") / per_shard).cast("long"))), F.lit(shards)).cast("int").alias("shard"))
    return spots.join(keyed, "gram").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "spot", "hot")).alias("hits")), shards


def classes(spot: int, gram: int, length: int, width: int, size: int):
    """(start, end, core start, core end) of the classes of windows that hold the anchor at ``spot``.

    A class has the windows that start at ``width`` neighbouring places; its core lies in each of them.
    """
    last = min(spot, size - length)
    for a in range(spot + gram - length, last + 1, width):
        lo, hi = max(a, 0), min(a + width - 1, last)
        if lo <= hi:
            yield lo, hi + length, a + width - 1, a + length


def intervals(hits: tuple, gram: int, length: int, width: int, size: int, shards: int, core: Callable) -> list[tuple[int, int, int]]:
    """(shard, start, end): for each shard the union of the surroundings of its anchors.

    ``core(a, b)`` gives the text between two places; hot anchors are dealt by it.
    """
    found = []
    for shard, spot, hot in zip(*(x.tolist() for x in hits)):
        if hot:
            for a, b, c, d in classes(spot, gram, length, width, size):
                found.append((int.from_bytes(hashlib.blake2b(core(c, d), digest_size=8).digest()) % shards, a, b))
        else:
            found.append((shard, max(0, spot - length + gram), min(size, spot + length)))
    out: list[tuple[int, int, int]] = []
    for shard, a, b in sorted(found):
        if out and out[-1][0] == shard and a <= out[-1][2]:
            out[-1] = (shard, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((shard, a, b))
    return out


class Settled:
    """Cut-outs of one map task: an equal one seen before settles a whole cut-out, without a shard.

    ``earlier_only``: only an equal cut-out at an earlier (doc_id, start) settles one, and that one stays;
    otherwise both are settled, and their rows go to any shard. One of the equal ones always goes to the shard, so the others are no loss there.
    What is remembered is bounded; forgetting costs only the pre-aggregation.
    """

    def __init__(self, earlier_only: bool, shards: int):
        self.earlier_only, self.shards = earlier_only, shards
        self.seen: dict[tuple[int, bytes], tuple | None] = {}

    def add(self, shard: int, doc: int, start: int, size: int, body: bytes) -> list[tuple]:
        """The rows of SEGMENTS that the cut-out gives; settled ones have no body."""
        key, here = (shard, hashlib.blake2b(body, digest_size=16).digest()), (doc % self.shards, doc, start, size, None)
        if len(self.seen) > SEEN:
            self.seen.clear()
        if key not in self.seen:
            self.seen[key] = here
            return [(shard, doc, start, size, body)]
        old = self.seen[key]
        if self.earlier_only:
            if old[1:3] < (doc, start):
                return [here]
            self.seen[key] = here
            return [(shard, doc, start, size, body)]
        self.seen[key] = None
        return [here] if old is None else [old, here]


def segment_table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _SEGMENT_KINDS)], names=["shard", "doc_id", "start", "size", "body"])


def cut_out(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id, text, hits of the documents with repeated anchors; their texts are stored once for the later steps."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(hits, "doc_id")
    return materialize(rows.dropDuplicates(["doc_id"]), "involved")


def dealt(segments: DataFrame) -> DataFrame:
    """Segments in the order of their shards' tasks."""
    return segments.repartition("shard").sortWithinPartitions("shard", "doc_id", "start")


def hits_of(batch: pa.RecordBatch, i: int, column: str = "hits") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shards, spots, hot) of row i."""
    x = batch.column(batch.schema.get_field_index(column))[i].values
    return x.field("shard").to_numpy(), x.field("spot").to_numpy(), x.field("hot").to_numpy(zero_copy_only=False)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of spans as maximal runs (touching spans are one)."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
