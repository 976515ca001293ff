"""Suffix-array de-duplication: interval expansion on a Burrows-Wheeler transform.

Passages that may repeat (see passages.py) are dealt to shards of bounded size. Each shard's passages are
joined with separators, and sorted by their first ``length`` bytes. From the
transform of that order, a breadth-first search extends intervals backwards: the
interval of a string w gives the intervals of all cw, and the first interval to end at a row
sets the common prefix of this row and the next to the length of w. Lengths thus
come in increasing order, each interval is entered once, and the search stops at ``length``:
rows that then have no value share at least ``length`` bytes. Those windows repeat.

Sorting to ``length`` bytes suffices: an interval of a string of at most that length
is a block of rows whatever the order within ties.

Defined results: a null text is empty. Texts shorter than ``length`` bytes lose nothing. Rows with a null
doc_id lose nothing and are no match for others. Rows that share a doc_id are taken to be
copies of one document and get one answer; equal texts under several ids are copies of each other and lose all
bytes if they have ``length``. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import passages as P
from .common import U64, anchors, as_utf8, list_column, materialize, mix64, parts_for, runs, slices, unclash
from .common import _BYTE_VALUES, _powers

#: Bytes of a window, bytes of an anchor, occurrences of anchors per shard.
LENGTH, GRAM, PER_SHARD = 200, 64, 5000
#: Occurrences beyond which an anchor is dealt by its surroundings; bytes of distinct cut-outs of a shard.
HOT, SHARD_BYTES = 4000, 3 << 20
#: Places at which the windows of one class around a hot anchor start.
WIDTH = 16
#: Bytes of a text that are hashed at once; longer texts go in overlapping parts.
PART = 1 << 19
#: New shards of a too large one, for each SHARD_BYTES of its cut-outs, in the first and the second try; spans that a task merges at once.
SPREAD, FLUSH = (6, 60), 50_000
EMPTY = hashlib.sha256(b"").hexdigest()


def byte_grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes that start at each position."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE_VALUES[data] * up[:n], out=sums[1:])
    return mix64((sums[k:] - sums[:-k]) * down[:n - k + 1])


def text_anchors(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, spots, cuts) of the anchors of each row, in the row's own positions."""
    gram = min(GRAM, length)
    grams, spots, cuts = [], [], [0]
    # rows are handled together in groups of about PART bytes; a longer row alone, in parts that overlap by a window
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + PART, "right")) - 1)
        lo, hi = int(offs[a]), int(offs[b])
        if hi - lo <= PART or b > a + 1:
            found, at = part_anchors(data[lo:hi], offs[a:b + 1] - lo, gram, length)
        else:
            pieces = [part_anchors(data[s:min(hi, s + PART)], np.array([0, min(hi, s + PART) - s]), gram, length) for s in range(lo, hi, PART - length + 1)]
            at, first = np.unique(np.concatenate([p[1] + i * (PART - length + 1) for i, p in enumerate(pieces)]), return_index=True)
            found = np.concatenate([p[0] for p in pieces])[first]
        grams.append(found)
        inner = np.searchsorted(at, offs[a:b + 1] - lo)
        spots.append(at - np.repeat(offs[a:b] - lo, np.diff(inner)))
        cuts += (inner[1:] + cuts[-1]).tolist()
        a = b
    return np.concatenate([np.zeros(0, U64), *grams]), np.concatenate([np.zeros(0, np.int64), *spots]), np.array(cuts)


def part_anchors(data: np.ndarray, offs: np.ndarray, gram: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    if len(data) < length:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = byte_grams(data, gram)
    # a window starts at i if its row has ``length`` bytes from there
    room = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(data))
    at = anchors(h, (room >= length)[:len(h)], length - gram + 1)
    return h[at] | U64(1), at


def anchor_pass(length: int):
    def run(batches):
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                grams, spots, cuts = text_anchors(data, offs, length)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(offs)), list_column(grams.view(np.int64), cuts), list_column(spots.astype(np.int32), cuts)],
                    names=["doc_id", "digest", "n_bytes", "grams", "spots"])

    return run


def segment_pass(length: int, shards: int):
    """doc_id, text, hits -> rows of P.SEGMENTS: cut-outs or, without a body, settled spans."""

    def run(batches):
        settled, gram = P.Settled(earlier_only=False, shards=shards), min(GRAM, length)
        for batch in batches:
            data, offs = as_utf8(batch.column(1))
            raw, out, size = data.tobytes(), [], 0
            docs = batch.column(0).to_pylist()
            for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                for shard, a, b in P.intervals(P.hits_of(batch, i), gram, length, min(WIDTH, length), hi - lo, shards, lambda c, d: raw[lo + c:lo + d]):
                    out += settled.add(shard, docs[i], a, b - a, raw[lo + a:lo + b])
                    size += b - a
                if size > 8 << 20:
                    yield P.segment_table(out)
                    out, size = [], 0
            if out:
                yield P.segment_table(out)

    return run


def sorted_rows(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): positions sorted by their first ``length`` symbols, and the row of each position.

    The last symbol is unique and the least. The first key packs as many symbols as fit 63 bits; ranks
    of doubling depth follow, for the rows that are not alone yet. A rank is the first row of its block.
    """
    n, bits = len(symbols), max(1, int(symbols.max()).bit_length())
    depth = min(length, 63 // bits)
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key[:n - j] |= symbols[j:]
    order = np.argsort(key)
    key = key[order]
    order = order.astype(np.int32)
    rank = np.empty(n, np.int32)
    rows = np.arange(n, dtype=np.int32)
    at = order
    while True:
        first = np.empty(len(rows), bool)
        first[:1] = True
        np.not_equal(key[1:], key[:-1], out=first[1:])
        rank[at] = rows[np.maximum.accumulate(np.where(first, np.arange(len(rows), dtype=np.int32), 0))]
        alone = first & np.append(first[1:], True)
        rows, at = rows[~alone], at[~alone]
        del first, alone, key
        if depth >= length or not len(rows):
            break
        step = min(depth, length - depth)
        key = rank[at].astype(np.int64) << 32
        inside = at < n - step
        key[inside] |= rank[at[inside] + step] + 1
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[rows] = at
        depth += step
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place


def repeated_windows(symbols: np.ndarray, length: int) -> np.ndarray:
    """Positions whose next ``length`` symbols also start at another position; the last symbol is unique and the least."""
    n = len(symbols)
    order, place = sorted_rows(symbols, length)
    head = symbols[order]
    back = place[order - 1]  # row of the suffix one symbol longer; the last symbol precedes the first
    del place
    open_ = np.ones(n + 1, bool)  # no common prefix known yet, between a row and the one before it
    open_[0] = open_[n] = False
    mark = np.full(n + 2, -1, np.int32)
    lo, hi = np.array([0]), np.array([n - 1])
    for _ in range(length):
        sizes = hi - lo + 1
        total = np.cumsum(sizes)
        if not len(total):
            break
        rows = np.arange(total[-1], dtype=np.int32) + np.repeat((lo - (total - sizes)).astype(np.int32), sizes)
        to = back[rows]
        del rows
        mark[to + 1] = np.repeat(np.arange(len(lo), dtype=np.int32), sizes)
        # rows of one interval and one symbol are neighbours; a block ends where either changes
        sym = head[to]
        own = mark[to + 1]
        last = (mark[to + 2] != own) | (to == n - 1) | (head[np.minimum(to + 1, n - 1)] != sym)
        first = (mark[to] != own) | (to == 0) | (head[np.maximum(to - 1, 0)] != sym)
        begin, end = np.sort(to[first]), np.sort(to[last])
        mark[to + 1] = -1
        new = open_[end + 1]
        # the first interval to end here: the common prefix of this row and the next is this short
        lo, hi = begin[new].astype(np.int64), end[new].astype(np.int64)
        open_[hi + 1] = False
    return order[open_[:n] | open_[1:]].astype(np.int64)


def body_spans(bodies: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, start, end) of the repeated spans within distinct bodies.

    All separators are one symbol, the end another; windows that reach a separator are left out.
    """
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1)
    symbols = np.ones(ends[-1], np.int16)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    symbols[inner] = np.frombuffer(b"".join(bodies), np.uint8).astype(np.int16) + 2
    symbols[-1] = 0
    edge = np.zeros(len(symbols) + length + 1, np.int32)
    at = repeated_windows(symbols, length)
    at = at[at + length < ends[np.searchsorted(ends, at, "right").clip(max=len(ends) - 1)]]
    edge[at] += 1
    edge[at + length] -= 1
    found = np.array(P.runs_of(np.cumsum(edge)[:len(symbols)] > 0), np.int64).reshape(-1, 2)
    body = np.searchsorted(ends, found[:, 0], "right")
    begin = (ends - sizes - 1)[body]
    return body, found[:, 0] - begin, found[:, 1] - begin


class SettledPlaces(P.Settled):
    """Cut-outs of one map task, where two anchors may bring one place twice: that is no repeat."""

    def add(self, shard: int, doc: int, start: int, size: int, body: bytes) -> list[tuple]:
        old = self.seen.get((shard, hashlib.blake2b(body, digest_size=16).digest()))
        return [] if old is not None and old[1:3] == (doc, start) else super().add(shard, doc, start, size, body)


def split_pass(length: int, shards: int):
    """Cut-outs of too large shards -> the surroundings of their anchors, dealt to the ``parts`` shards from ``first_part``.

    Equal windows have equal anchors, so they meet again; neighbouring anchors of one new shard stay one cut-out.
    """

    def run(batches):
        settled, gram = SettledPlaces(earlier_only=False, shards=shards), min(GRAM, length)
        for batch in batches:
            docs, starts, first, parts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "first_part", "parts"))
            for piece, data, offs in slices(batch, "body"):
                grams, spots, cuts = text_anchors(data, offs, length)
                raw, out = data.tobytes(), []
                for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    own = slice(cuts[i], cuts[i + 1])
                    to = first[i] + ((grams[own] >> U64(1)) % U64(parts[i])).astype(np.int64)
                    for shard, a, b in P.intervals((to, spots[own], np.zeros(len(to), bool)), gram, length, 1, hi - lo, shards, None):
                        out += settled.add(shard, docs[i], starts[i] + a, b - a, raw[lo + a:lo + b])
                if out:
                    yield P.segment_table(out)
                docs, starts, first, parts = (c[piece.num_rows:] for c in (docs, starts, first, parts))

    return run


def window_pass(length: int, base: int, shards: int):
    """Cut-outs of too large shards -> their single windows, as digests of 128 bits that also name the shard; equal ones of a task are settled.

    The settled windows of a document that touch are one row.
    """

    def run(batches):
        settled = SettledPlaces(earlier_only=False, shards=shards)
        for batch in batches:
            out, spans = [], {}
            for doc, start, size, body in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "start", "size", "body"))):
                for a in range(size - length + 1):
                    window = hashlib.blake2b(body[a:a + length], digest_size=16).digest()
                    for row in settled.add(base + int.from_bytes(window[:8]) % shards, doc, start + a, length, window):
                        if row[4] is None:
                            spans.setdefault(row[1], []).append((row[2], row[2] + length))
                        else:
                            out.append(row)
                if len(out) > 20_000:
                    yield P.segment_table(out)
                    out = []
            out += [(doc % shards, doc, a, b - a, None) for doc, found in spans.items() for a, b in P.merged(found)]
            if out:
                yield P.segment_table(out)

    return run


def bounded(segments: DataFrame, length: int, shards: int, shard_bytes: int) -> DataFrame:
    """The segments, so that no shard has more than about ``shard_bytes`` of distinct cut-outs.

    A larger shard (near copies, or cut-outs that share a core and differ around it) is dealt anew by the anchors in its
    cut-outs; what is still too large then, by single anchors; and the rest (one hot anchor) window by window,
    where a repeated window is one whose digest occurs twice. Each shard has new ones of its own, as the
    cut-outs of one document are disjoint within a shard only.
    """
    done = []
    for spread in (*SPREAD, 0):
        sizes = (segments.where("body is not null").groupBy("shard", F.xxhash64("body").alias("h")).agg(F.max("size").alias("size"))
                 .groupBy("shard").agg(F.sum("size").alias("bytes")))
        parts = F.ceil(F.col("bytes") * F.lit(spread) / F.lit(shard_bytes)).cast("int")
        # one row for each shard above the bound, so the running sum is over few
        first = F.lit(shards) + F.sum("parts").over(Window.orderBy("shard")) - F.col("parts")
        large = materialize(sizes.where(F.col("bytes") > shard_bytes).withColumn("parts", parts).withColumn("first_part", first.cast("int")), "large")
        total, more = large.agg(F.sum("bytes"), F.sum("parts")).first()
        if total is None:
            break
        again = segments.where("body is not null").join(large.drop("bytes"), "shard")
        # settled cut-outs have no body and stay
        done.append(segments.join(large.select("shard", F.lit(True).alias("body_there")), "shard", "left").where("body_there is null or body is null").drop("body_there"))
        if spread:
            segments, shards = materialize(again.mapInArrow(split_pass(length, shards), P.SEGMENTS), "segments"), shards + more
        else:
            segments = again.mapInArrow(window_pass(length, shards, parts_for(again.sparkSession, total * WIDTH, shard_bytes)), P.SEGMENTS)
    for part in done:
        segments = segments.unionByName(part)
    return segments


def merged_spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """The union of the spans of each document, as rows."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # ends grow within a document if each is at least the one before; ranks keep documents apart
    new = np.ones(len(doc), bool)
    new[1:] = doc[1:] != doc[:-1]
    shift = np.cumsum(new) * (int(end.max(initial=0)) + 1)
    far = np.maximum.accumulate(end + shift)
    new[1:] |= start[1:] + shift[1:] > far[:-1]
    last = np.append(new[1:], True)[:len(doc)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (doc[new], start[new], (far - shift)[last])], names=["doc_id", "start", "end"])


def match_pass(length: int):
    """Segments in shard order -> doc_id, start, end of the repeated spans, merged over the shards of a task.

    Of equal bodies one enters the transform; all of them are repeated whole. A body shorter than its
    cut-out is the digest of a single window and has no others in it.
    """

    def run(batches):
        found = []
        for t in runs(batches, 1):
            place: dict[bytes, int] = {}
            doc, start, size = (t.column(c).to_numpy() for c in ("doc_id", "start", "size"))
            row, whole = [], np.zeros(t.num_rows, bool)
            for chunk, base in zip(t.column("body").chunks, np.cumsum([0] + [len(c) for c in t.column("body").chunks]).tolist()):
                for i, body in enumerate(chunk.to_pylist(), base):
                    if body is None:
                        whole[i] = True
                        continue
                    k = place.setdefault(body, len(row))
                    if k < len(row):
                        if doc[i] == doc[row[k]] and start[i] == start[row[k]]:  # one place by way of two anchors
                            continue
                        whole[i] = whole[row[k]] = True
                    else:
                        row.append(i)
            whole &= size >= length
            found.append((doc[whole], start[whole].astype(np.int64), start[whole].astype(np.int64) + size[whole]))
            texts = [(body, i) for body, i in zip(place, row) if len(body) == size[i] and len(body) >= length]
            if texts:
                body, a, b = body_spans([x[0] for x in texts], length)
                seg = np.array([x[1] for x in texts])[body]
                found.append((doc[seg], a + start[seg], b + start[seg]))
            if sum(len(c[0]) for c in found) > FLUSH:
                yield merged_spans(*map(np.concatenate, zip(*found)))
                found = []
        if found:
            yield merged_spans(*map(np.concatenate, zip(*found)))

    return run


def op4_bwt(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The query's digest of what is kept; spans() has the spans themselves."""
    scanned, copies, spans, docs = repeated_spans(docs, length)

    def run(batches):
        for batch in batches:
            data, offs = as_utf8(batch.column(1))
            raw, out = memoryview(data.tobytes()), []
            for doc, lo, hi, found in zip(batch.column(0).to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), batch.column(2).to_pylist()):
                kept, at, lost, n = hashlib.sha256(), lo, 0, 0
                for a, b in P.merged([(x["start"], x["end"]) for x in found]):
                    kept.update(raw[at:lo + a])
                    at, lost, n = lo + b, lost + b - a, n + 1
                kept.update(raw[at:hi])
                out.append((doc, lost, n, kept.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "lost", "n", "sha"])

    cut = spans.mapInArrow(run, "id long, lost long, n long, sha string")
    several = copies.select(F.col("digest").alias("d"), "first_id")
    # equal texts under several ids: every window of each also starts in the others
    whole = F.col("first_id").isNotNull() & F.col("doc_id").isNotNull() & (F.col("n_bytes") >= length)
    rows = scanned.select("doc_id", "digest", "n_bytes").join(several, F.col("digest") == F.col("d"), "left").join(cut, F.col("doc_id") == F.col("id"), "left")
    zero = F.lit(0)
    return rows.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("lost", zero)).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n", zero)).cast("long").alias("n_spans"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scanned, copies, spans, docs): spans has doc_id, text, spans (array of start, end in bytes) of documents with repeats.

    Equal texts under several ids are in ``copies``; they are repeated whole.
    """
    docs = unclash(docs, ["doc_id", "text"])
    scanned, copies, involved, segments = shard_segments(docs, length)
    spans = P.dealt(segments).mapInArrow(match_pass(length), "doc_id long, start long, end long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return scanned, copies, involved.select("doc_id", "text").join(spans, "doc_id"), docs


def shard_segments(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(scanned, copies, involved, segments): the cut-outs of documents with repeated anchors, in shards of bounded size."""
    scanned = P.scan(docs, anchor_pass(length), "n_bytes long")
    copies = P.first_copies(scanned)
    hits, shards = P.routes(scanned, copies, PER_SHARD, HOT)
    involved = P.cut_out(docs, hits)
    segments = materialize(involved.mapInArrow(segment_pass(length, shards), P.SEGMENTS), "segments")
    return scanned, copies, involved, bounded(segments, length, shards, SHARD_BYTES)


SQL = None
