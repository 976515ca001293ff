"""Substring de-duplication: suffix automata of reference shards, matching statistics.

Passages that may repeat (see passages.py) are dealt to shards; a shard's references are
its passages so far, in the order of (doc_id, start). Its task holds their suffix automaton over words
and streams the passages through it: the matching statistic at a word is the length of the longest
string ending there that the references, or an earlier part of the passage, hold too. Where it
reaches the threshold the last ``length`` words are a repeated window; the union of
those is removed. A passage then joins the references. The words themselves label the
automaton; only whole equal passages of one map task are known by a digest (of 128 bits).

Automata are dealt with the passages that can match them rather than sent to all tasks:
all shards together grow with the corpus, and every document against every shard would
be a product of the two.

Defined results: a null text has no words. Texts with fewer than ``length`` words are kept whole.
Rows with a null doc_id are kept whole and are no reference. Rows that share a doc_id are
taken to be copies of one document and get one answer; of equal texts under several ids the first keeps
its words. Extra columns are dropped by the query and kept by the pipeline stage; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import passages as P
from .common import anchors, free_names, gram_hashes, list_column, slices, span_hashes, unclash, window_mask, word_spans

#: Words of a window, words of an anchor, occurrences of anchors per shard.
LENGTH, GRAM, PER_SHARD = 20, 8, 6000
EMPTY = hashlib.sha256(b"").hexdigest()


class Automaton:
    """Suffix automaton of several word sequences, extended word by word."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]

    def state(self, size: int, link: int, edges: dict[bytes, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def split(self, p: int, q: int, word: bytes) -> int:
        """The state of the strings that reach q through p: a clone, if q also has longer ones from elsewhere."""
        size, link, nxt = self.size, self.link, self.next
        if size[q] == size[p] + 1:
            return q
        clone = self.state(size[p] + 1, link[q], dict(nxt[q]))
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def extend(self, last: int, word: bytes) -> int:
        """Append a word to the sequence that ends in state ``last``; returns its new end."""
        nxt, link = self.next, self.link
        q = nxt[last].get(word)
        if q is not None:
            return self.split(last, q, word)
        new = self.state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p >= 0:
            link[new] = self.split(p, nxt[p][word], word)
        return new

    def matches(self, words: list[bytes], length: int) -> list[int]:
        """Ends (exclusive) of the windows of ``length`` words that occur before; adds the sequence."""
        nxt, link, size = self.next, self.link, self.size
        ends, last, v, n = [], 0, 0, 0
        for i, word in enumerate(words, 1):
            while v and word not in nxt[v]:
                v = link[v]
                n = size[v]
            if word in nxt[v]:
                v = nxt[v][word]
                n += 1
            if n >= length:
                ends.append(i)
            last = self.extend(last, word)
            while v and size[link[v]] >= n:  # a split may have moved the matched string to a shorter state
                v = link[v]
        return ends


def anchor_pass(length: int):
    """The first pass: word count, hash of the whole kept text, and anchors of each document."""

    def run(batches):
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                starts, ends, first = word_spans(data, offs)
                words = span_hashes(data, starts, ends)
                gram = min(GRAM, length)
                grams = gram_hashes(words, gram)
                at = anchors(grams, window_mask(first, length, len(words))[:len(grams)], length - gram + 1)
                cut = np.searchsorted(at, first)
                spots = at - np.repeat(first[:-1], np.diff(cut))
                raw = data.tobytes()
                full = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(np.diff(first)), pa.array(full), list_column(grams[at].view(np.int64), cut), list_column(spots.astype(np.int32), cut)],
                    names=["doc_id", "digest", "n_words", "full_sha256", "grams", "spots"])

    return run


def segment_pass(length: int, shards: int):
    """doc_id, text, hits -> rows of P.SEGMENTS: cut-outs (words joined by a space) or, without a body, settled spans."""

    def run(batches):
        settled, gram = P.Settled(earlier_only=True, shards=shards), min(GRAM, length)
        for batch in batches:
            out = []
            for i, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                words = text.encode().split()
                for shard, a, b in P.intervals(P.hits_of(batch, i), gram, length, 1, len(words), shards, lambda c, d: b" ".join(words[c:d])):
                    out += settled.add(shard, doc, a, b - a, b" ".join(words[a:b]))
            if out:
                yield P.segment_table(out)

    return run


def match_pass(length: int):
    """Segments in shard order -> doc_id, start, end of the removed spans."""

    def run(batches):
        shard, automaton = None, None
        for batch in batches:
            out = []
            for s, doc, start, size, body in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if body is None:
                    out.append((doc, start, start + size))
                    continue
                if s != shard:
                    shard, automaton = s, Automaton()
                ends = automaton.matches(body.split(), length)
                out += [(doc, start + a, start + b) for a, b in P.merged([(e - length, e) for e in ends])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "start", "end"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, copies, spans): spans has doc_id, text and spans (array of start, end in words) of the documents that lose words."""
    docs = unclash(docs, ["doc_id", "text"])
    scanned = P.scan(docs, anchor_pass(length), "n_words long, full_sha256 string")
    copies = P.first_copies(scanned)
    hits, shards = P.routes(scanned, copies, PER_SHARD)
    involved = P.cut_out(docs, hits)
    segments = involved.mapInArrow(segment_pass(length, shards), P.SEGMENTS)
    spans = P.dealt(segments).mapInArrow(match_pass(length), "doc_id long, start long, end long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return scanned, copies, involved.select("doc_id", "text").join(spans, "doc_id")


def with_spans(rows: DataFrame, copies: DataFrame, length: int) -> tuple:
    """Column: a row that is a later copy of an equal text, long enough to be removed whole."""
    several = copies.select(F.col("digest").alias("d"), "first_id")
    return rows.join(several, F.col("digest") == F.col("d"), "left").withColumn(
        "gone", F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= length), F.lit(False))).drop("d", "first_id")


def op9_automaton(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The query's digest of what is kept."""
    scanned, copies, spans = repeated_spans(docs, length)

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.encode().split()
                runs = P.merged([(x["start"], x["end"]) for x in found])
                for a, b in reversed(runs):
                    del words[a:b]
                out.append((doc, sum(b - a for a, b in runs), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["id", "lost", "sha"])

    cut = spans.mapInArrow(run, "id long, lost long, sha string")
    rows = with_spans(scanned.select("doc_id", "digest", "n_words", "full_sha256"), copies, length)
    gone = F.col("gone")
    return rows.join(cut, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("lost", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("sha", "full_sha256")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents without their repeated windows, all columns; ``text`` keeps the white space between kept words.

    A document that loses all its words is dropped, others stay as they are if they lose none.
    """
    scanned, copies, spans = repeated_spans(docs, length)
    gone_id, cut_id, cut_text = free_names(docs, "gone_id", "cut_id", "cut_text")

    def run(batches):
        for batch in batches:
            out = []
            for doc, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                raw = text.encode()
                data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
                starts, ends, _ = word_spans(data, offs)
                keep, at = [], 0
                for a, b in P.merged([(x["start"], x["end"]) for x in found]):
                    keep.append(raw[at:starts[a]])
                    at = starts[b] if b < len(starts) else len(raw)
                keep.append(raw[at:])
                out.append((doc, b"".join(keep).decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[cut_id, cut_text])

    cut = spans.mapInArrow(run, f"{cut_id} long, {cut_text} string")
    gone = with_spans(scanned.select("doc_id", "digest", "n_words"), copies, length).where("gone").select(F.col("doc_id").alias(gone_id)).distinct()
    left = docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti").join(cut, F.col("doc_id") == F.col(cut_id), "left")
    kept = left.where(F.col(cut_id).isNull() | F.rlike(F.col(cut_text), F.lit("[^ \\t-\\r]")))
    return kept.select(*[F.coalesce(cut_text, "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(0, len(w) - 19)) AS i, w FROM d WHERE len(w) >= 20),
h AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS win FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS hit FROM h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM r WHERE hit),
l AS (SELECT doc_id, list(j) AS gone FROM c GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END AS kept
  FROM d LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
