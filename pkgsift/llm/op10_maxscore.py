"""Exact top-k search by MaxScore over sharded postings.

Vectors become integers, floor(256 * x). The terms of a query are its non-zero components;
the postings of a term are the vectors of a shard whose component contributes above 0,
and its bound is the largest such contribution in the shard. With the terms in order of
their bounds, those at the low end whose bounds add up to no more than the score
still needed are non-essential: a vector found in no essential posting can't reach the
result. Essential postings are traversed (accumulated), then the other terms are probed
only for vectors that stay competitive, the strongest first. Each shard returns its k best
per query and a window merges them. Every step prunes by strict comparison with a
proven bound, so the result is exact, ties included.

The work of a query set against all rows goes in blocks: shards of at most SHARD_ROWS
vectors and query blocks of at most QUERY_ROWS meet once per pair in one task of bounded size.

Defined results: vectors that are null or hold a null, NaN or infinite component take no
part. Vectors of unequal length are compared with 0 for the missing components. A row is a
candidate of every query but itself. Of rows that share a vec_id the one with the largest
vector (component by component) counts, so repeated rows are one. Rows with a null vec_id take no part.
A component beyond +-2**55 or a resulting score beyond a long is an error, as in the SQL. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, unclash

SHARD_ROWS, QUERY_ROWS = 4096, 512


def blocks(rows: DataFrame, size: int, salt: int) -> DataFrame:
    """block, n, ids, flat: at most about ``size`` vectors per row, dealt by a hash of the whole row."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(salt), "vec_id", "v"), F.lit(n)).cast("int"))
    return dealt.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows")).select(
        "block", F.col("rows.vec_id").alias("ids"), F.transform("rows.v", F.size).alias("sizes"), F.flatten("rows.v").alias("flat"))


def integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long): the vectors that take part."""
    x = unclash(embeddings, ["vec_id", "embedding"]).where("vec_id is not null and embedding is not null")
    x = x.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.when(F.abs(c) < float(1 << 55), F.floor(c * 256)).otherwise(F.raise_error(F.lit("256 times a component is beyond a long")).cast("long"))
    x = x.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", whole).alias("v"))
    return x.groupBy("vec_id").agg(F.max("v").alias("v"))


def matrix(sizes: np.ndarray, flat: np.ndarray, dims: int) -> np.ndarray:
    out = np.zeros((len(sizes), dims), np.int64)
    keep = np.arange(dims)[None, :] < sizes[:, None]
    out[keep] = flat
    return out


class Shard:
    """The postings of a shard's vectors: one column per dimension, with its extremes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")  # ties go to the smaller id
        self.ids, self.vectors = ids[order], vectors[order]
        self.columns = np.ascontiguousarray(self.vectors.T)
        self.high, self.low = self.columns.max(axis=1), self.columns.min(axis=1)
        self.peak = np.maximum(np.abs(self.high.astype(float)), np.abs(self.low.astype(float)))

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, the best first."""
        if np.abs(query.astype(float)) @ self.peak >= 2.0**62:
            return self.search_wide(own, query, k)
        bound = np.maximum(0, np.maximum(query * self.high, query * self.low))
        terms = np.argsort(-bound, kind="stable")
        terms = terms[query[terms] != 0]
        rest = np.concatenate([np.cumsum(bound[terms][::-1])[::-1], [0]])  # bounds of the terms from here on
        valid = self.ids != own
        rows = np.flatnonzero(valid)
        need = self.threshold(rows, query, k)
        # essential: the terms up to where the bounds of the others no longer reach the needed score alone
        essential = int(np.searchsorted(-rest, -need, "right")) if need is not None else len(terms)
        if essential < len(terms):
            touched = np.zeros(len(self.ids), bool)
            for t in terms[:essential]:
                touched |= (self.columns[t] * query[t]) > 0
            rows = np.flatnonzero(touched & valid)
        score = np.zeros(len(rows), np.int64)
        for i, t in enumerate(terms):
            score += self.columns[t][rows] * query[t]
            if need is not None and i % 8 == 7 and len(rows) > 4 * k:
                stay = score + rest[i + 1] >= need  # a vector below can't reach the k-th score, not even a tie
                rows, score = rows[stay], score[stay]
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]

    def search_wide(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for products that can pass 64 bits: Python's integers, every candidate."""
        rows = np.flatnonzero(self.ids != own)
        score = self.vectors[rows].astype(object) @ query.astype(object)
        best = sorted(range(len(rows)), key=lambda i: (-score[i], self.ids[rows[i]]))[:k]
        if any(not -(1 << 63) <= score[i] < 1 << 63 for i in best):
            raise OverflowError(f"a score of vec_id {own} is beyond a long")
        return self.ids[rows[best]], np.array([score[i] for i in best], np.int64)

    def threshold(self, rows: np.ndarray, query: np.ndarray, k: int):
        """A score that k candidates reach: the k-th exact score among those best on the strongest terms."""
        if len(rows) <= 4 * k:
            return None
        strong = np.argsort(-np.abs(query), kind="stable")[:8]
        part = query[strong] @ self.columns[strong][:, rows]
        seeds = rows[np.argpartition(-part, 4 * k)[:4 * k]]
        return int(np.sort(self.vectors[seeds] @ query)[-k])


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: both inputs are vec_id, v (array of long)."""
    q = blocks(queries, QUERY_ROWS, 1).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("sizes").alias("q_sizes"), F.col("flat").alias("q_flat"))
    n_q = q.select("q_block")
    # each shard goes to each query block once: packed rows of bounded size, joined by the block's number
    shards = blocks(candidates, SHARD_ROWS, 2)
    count = n_q.agg(F.coalesce(F.max("q_block"), F.lit(-1))).first()[0] + 1
    if not count:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pairs = shards.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(q, "q_block")
    pairs = pairs.repartition(F.col("q_block"), F.col("block"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                ids, sizes, flat, q_ids, q_sizes, q_flat = (batch.column(i)[r].values.to_numpy(zero_copy_only=False) for i in range(6))
                dims = int(max(sizes.max(initial=0), q_sizes.max(initial=0)))
                if dims == 0 or not len(ids):
                    shard = Shard(ids, np.zeros((len(ids), 1), np.int64))
                    asked = np.zeros((len(q_ids), 1), np.int64)
                else:
                    shard, asked = Shard(ids, matrix(sizes, flat, dims)), matrix(q_sizes, q_flat, dims)
                out = [(np.full(len(f[0]), i), *f) for i, v in zip(q_ids.tolist(), asked) for f in [shard.search(i, v, k)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    found = pairs.select("ids", "sizes", "flat", "q_ids", "q_sizes", "q_flat").mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op10_maxscore(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The query: rows whose vec_id is divisible by ``every``, against all rows."""
    rows = materialize(integers(embeddings), "vectors")
    return search(rows.where(F.col("vec_id") % every == 0), rows, k)


SQL = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
