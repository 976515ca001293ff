"""Mixing sources to target weights by Poisson replication.

A source with share t of the target and share a of the corpus (in UTF-8 bytes) gets the
mean repetition rate ``size * t / a`` (size: the wanted corpus size as a multiple of the
present one). Each document draws its copy count by inverting that Poisson distribution
at a uniform number hashed from (seed, doc_id), so a rerun or a lost executor repeats the
same draw. A rate above 700 is split into ceil(rate / 500) equal parts, which draw by (seed,
doc_id, part) and are added up: a sum of independent Poisson numbers is one. Copies are then dealt by a hash of (seed, doc_id, replica): a global shuffle.

Defined results: a null source is a source of its own; rows with a null or repeated
doc_id draw by their id alone (equal ids draw equal counts). Null texts count 0 bytes. A source whose texts are all
empty, or whose weight is 0, has rate 0. Sources without a given weight get none; without
any weights a source's share is its size to the power ``temperature`` (0: equal shares, 1: as they are). An empty table gives an empty result.
The SQL has no such parts: it is the reference for rates up to 700 only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, materialize, uniform53

#: Measured bytes of the table of rates up to which it is broadcast.
BROADCAST_BYTES = 32 << 20
#: exp(-rate) underflows above 700: such a rate is drawn as the sum of equal parts of at most PART copies in the mean.
ONE_DRAW, PART = 700, 500


def source_rates(docs: DataFrame, weights: dict | None = None, size: float = 1.0, temperature: float = 0.0) -> DataFrame:
    """(mix_source, rate, cdf): mean copies per document and the inverse's table, one row per source.

    The only statistic is the byte count per source: a partial aggregation, so that a hot
    source reaches the shuffle as one row per task.
    """
    per = docs.groupBy(F.col("source").alias("mix_source")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("n_bytes"))
    per = per.where(F.col("n_bytes") > 0)
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("n_bytes").cast("double"), F.lit(float(temperature))))
    else:
        table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items() if v > 0] or [("", 0.0)], "given string, weight double")
        per = per.join(table, F.col("mix_source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, ["weight"])
    totals = per.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = (F.lit(float(size)) * F.col("weight") / F.col("all_weight")) * F.col("all_bytes") / F.col("n_bytes")
    # the totals are one row: attached as a one-row lookup on a constant key
    per = per.withColumn("one", F.lit(1)).join(totals.withColumn("one", F.lit(1)), "one")
    per = per.where("weight > 0").select("mix_source", rate.alias("rate"))
    per = per.withColumn("parts", F.when(F.col("rate") > ONE_DRAW, F.ceil(F.col("rate") / PART)).otherwise(F.lit(1)).cast("int"))
    return per.withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... to beyond the last number that a 52-bit uniform can reach, for rates up to ONE_DRAW."""
    last = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    step = lambda s, k: F.struct((s["p"] * rate / k).alias("p"),
                                 F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["c"])


def copies(seed: int, parts: Column, cdf: Column) -> Column:
    """Inverse of the distribution at the document's uniform number; the sum over the parts' own numbers, where there are several."""
    name = [F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))]
    one = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    several = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0), lambda n, i: n + one(uniform53(*name, i.cast("string"))))
    return F.when(parts == 1, one(uniform53(*name))).otherwise(several)


def mix(docs: DataFrame, weights: dict | None = None, size: float = 1.0, seed: int = 20,
        shuffle: bool = True, temperature: float = 0.0) -> DataFrame:
    """Documents repeated to the target weights: all input columns and ``replica`` (from 0), globally shuffled.

    Where the input has a column ``replica``, the number is called ``replica_``.
    """
    replica, *helpers = free_names(docs, "replica", "mix_source", "parts", "cdf", "mix_copies", "mix_key")
    source, parts, cdf, drawn_n, key = helpers
    rates = materialize(source_rates(docs, weights, size, temperature).select("mix_source", "parts", "cdf"), "rates")
    held, most = rates.agg(F.sum(F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 8 * F.size("cdf") + 4), F.max("parts")).first()
    # one row per source, of measured size: with a small table the texts needn't move for their rate;
    # beyond that a sort-merge join, whose hot source Spark splits (AQE)
    rates = rates.toDF(source, parts, cdf)
    rates = F.broadcast(rates) if (held or 0) <= BROADCAST_BYTES else rates.hint("merge")
    drawn = (docs.join(rates, F.col("source").eqNullSafe(F.col(source)))
             .withColumn(drawn_n, copies(seed, F.col(parts), F.col(cdf))).where(F.col(drawn_n) > 0))
    kept = [f"`{c}`" for c in docs.columns]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = drawn.where(F.col(parts) == 1).select(*kept, F.explode(F.sequence(F.lit(0), F.col(drawn_n) - 1)).alias(replica))
    if (most or 1) > 1:
        # a document of a tiny source can be a share of the corpus: its copies are made in many tasks
        many = drawn.where(F.col(parts) > 1).select(*kept, drawn_n, F.explode(F.sequence(F.lit(0), F.col(drawn_n) - 1, F.lit(PART))).alias(key))
        last = F.least(F.col(key) + (PART - 1), F.col(drawn_n) - 1)
        out = out.unionByName(many.repartition(n, "doc_id", key).select(*kept, F.explode(F.sequence(F.col(key), last)).alias(replica)))
    if not shuffle:
        return out
    return out.withColumn(key, F.xxhash64(F.lit(seed), "doc_id", replica)).repartition(n, key).sortWithinPartitions(key).drop(key)


def op8_poisson(docs: DataFrame, weights: dict | None = None, size: float = 1.0) -> DataFrame:
    """Every replica with its whole text; equal shares for all sources, the corpus keeps its size."""
    return mix(docs.select("doc_id", "source", "lang", "text", "n_chars"), weights, size)


SQL = r"""
WITH RECURSIVE s AS (
  SELECT source, sum(coalesce(strlen(text), 0))::BIGINT AS n_bytes FROM documents GROUP BY source
  HAVING sum(coalesce(strlen(text), 0)) > 0),
t AS (SELECT sum(n_bytes)::BIGINT AS all_bytes, count(*)::DOUBLE AS all_weight FROM s),
r AS (SELECT source, (1.0::DOUBLE * 1.0::DOUBLE / all_weight) * all_bytes / n_bytes AS rate FROM s, t),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM c
  WHERE k + 1 <= floor(rate + 12 * sqrt(rate) + 40)),
u AS (SELECT row_number() OVER () AS rid, *, ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT
  / 4503599627370496.0::DOUBLE AS u FROM documents),
n AS (SELECT u.rid, count(*) AS copies FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source WHERE c.c <= u.u GROUP BY u.rid)
SELECT doc_id, source, lang, text, n_chars, unnest(range(0, copies))::INT AS replica
FROM u JOIN n USING (rid)
"""
