"""License scans by diagonal voting, in SQL expressions and Spark joins only.

Templates are word sequences with a label. Every document's rolling word 2-gram hashes are joined
to the template positions; a hit votes for the diagonal (document position less
template position). Votes are summed up per diagonal as a bitmask of template words, neighbouring
diagonals (words put in or left out) are merged to one span, and a span is verified: the
words that it holds must reach the template's share and include its key words. The
join compares the words themselves besides the hash, so a vote is exact. Phrases that
must stand word for word have a template that merges nothing and needs all its words.

A hit of a longer template needs a third equal word beside it, at most one word being put in or left
out between, which drops most chance hits (``under the``) before anything is shuffled. Only votes are shuffled, never texts.
The templates are a parameter: their word count is checked before they are broadcast.

Defined results: a null or empty text has no words and no places. Rows are told apart by
(doc_id, md5 of the text): repeated rows get equal results and don't add up. A null doc_id is
an id like any other. Places that overlap all count. Extra columns are dropped; an empty
table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import unclash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word of the lower-cased text; what stands between the words of the text as it is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Diagonals this far apart are merged; percent of a template's words that a span must hold.
GAP, SHARE = 3, 75
#: Words of a template part (a part is one bitmask), words of all templates that may be broadcast.
PART_WORDS, BROADCAST_WORDS = 60, 100_000


@dataclass(frozen=True)
class Template:
    """Lower-case words with a label; ``*`` marks key words. ``exact``: the words must stand consecutively."""

    label: str
    text: str
    exact: bool = False

    def parts(self) -> list[tuple[list[str], int]]:
        """(words, mask of key words) of each part of at most PART_WORDS words."""
        words = self.text.split()
        if len(words) < 2 or self.exact and len(words) > PART_WORDS:
            raise ValueError(f"a template has 2 words or more, an exact one at most {PART_WORDS}: {self.text!r}")
        n = -(-len(words) // PART_WORDS)
        out = []
        for i in range(n):
            part = words[len(words) * i // n:len(words) * (i + 1) // n]
            out.append(([w.lstrip("*") for w in part], sum(1 << j for j, w in enumerate(part) if w.startswith("*"))))
        return out


BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))
#: Labels of the method's own; a span may miss a quarter of the words, but no key word.
OWN = (
    Template("apache-2.0", "licensed under the *apache license version *2 0"),
    Template("cc-by-nc", "licensed under *cc by *nc 4 0"),
    Template("cc-by-sa", "licensed under *cc by *sa 4 0"),
    Template("cc0", "to the extent possible under law the author has *waived all copyright and related rights to this work"),
    Template("mit", "released under the *mit license"),
    Template("mit", "licensed under the *mit license"),
    Template("mit", "permission is hereby granted *free *of *charge to any person obtaining a copy of this software and associated documentation files"),
    Template("gpl-3.0", "licensed under the gnu *general public license version *3"),
    Template("gpl-2.0", "licensed under the gnu *general public license version *2"),
    Template("lgpl", "under the terms of the gnu *lesser *general public license"),
    Template("bsd", "*redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl-2.0", "this source code form is subject to the terms of the *mozilla public license v 2 0"),
    Template("isc", "permission to use copy modify and or *distribute this software for any purpose with or without *fee is hereby granted"),
    Template("unlicense", "this is free and *unencumbered software released into the public *domain"),
    Template("as-is", "the software is provided *as *is without warranty of any kind express or implied"),
)
TEMPLATES = BASE + OWN


def template_rows(templates: tuple[Template, ...]) -> list[tuple]:
    """(template, label, base, gap, share, n, key, words) of each part."""
    out = []
    for t in templates:
        for words, key in t.parts():
            out.append((len(out), t.label, t.exact, 0 if t.exact else GAP, 100 if t.exact else SHARE, len(words), key, words))
    return out


def template_grams(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """One row per position of a template: its 2-gram, the gram's hash and the words beside it."""
    lit = lambda r: F.struct(F.lit(r[0]).alias("template"), F.split(F.lit(" ".join(r[7])), " ").alias("t"))
    t = spark.range(1).select(F.explode(F.array(*[lit(r) for r in rows])).alias("x")).select("x.template", "x.t")
    at = t.select("template", "t", F.explode(F.sequence(F.lit(0), F.size("t") - 2)).alias("tpos"))
    w = lambda k: F.get("t", F.col("tpos") + k)
    grams = at.select("template", "tpos", (F.size("t") == 2).alias("pair"), w(0).alias("t0"), w(1).alias("t1"),
                      w(-2).alias("before2"), w(-1).alias("before1"), w(2).alias("after1"), w(3).alias("after2"))
    return grams.withColumn("h", F.xxhash64("t0", "t1"))


def attributes(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """template, label, base, gap, share, n, key: one row per template part."""
    names = ("template", "label", "base", "gap", "share", "n", "key")
    one = lambda r: F.struct(*[(F.lit(v).cast("long") if k == "key" else F.lit(v)).alias(k) for k, v in zip(names, r)])
    return spark.range(1).select(F.explode(F.array(*[one(r) for r in rows])).alias("x")).select("x.*")


def words_of(text: Column) -> Column:
    """The words in their order; a split costs a sixth of a regexp_extract_all."""
    return F.array_remove(F.split(text, BETWEEN), "")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, text: the key of a row and its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return unclash(docs, ["doc_id", "text"]).select("doc_id", F.md5(text.cast("binary")).alias("digest"), text.alias("text"))


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The verified spans: doc_id, digest, template, label, base, start, end (words, exclusive), coverage (0 to 1)."""
    spark, rows = docs.sparkSession, template_rows(templates)
    small = sum(r[5] for r in rows) <= BROADCAST_WORDS
    bounded = F.broadcast if small else (lambda df: df)
    words = keyed(docs).select("doc_id", "digest", words_of(F.translate("text", UPPER, LOWER)).alias("w"))
    # outer: a plain explode would have the words computed a second time, to filter out empty arrays
    at = words.select("doc_id", "digest", "w", F.posexplode_outer("w").alias("pos", "w0")).withColumn("w1", F.get("w", F.col("pos") + 1))
    grams = at.where("w1 is not null").withColumn("gh", F.xxhash64("w0", "w1"))
    w = lambda k: F.get("w", F.col("pos") + k)
    beside = (F.col("pair") | (w(2) == F.col("after1")) | (w(3) == F.col("after1")) | (w(2) == F.col("after2"))
              | (w(-1) == F.col("before1")) | (w(-2) == F.col("before1")) | (w(-1) == F.col("before2")))
    hits = grams.join(bounded(template_grams(spark, rows)), (F.col("gh") == F.col("h")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")))
    votes = hits.where(beside).select("doc_id", "digest", "template", (F.col("pos") - F.col("tpos")).alias("diagonal"),
                                      F.expr("shiftleft(3L, tpos)").alias("bits"))
    diagonals = votes.groupBy("doc_id", "digest", "template", "diagonal").agg(F.bit_or("bits").alias("mask"))
    diagonals = diagonals.join(bounded(attributes(spark, rows)), "template")
    order = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("gap"), F.lit(True))
    merged = (diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(order))
              .groupBy("doc_id", "digest", "template", "label", "base", "share", "n", "key", "span")
              .agg(F.bit_or("mask").alias("mask"), F.max(F.struct(F.bit_count("mask").alias("held"), F.col("mask").alias("mask"))).alias("best"),
                   F.min(F.expr("diagonal + bit_count((mask & -mask) - 1)")).alias("start"), F.max(F.expr("diagonal + length(bin(mask))")).alias("end")))
    # a merged span that is far longer than its template is chance; its best single diagonal still counts
    short = F.col("end") - F.col("start") <= 2 * F.col("n")
    ok = lambda m: (100 * F.bit_count(m) >= F.col("share") * F.col("n")) & (m.bitwiseAND(F.col("key")) == F.col("key"))
    held = F.greatest(F.when(short & ok(F.col("mask")), F.bit_count("mask")), F.when(ok(F.col("best.mask")), F.col("best.held")))
    return merged.withColumn("held", held).where("held is not null").select(
        "doc_id", "digest", "template", "label", "base", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
        (F.col("held") / F.col("n")).alias("coverage"))


def op11_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """The query's digest: base places, labels and the best coverage of each document."""
    base = F.col("base")
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    found = spans(docs, templates).groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("d")).agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        names(F.when(base, F.col("label"))).alias("base_labels"), names(F.col("label")).alias("labels"), F.max("coverage").alias("score"))
    rows = keyed(docs).select("doc_id", "digest", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql(templates: tuple[Template, ...]) -> str:
    values = ",\n".join(f"({t}, '{label}', {str(base).lower()}, {gap}, {share}, {n}, {key}::BIGINT, string_split('{' '.join(words)}', ' '))"
                        for t, label, base, gap, share, n, key, words in template_rows(templates))
    return rf"""
WITH t(template, label, base, gap, share, n, key, t) AS (VALUES
{values}),
g AS (SELECT template, tpos, n, t, t[tpos + 3] AS a1, t[tpos + 4] AS a2, CASE WHEN tpos > 0 THEN t[tpos] END AS c1, CASE WHEN tpos > 1 THEN t[tpos - 1] END AS c2
      FROM (SELECT template, unnest(range(n - 1)) AS tpos, n, t FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
p AS (SELECT rid, w, unnest(range(len(w) - 1)) AS pos FROM d WHERE len(w) > 1),
q AS (SELECT rid, pos, w[pos + 1] AS w0, w[pos + 2] AS w1, w[pos + 3] AS w2, w[pos + 4] AS w3,
      CASE WHEN pos > 0 THEN w[pos] END AS b1, CASE WHEN pos > 1 THEN w[pos - 1] END AS b2 FROM p),
v AS (SELECT rid, template, pos - tpos AS diagonal, bit_or(3::BIGINT << tpos) AS mask
      FROM q JOIN g ON w0 = t[tpos + 1] AND w1 = t[tpos + 2]
      WHERE n = 2 OR w2 = a1 OR w3 = a1 OR w2 = a2 OR b1 = c1 OR b2 = c1 OR b1 = c2 GROUP BY ALL),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o > gap THEN 1 WHEN lag(diagonal) OVER o IS NULL THEN 1 ELSE 0 END AS apart
      FROM v JOIN t USING (template) WINDOW o AS (PARTITION BY rid, template ORDER BY diagonal)),
s AS (SELECT *, sum(apart) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM a),
m AS (SELECT rid, template, label, base, share, n, key, span, bit_or(mask) AS mask, max({{'held': bit_count(mask)::INTEGER, 'mask': mask}}) AS best,
        min(diagonal + bit_count((mask & -mask) - 1)) AS a, max(diagonal + length(ltrim(bin(mask), '0'))) AS b FROM s GROUP BY ALL),
f AS (SELECT *, CASE WHEN b - a <= 2 * n AND 100 * bit_count(mask)::INTEGER >= share * n AND mask & key = key THEN bit_count(mask)::INTEGER END AS h1,
        CASE WHEN 100 * best.held >= share * n AND best.mask & key = key THEN best.held END AS h2 FROM m),
r AS (SELECT rid, count(*) FILTER (base) AS n_base, min(a) FILTER (base) AS first_word, max(a) FILTER (base) AS last_word,
        array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels,
        max(greatest(coalesce(h1, h2), coalesce(h2, h1)) / n) AS score FROM f WHERE h1 IS NOT NULL OR h2 IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM d LEFT JOIN r USING (rid)
"""


SQL = _sql(TEMPLATES)
