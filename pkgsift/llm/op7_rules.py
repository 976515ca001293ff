"""Quality rules as a bitmask ledger, in SQL expressions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one
``failures`` bitmask; a policy is a named, versioned mask over those bits. Policies and
ablations read the ledger alone, never the text again.

Defined results: a null or blank text has no words; it fails ``few_words``. Rows are
independent, so repeated rows, ties and extra columns change nothing (input columns
other than doc_id and text are dropped). An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unclash

#: ASCII white space between words, as characters and as a Java pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"

#: Bit of each rule; the order is part of the ledger's format and only ever grows.
RULES = ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document passes if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STRICT = Policy("strict", 1, RULES)


def measurements(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word),
    n_dup_lines (equal to an earlier line), n_repeat_words (words covered by a 3-word
    window that the text holds twice or more). Windows are sorted within the row and
    compared with their neighbours: no shuffle, no cross product, O(n log n) per text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = unclash(docs, ["doc_id", "text"]).select("doc_id", text.alias("text"))
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    split = base.select(
        "doc_id", F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1)).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"))
    n = F.size("w")
    windows = F.arrays_zip(F.col("w"), F.slice("w", F.lit(2), n), F.slice("w", F.lit(3), n), F.sequence(F.lit(1), n)).cast(
        "array<struct<a:string,b:string,c:string,i:int>>")
    counted = split.select(
        "doc_id", "n_symbols", n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        # the last two entries of the zip are not windows: their third word is missing
        F.when(n > 3, F.sort_array(F.slice(windows, F.lit(1), n - 2))).alias("s"))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    pairs = F.zip_with("s", F.slice("s", F.lit(2), F.size("s")),
                       lambda x, y: F.when(y.isNotNull() & same(x, y), F.array(x["i"], y["i"])))
    hits = counted.select(
        "*", F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))).alias("at"))
    # a window covers 3 words, or fewer when the next repeated one starts before its end
    cover = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    return hits.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       F.coalesce(F.aggregate(cover, F.lit(0), lambda s, x: s + x).cast("long"), F.lit(0).cast("long")).alias("n_repeat_words"))


def failures(symbols_percent: int = 10, lines_percent: int = 30, word_length: tuple[int, int] = (2, 12)) -> Column:
    """Bitmask of the failed rules, from the measurements (integer arithmetic only)."""
    n, chars = F.col("n_words"), F.col("word_chars")
    tests = {
        "few_words": n < 50,
        "repeated_words": 100 * F.col("n_repeat_words") > 50 * n,
        "symbols": 100 * F.col("n_symbols") > symbols_percent * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > lines_percent * F.col("n_lines"),
        "word_length": (chars < word_length[0] * n) | (chars > word_length[1] * n),
    }
    bits = [F.when(tests[r], F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out.cast("long")


def ledger(docs: DataFrame, **limits) -> DataFrame:
    """measurements() with ``failures``: the one pass over the text."""
    return measurements(docs).withColumn("failures", failures(**limits))


def passes(policy: Policy) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(rows: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with the policy's name, version and verdict."""
    return rows.select("*", F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("policy_version"), passes(policy).alias("kept"))


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: documents that fail it, and that fail it alone.

    (rule, failing, failing_alone, kept_without): the last is how many documents would be
    kept if the policy lost this rule. The ledger is first summed to one row per failure
    pattern (at most 2**rules rows), and the rules read that histogram.
    """
    mask = policy.mask
    patterns = (rows.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n")))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules]))
    x = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond, name: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0))).alias(name)
    return x.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0, "failing"),
        total(F.col("bits") == F.col("bit"), "failing_alone"),
        total((F.col("bits") == 0) | (F.col("bits") == F.col("bit")), "kept_without"))


def op7_rules(docs: DataFrame, policy: Policy = STRICT) -> DataFrame:
    """The query's digest: measurements, base_failed, and the policy's verdict."""
    rows = ledger(docs)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (~passes(BASE)).alias("base_failed"), (passes(BASE) & passes(policy)).alias("kept"), "failures")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t-\r]+', '', 'g') <> '') AS l FROM d),
p AS (SELECT rid, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM w),
t AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM p WINDOW o AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) > 1 AS hit FROM t WHERE c IS NOT NULL),
h AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r WHERE hit) GROUP BY rid),
m AS (SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
        (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        len(l.l)::BIGINT AS n_lines, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
        coalesce(h.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (rid) JOIN l USING (rid) LEFT JOIN h USING (rid)),
f AS (SELECT *, ((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
        + (CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 16 ELSE 0 END))::BIGINT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""
