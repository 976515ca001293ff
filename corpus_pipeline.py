"""Corpus pipeline: graded quality, near duplicates, repeated passages, source mixture, token ids.

``STAGES`` lists the stages in order; each takes (spark, docs, sf_dir) and returns a
DataFrame. ``run`` applies them to the documents; each result is written as Parquet in the
shared scratch folder and read again as the next stage's documents, so a lost executor costs
at most the running stage. All stages but the last return the columns of documents.

Defined results: a null text counts as empty, is judged by the classifier like any other text,
has no near duplicates and no windows, and gives no ids; its source needs some text to be
drawn. Very long texts are handled whole. Repeated rows of a document are scored, kept, cut
and drawn alike, each for itself; of a near-duplicate component the smallest doc_id stays, and a
window stays where it occurs first. Rows without a doc_id are kept by the duplicate stages. A null
source is a source of its own. Without labels of two grades nothing is rejected. An empty table gives an empty result. Extra
columns of any name, also of those that a stage uses for itself, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgsift.llm import op1_ordinal, op2_oddsketch, op6_bpe, op8_poisson, op9_automaton
from pkgsift.session import materialize, read_table, ship_package

#: Shares of the sources in the mixture: their size to this power (0: equal, 1: unchanged).
MIX_TEMPERATURE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled documents, keep those more likely good than poor or toxic."""
    ship_package(spark)
    model = op1_ordinal.fit(docs, op1_ordinal.grades_of(read_table(spark, sf_dir, "labels")))
    return op1_ordinal.select(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    ship_package(spark)
    return op2_oddsketch.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the 20-word windows that occur earlier; n_chars follows the text."""
    ship_package(spark)
    kept = op9_automaton.remove_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in kept.columns else kept


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out by their source's rate, globally shuffled."""
    ship_package(spark)
    return op8_poisson.mix(docs, temperature=MIX_TEMPERATURE).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and of the decoded text."""
    ship_package(spark)
    return op6_bpe.digests(docs, op6_bpe.default_vocabulary(spark), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL can't express the fit, the components and the vocabulary: the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
