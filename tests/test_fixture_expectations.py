"""Expected values of the derived corpus at sf0.01 (FIXTURES.md §2)."""

import pytest
from conftest import SF_MID
from pyspark.sql import functions as F

from pkgsift.operators import graph as G
from pkgsift.operators import metrics as P
from pkgsift.plans import catalog as K


@pytest.fixture(scope="module")
def analysis(spark):
    return K.analysis(spark, SF_MID)


def test_corpus_shape(spark, analysis):
    cls = analysis.classes
    assert cls.count() == 16_500
    assert cls.select("project_id", "class_name").distinct().count() == 15_813
    assert cls.select("package").distinct().count() == 9
    e = G.edges(cls)
    assert e.count() == 6_596
    assert e.where("src = dst").count() == 527


def test_flagship_counts(spark, analysis):
    res = analysis.results
    mis = res.where("is_misplaced")
    assert mis.count() == 1_481
    assert mis.select("project_id", "class_name").distinct().count() == 1_357
    b = P.confidence_buckets(res).agg(*[F.sum(c).alias(c) for c in (
        "high_confidence_suggestions", "medium_confidence_suggestions", "low_confidence_suggestions")]).first()
    assert tuple(b) == (1_233, 238, 10)
    stats = mis.agg(F.avg("confidence").alias("m"), F.min("confidence").alias("lo")).first()
    assert round(stats.m, 6) == 0.864382 and stats.lo == 0.2
    sugg = {r.suggested_package: r["count"] for r in mis.groupBy("suggested_package").count().collect()}
    assert sugg == {"repository": 539, "service": 270, "model": 266, "controller": 177, "util": 159,
                    "config": 42, "exception": 28}


def test_without_embeddings(spark):
    a = K.analysis(spark, SF_MID, use_embeddings=False)
    assert a.results.where("is_misplaced").count() == 523
