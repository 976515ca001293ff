"""M5 against plain Lloyd's k-means, solved whole in a task and in distributed rounds."""

import numpy as np
import pytest

from pkgsift.operators import clusters
from pkgsift.session import ship_package

SCHEMA = "project_id string, class_name string, vec array<double>"


def blobs(seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for project, n, centres in (("a", 70, 4), ("b", 900, 8), ("two", 2, 2), ("one", 1, 1)):
        middle = r.normal(0, 10, (centres, 5))
        rows += [(project, f"C{i}", (middle[i % centres] + r.normal(0, 0.5, 5)).tolist()) for i in range(n)]
    rows += [("same", f"C{i}", [1.0, 2.0]) for i in range(9)]
    return rows + [("a", "null", None), ("a", "nan", [float("nan")] * 5), ("a", "hole", [None] * 5), ("a", "short", [1.0]), ("none", "x", None)]


def hashes(spark, rows):
    from pyspark.sql import functions as F

    names = spark.createDataFrame(sorted({(c,) for _, c, _ in rows}), "class_name string")
    cols = [F.xxhash64("class_name", F.lit(r + clusters.C.KMEANS_SEED)).alias(f"h{r}") for r in range(clusters.C.KMEANS_RESTARTS)]
    return {x[0]: x[1:] for x in names.select("class_name", *cols).collect()}


def plain(points, h):
    """(cost, sets of names) of the best restart, point by point."""
    names = sorted(points)
    k = min(max(2, len(names) // 3), 10)
    best = None
    for run in range(clusters.C.KMEANS_RESTARTS):
        c = [np.array(points[n]) for n in sorted(names, key=lambda n: (h[n][run], n))[:k]]
        label = None
        while True:
            d = {n: [((np.array(points[n]) - x) ** 2).sum() for x in c] for n in names}
            new = {n: int(np.argmin(v)) for n, v in d.items()}
            if new == label:
                break
            label = new
            c = [np.mean([points[n] for n in names if label[n] == j], axis=0) if j in label.values() else c[j] for j in range(k)]
        cost = sum(d[n][label[n]] for n in names)
        if best is None or cost < best[0] - 1e-9:
            best = cost, {frozenset(n for n in names if label[n] == j) for j in range(k)} - {frozenset()}
    return best


@pytest.mark.parametrize("block, centre_bytes", [(10_000, 32 << 20), (50, 32 << 20), (1, 3000)])
def test_kmeans_matches_plain_lloyd(spark, monkeypatch, block, centre_bytes):
    ship_package(spark)
    monkeypatch.setattr(clusters, "BLOCK", block)
    monkeypatch.setattr(clusters, "CENTRE_BYTES", centre_bytes)
    rows = blobs()
    h = hashes(spark, rows)
    labels, centres = (d.collect() for d in clusters.kmeans(spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert {x.project_id for x in labels} == {"a", "b", "two", "same"} and all(x.converged for x in centres)
    for project in ("a", "b", "two", "same"):
        points = {c: v for p, c, v in rows if p == project and v and None not in v and v == v and len(v) > 1 and not np.isnan(v[0])}
        got = {x.class_name: x.cluster_id for x in labels if x.project_id == project}
        centre = {x.cluster_id: np.array(x.center) for x in centres if x.project_id == project}
        cost, sets = plain(points, h)
        assert got.keys() == points.keys() and len(centre) == min(max(2, len(points) // 3), 10)
        assert {frozenset(n for n in got if got[n] == j) for j in got.values()} == sets
        assert abs(sum(((np.array(points[n]) - centre[j]) ** 2).sum() for n, j in got.items()) - cost) < 1e-6 * (1 + cost)


def test_kmeans_of_an_empty_table_and_without_convergence(spark):
    ship_package(spark)
    empty = clusters.kmeans(spark.createDataFrame([], SCHEMA))
    assert [d.count() for d in empty] == [0, 0]
    r = np.random.default_rng(1)
    df = spark.createDataFrame([("p", f"C{i}", r.normal(0, 1, 3).tolist()) for i in range(300)], SCHEMA)
    labels, centres = clusters.kmeans(df, max_iter=1)
    assert labels.count() == 300 and not any(x.converged for x in centres.collect())


def test_kmeans_spreads_a_large_project_over_tasks(spark, monkeypatch):
    ship_package(spark)
    df = spark.range(50_000).selectExpr(
        "'hub' as project_id", "concat('C', id) as class_name",
        "transform(sequence(1, 8), j -> if(id % 8 = j - 1, 10D, 0D) + cast(conv(substr(md5(concat(id, ':', j)), 1, 8), 16, 10) as double) / 4294967296D) as vec")
    labels, centres = clusters.kmeans(df)
    assert labels.count() == 50_000 and centres.count() == 10
    assert len(labels.inputFiles()) >= 3
    monkeypatch.setattr(clusters, "BLOCK", 100_000)  # solved whole in one task: the same clusters
    whole = {x.class_name: x.cluster_id for x in clusters.kmeans(df)[0].collect()}
    assert {x.class_name: x.cluster_id for x in labels.collect()} == whole
