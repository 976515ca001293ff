"""The public path with its defaults, root spellings and the whole vector table."""

import pytest
from conftest import SF_MID, SF_SMALL, java_files_df
from pyspark.sql import functions as F

from pkgsift.operators import graph as G
from pkgsift.operators.cycles import simple_cycles
from pkgsift.operators.extract import classes_from_files
from pkgsift.operators.metrics import full_metrics
from pkgsift.operators.vectors import nearest_type, similar_pairs
from pkgsift.plans import catalog as K
from pkgsift.plans.recommend import recommend
from pkgsift.session import read_table
from pkgsift.sources import corpus
from pkgsift.sources.files import decode_text, java_files_from_tree, source_file_counts
from pkgsift.sources.sinks import write_metrics_json, write_results_csv


def test_recommend_with_default_arguments(spark):
    files = java_files_df(spark, [(1, "A.java", "package a;\nclass UserDao {}\n"), (1, "B.java", "package a;\nclass Plain {}\n")])
    assert recommend(classes_from_files(files)).count() >= 0


@pytest.mark.parametrize("spelling", ["{}", "file:{}", "file://{}"])
def test_root_spellings(spark, tmp_path, spelling):
    for n in ("3", "7"):
        (tmp_path / n).mkdir()
        (tmp_path / n / "A.java").write_text("class A {}")
    rows = source_file_counts(spark, spelling.format(tmp_path)).collect()
    assert sorted((r.project_id, r.java_files) for r in rows) == [("3", 1), ("7", 1)]


def test_genuine_replacement_character_is_kept(spark):
    df = spark.createDataFrame([(bytearray("a�b".encode()),), (bytearray(b"a\xffb"),)], "content binary")
    assert [r.t for r in df.select(decode_text(F.col("content")).alias("t")).collect()] == ["a�b", "ab"]


def test_every_vector_is_reachable(spark):
    emb = read_table(spark, SF_SMALL, "embeddings")
    n = emb.count()
    classes = spark.range(3 * n).select(
        F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("C"), "id").alias("class_name"),
        F.concat(F.lit("src/main/java/F"), "id", F.lit(".java")).alias("relative_path"), F.lit(0).alias("class_pos"))
    vecs = corpus.class_vectors(classes, emb.select((F.col("vec_id")).alias("vec_id"), F.array(F.col("vec_id").cast("float")).alias("embedding")))
    assert vecs.select("vec").distinct().count() == n


@pytest.mark.parametrize("spelling", ["{}", "file:{}", "file://{}"])
def test_named_projects_from_tree_to_sinks(spark, tmp_path, spelling):
    for name in ("petclinic", "other-app", "7"):
        (tmp_path / "in" / name / "target").mkdir(parents=True)
        (tmp_path / "in" / name / "A.java").write_text("package x.util;\n@Repository\npublic class UserRepository { UserService s; }\n")
        (tmp_path / "in" / name / "B.java").write_text("package x.web;\npublic class UserService { }\n")
        (tmp_path / "in" / name / "target" / "C.java").write_text("class C {}")
    classes = classes_from_files(java_files_from_tree(spark, spelling.format(tmp_path / "in")))
    results = recommend(classes, confidence=0.0)
    assert {r.project_id for r in results.collect()} == {"petclinic", "other-app", "7"}
    write_results_csv(results, str(tmp_path / "csv"))
    write_metrics_json(full_metrics(results), str(tmp_path / "json"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() == results.count()
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    one = java_files_from_tree(spark, spelling.format(tmp_path / "in" / "petclinic"), project="petclinic")
    assert sorted(r.relative_path for r in one.where("project_id = 'petclinic'").collect()) == ["A.java", "B.java"]


@pytest.mark.parametrize("n", [6, 20])
def test_long_rings_are_found(spark, n):
    names = [f"N{i:02}" for i in range(n)]
    edges = spark.createDataFrame([("p", a, b) for a, b in zip(names, names[1:] + names[:1])], "project_id string, src string, dst string")
    assert [(r.cycle, r.length) for r in simple_cycles(edges).collect()] == [("->".join(names + names[:1]), n)]
    assert simple_cycles(edges, max_length=n - 1).count() == 0 and simple_cycles(edges.limit(n - 2)).count() == 0


def test_registered_cycles_have_no_length_cap(spark):
    """Against a plain depth-first listing from each least name; sf0.01 holds cycles of 6 and 7 classes."""
    after = {}
    for r in G.edges(K.classes_table(spark, SF_MID, K.GRAPH_COLUMNS)).distinct().collect():
        after.setdefault((r.project_id, r.src), []).append(r.dst)
    want = set()
    for project, start in after:
        todo = [[start]]
        while todo:
            path = todo.pop()
            for x in after.get((project, path[-1]), []):
                if x == start:
                    want.add((project, "->".join(path + [x]), len(path)))
                elif x > start and x not in path:
                    todo.append(path + [x])
    got = [(r.project_id, r.cycle, r.length) for r in K.REGISTRY["D12_cycles"](spark, SF_MID).collect()]
    assert len(got) == len(want) and set(got) == want and max(n for _, _, n in got) > 5


def test_vector_of_another_length_gets_cosine_0(spark):
    vecs = spark.createDataFrame([("p", "A", [1.0, 0.0]), ("p", "B", [1.0])], "project_id string, class_name string, vec array<double>")
    got = {r.class_name: r.emb_score for r in nearest_type(vecs, [("x", 0, [0.0, 1.0]), ("y", 1, [1.0, 0.0])]).collect()}
    assert got == {"A": 1.0, "B": 0.0}


def test_similar_pairs_recall_and_groups_of_equal_vectors(spark):
    import numpy as np

    r = np.random.default_rng(5)
    x = r.standard_normal((1500, 64))
    x[1000:] = x[:500] + 0.42 * r.standard_normal((500, 64))
    x = np.concatenate([x, x[:20], x[:20], np.zeros((2, 64))])
    names = [f"C{i:04}" for i in range(len(x))]
    df = spark.createDataFrame([("p", n, v.tolist()) for n, v in zip(names, x)], "project_id string, class_name string, vec array<double>")
    got = similar_pairs(df).collect()
    unit = x[:1500] / np.linalg.norm(x[:1500], axis=1, keepdims=True)
    cos = unit @ unit.T
    want = {(names[a], names[b]) for a, b in zip(*np.triu_indices(1500, 1)) if cos[a, b] >= 0.9}
    pairs = {(g.a, g.b) for g in got if g.kind == "pair"}
    assert len(want) > 100 and pairs <= want and len(pairs) >= 0.999 * len(want) - 1
    assert {(g.a, g.b) for g in got if g.kind == "copy"} == {(names[i % 20], names[1500 + i]) for i in range(40)}
