"""Steps that a larger corpus runs into: source archives, whole projects in a task, vectors that travel last."""

import io
import os
import zipfile
from contextlib import redirect_stdout

from pkgsift.operators import graph as G
from pkgsift.operators import neighbours
from pkgsift.operators import placement as PL
from pkgsift.operators import vectors as V
from pkgsift.plans import recommend as RC
from pkgsift.session import ship_package
from pkgsift.sources import files as FS
from pkgsift.streaming.ingest import start_class_ingest


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


ROWS = [(7, "A.java", b"class A {}"), (7, "B.java", b"class B { \xff }"), (7, "target/C.java", b"class C {}"),
        (8, ".git/D.java", b"class D {}"), (8, "_x/E.java", b"class E {}"), (8, "x/F.java", b"class F {}"), (8, "x/F.java", b"class F {}")]


def test_archives_read_like_a_tree_of_files(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "project_id long, relative_path string, content binary")
    loose, packed = str(tmp_path / "loose"), str(tmp_path / "packed")
    FS.write_source_tree(df, loose)
    FS.write_source_archives(df, packed)
    held = [n for _, _, names in os.walk(packed) for n in names if not n.endswith(".crc")]
    assert 0 < len(held) <= 8 and all(n.endswith(FS.ARCHIVE_SUFFIX) for n in held)
    for read in (lambda r: FS.java_files_from_tree(spark, r).drop("file_path"), lambda r: FS.bad_files(spark, r), lambda r: FS.source_file_counts(spark, r),
                 lambda r: FS.with_project(FS.scan_sources(spark, r, content=False).select("path", "length"), r).select("project_id", "length")):
        want, got = (sorted(map(tuple, read(r).collect())) for r in (loose, packed))
        assert got == want and got
    for r in (loose, packed):
        start_class_ingest(spark, r, r + "-table", r + "-ckpt").awaitTermination()
    want, got = (sorted(map(tuple, spark.read.parquet(r + "-table").select("project_id", "relative_path", "class_name").collect())) for r in (loose, packed))
    assert got == want and len(got) == 3


def test_damaged_members_are_reported(spark, tmp_path):
    path = tmp_path / "p-sources.jar"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("p/A.java", "class A { int first; }")
        z.writestr("p/B.java", "class B {}")
    path.write_bytes(path.read_bytes().replace(b"int first", b"int fxrst"))
    (tmp_path / "none-sources.jar").write_bytes(b"no archive")
    assert [tuple(r) for r in FS.bad_files(spark, str(tmp_path)).collect()] == [("p", "A.java", "unreadable")]
    assert [r.relative_path for r in FS.java_files_from_tree(spark, str(tmp_path)).collect()] == ["B.java"]


def vectors(spark):
    rows = [("p", f"C{i}", [float(i % 7), 1.0, float(i % 3)]) for i in range(30)] + [("q", "X", [1.0, -0.0]), ("q", "Y", [1.0, 0.0]), (None, "N", [1.0])]
    return spark.createDataFrame(rows, "project_id string, class_name string, vec array<double>")


def test_small_projects_move_their_vectors_once(spark):
    ship_package(spark)
    df = vectors(spark)
    for out in (V.similar_pairs(df), neighbours.exact_pairs(df), neighbours.nearest_classes(df)):
        assert plan(out).count("Exchange") == 1 and "Join" not in plan(out)


def test_small_and_large_projects_give_the_same_rows(spark, monkeypatch):
    ship_package(spark)
    df = vectors(spark)
    small = [sorted(map(tuple, f(df).select("project_id", "a", "b").collect())) for f in (neighbours.exact_pairs, neighbours.nearest_classes)]
    sign = sorted(map(tuple, V.similar_pairs(df).select("project_id", "a", "b", "kind").collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 1)
    assert [sorted(map(tuple, f(df).select("project_id", "a", "b").collect())) for f in (neighbours.exact_pairs, neighbours.nearest_classes)] == small
    assert sorted(map(tuple, V.similar_pairs(df).select("project_id", "a", "b", "kind").collect())) == sign
    assert ("q", "X", "Y", "copy") in sign


def test_vectors_are_encoded_and_compared_in_batches(spark):
    texts = spark.createDataFrame([(1, "A", "get user")], "project_id long, class_name string, text string")
    shown = plan(V.nearest_type(V.hashing_encoder(texts), [("x", 0, [1.0] * 64)]))
    assert "md5" not in shown and "aggregate(" not in shown


def test_best_type_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("A", [nan, 1.0]), ("B", [None, 1.0]), ("C", None), ("D", [0.0, -1.0]), ("E", [inf, 1.0]), ("F", [0.0, 3.0])]
    df = spark.createDataFrame([("p", *r) for r in rows], "project_id string, class_name string, vec array<double>")
    got = {r.class_name: (r.emb_type, str(r.emb_score)) for r in V.nearest_type(df, [("y", 1, [0.0, 1.0]), ("x", 0, [1.0, 0.0])]).collect()}
    assert got == {"A": ("x", "nan"), "B": ("x", "0.0"), "C": ("x", "0.0"), "D": ("x", "0.0"), "E": ("x", "nan"), "F": ("y", "1.0")}


def test_pairs_take_their_vectors_last(spark):
    df = vectors(spark).where("class_name is not null and project_id is not null")
    ids = df.selectExpr("project_id", "class_name", "xxhash64(project_id, class_name) as vec_id")
    by_id = df.selectExpr("xxhash64(project_id, class_name) as vec_id", "vec")
    pairs = spark.createDataFrame([("p", "C1", "C2"), ("p", "C3", "C3"), ("q", "X", "none")], "project_id string, src string, dst string")
    want, got = (sorted(map(tuple, x.collect())) for x in (V.pair_similarity(pairs, df), V.pair_similarity_by_id(pairs, ids, by_id)))
    assert got == want and len(got) == 2


def class_rows(spark):
    rows = [("p", 0, n, pkg, path, imports, methods, ["Entity"], ext, []) for n, pkg, path, imports, methods, ext in
            [("UserDao", "a.model", "A.java", ["x.Order", "y.Far", "Order."], ["findUser"], ""), ("UserDao", "a.model", "B.java", ["x.Order"], ["saveUser", "countUser"], "Order"),
             ("Order", "a.model", "C.java", [], [], "UserDao")]]
    return spark.createDataFrame(rows, "project_id string, class_pos int, class_name string, package string, relative_path string, imports array<string>, "
                                       "methods array<string>, annotations array<string>, extends string, implements array<string>")


def test_suggestions_need_no_look_up_of_arrays(spark):
    out = RC.analyze(class_rows(spark), store=False).suggestions
    shown, bare = plan(out), plan(out.select("class_name", "confidence"))
    # the two joins find edges and their scores
    assert (shown.count("Join"), bare.count("Join")) == (2, 2)
    assert "max_by(struct(methods" in shown and "max_by(struct(methods" not in bare
    assert [r.evidence for r in out.collect()] == ["Name matches repository pattern; Methods: saveUser, countUser"]


def test_edge_targets_are_looked_up_before_edges_are_made_distinct(spark):
    rows = class_rows(spark)
    edges = G.edges(rows)
    assert sorted((r.src, r.dst) for r in edges.collect()) == [("Order", "UserDao"), ("UserDao", "Order")]
    assert plan(PL.dependency_scores(edges)).count("Aggregate(") == 4
