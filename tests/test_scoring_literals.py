"""Literal scoring, graph and result cases (FIXTURES.md §4-§5)."""

import re

import pytest
from conftest import java_files_df
from pyspark.sql import functions as F

from pkgsift.operators import cycles as CY
from pkgsift.operators import graph as G
from pkgsift.operators import metrics as P
from pkgsift.operators import placement as PL
from pkgsift.operators import rules as RU
from pkgsift.operators.extract import classes_from_files
from pkgsift.plans import recommend as RC

CLASS_SCHEMA = ("project_id bigint, class_pos int, class_name string, package string, file_path string, "
                "relative_path string, imports array<string>, methods array<string>, fields array<string>, "
                "annotations array<string>, extends string, implements array<string>, class_type string, "
                "content_preview string")


def _rows(spark, records):
    return spark.createDataFrame(records, CLASS_SCHEMA)


def _rec(name, package="com.example.model", methods=(), annotations=(), rel=None, pos=0, pid=1):
    return (pid, pos, name, package, "/demo/" + name + ".java", rel or f"src/{name}.java", [], list(methods), [],
            list(annotations), "", [], "class", "")


def _score(spark, name, methods=(), annotations=()):
    r = RU.with_rule_scores(_rows(spark, [_rec(name, methods=methods, annotations=annotations)])).collect()[0]
    return r.rule_score, r.rule_type


def test_dao_counts_twice(spark):
    assert _score(spark, "UserDao") == (1.0, "repository")


def test_plain_class_is_model_with_zero(spark):
    assert _score(spark, "Plain") == (0.0, "model")


def test_camel_case_rule_methods_never_match(spark):
    # 'getMessage' is a rule method of 'exception' but methods are lower-cased first
    s, t = _score(spark, "Plain", methods=["getMessage"])
    assert t == "model" and abs(s - 0.1) < 1e-12  # 'get' of model / controller matches


def test_package_type_first_substring(spark):
    df = spark.createDataFrame([("org.remodel.service",), ("com.x",)], "package string")
    out = [r.t for r in df.select(RU.package_type(F.col("package")).alias("t")).collect()]
    assert out == ["model", "unknown"]


def test_threshold_passes_by_float_rounding(spark):
    df = spark.range(1).select(
        (F.lit(1.0) * F.lit(0.4) + F.lit(0.0) * F.lit(0.4) + F.lit(1.0) * F.lit(0.2)).alias("t"))
    t = df.collect()[0].t
    assert t == 0.6000000000000001 and t > 0.6


def test_self_edge_and_cycle(spark):
    cls = classes_from_files(java_files_df(spark, [(1, "src/A.java", "class A {} class B extends A {}")]))
    e = G.edges(cls)
    assert sorted((r.src, r.dst) for r in e.collect()) == [("A", "A"), ("B", "A")]
    cyc = CY.simple_cycles(e).collect()
    assert [(r.cycle, r.length) for r in cyc] == [("A->A", 1)]
    assert [r.class_name for r in CY.cyclic_classes(e).collect()] == ["A"]


def test_cycles_larger_components(spark):
    edges = spark.createDataFrame(
        [(1, "A", "B"), (1, "B", "C"), (1, "C", "A"), (1, "C", "D"), (1, "D", "E"), (1, "E", "D"),
         (1, "X", "A"), (2, "P", "Q")], "project_id bigint, src string, dst string")
    cyclic = sorted((r.project_id, r.class_name) for r in CY.cyclic_classes(edges).collect())
    assert cyclic == [(1, "A"), (1, "B"), (1, "C"), (1, "D"), (1, "E")]
    cycles = sorted(r.cycle for r in CY.simple_cycles(edges).collect())
    assert cycles == ["A->B->C->A", "D->E->D"]


def test_duplicate_names_share_flag_and_suggestion(spark):
    recs = [_rec("UtilHelper", package="p.service", rel="src/a/UtilHelper.java"),
            _rec("UtilHelper", package="q.util", rel="src/b/UtilHelper.java")]
    cls = _rows(spark, recs)
    idx = G.class_index(cls).collect()
    assert [(r.class_name, r.package) for r in idx] == [("UtilHelper", "q.util")]
    res = RC.analyze(cls, store=False).results.orderBy("relative_path").collect()
    assert len(res) == 2
    assert res[0].is_misplaced == res[1].is_misplaced
    assert res[0].suggested_package == res[1].suggested_package or not res[0].is_misplaced


def test_demo_records_quick_rule(spark):
    recs = [
        (1, 0, "UserController", "com.example.model", "/demo/UserController.java",
         "src/main/java/com/example/model/UserController.java",
         ["org.springframework.web.bind.annotation.RestController"],
         ["getUser", "createUser", "updateUser", "deleteUser"], ["userService"],
         ["RestController", "RequestMapping"], "", [], "class", ""),
        (1, 0, "ReportGenerator", "com.example.model", "/demo/ReportGenerator.java",
         "src/main/java/com/example/model/ReportGenerator.java", ["java.util.List", "com.example.model.Report"],
         ["generateReport", "exportToCSV", "exportToPDF", "formatData"], ["dateFormatter", "csvWriter"],
         ["Component"], "", [], "class", ""),
        (1, 0, "User", "com.example.model", "/demo/User.java", "src/main/java/com/example/model/User.java",
         ["javax.persistence.Entity", "javax.persistence.Table"],
         ["getId", "setId", "getName", "setName", "equals", "hashCode"], ["id", "name", "email", "createdDate"],
         ["Entity", "Table"], "", [], "class", ""),
    ]
    out = {r.class_name: r for r in RU.quick_classify(_rows(spark, recs)).collect()}
    assert (out["UserController"].is_misplaced, out["UserController"].suggested_package,
            out["UserController"].confidence) == (True, "com.example.controller", 0.92)
    assert (out["ReportGenerator"].is_misplaced, out["ReportGenerator"].suggested_package,
            out["ReportGenerator"].confidence) == (True, "com.example.service", 0.87)
    assert (out["User"].is_misplaced, out["User"].suggested_package,
            out["User"].confidence) == (False, "com.example.model", 0.95)


def test_empty_input_gives_empty_results_and_zero_rates(spark):
    cls = _rows(spark, [])
    res = RC.analyze(cls, store=False).results
    assert res.count() == 0
    assert P.overview(res).count() == 0


def test_single_misplaced_row_has_null_std(spark):
    res = spark.createDataFrame([(1, "a", 0, "X", True, 0.9)],
                                "project_id bigint, relative_path string, class_pos int, current_package string,"
                                " is_misplaced boolean, confidence double")
    r = P.confidence_stats(res).collect()[0]
    assert r.confidence_std is None and r.average_confidence == 0.9


def test_confidence_threshold_only_above_default(spark):
    res = spark.createDataFrame([(True, 0.7), (True, 0.9), (False, 0.95)], "is_misplaced boolean, confidence double")
    assert PL.apply_confidence_threshold(res, 0.6).where("is_misplaced").count() == 2
    assert PL.apply_confidence_threshold(res, 0.8).where("is_misplaced").count() == 1


def test_pluggable_batch_encoder(spark):
    from pkgsift.operators.vectors import encode_classes, udf_encoder

    def make():
        return lambda texts: [[float(len(t)), 1.0, 0.0] for t in texts]

    recs = [_rec("UserDao", rel="src/a.java"), _rec("UserDao", rel="src/b.java"), _rec("Plain")]
    cv = encode_classes(_rows(spark, recs), udf_encoder(make, 3))
    out = {r.class_name: r.vec for r in cv.collect()}
    assert set(out) == {"UserDao", "Plain"}
    assert all(len(v) == 3 and v[1] == 1.0 and v[2] == 0.0 for v in out.values())
    with pytest.raises(Exception, match="the encoder gave 3 numbers, not 4"):
        encode_classes(_rows(spark, recs), udf_encoder(make, 4)).collect()


def test_vectors_of_another_length_have_cosine_zero(spark):
    """One contract for M6 and M7, at any dimension."""
    from pkgsift.operators import vectors as V

    for dim in (3, 80):
        types = [(t, i, [1.0] * dim) for i, t in enumerate(V.C.TYPE_NAMES)]
        cv = spark.createDataFrame([(1, "Same", [1.0] * dim), (1, "Short", [1.0] * (dim - 1)), (1, "Zero", [0.0] * dim)], "project_id long, class_name string, vec array<double>")
        got = {r.class_name: (r.emb_type, round(r.emb_score, 9)) for r in V.nearest_type(cv, types).collect()}
        assert got == {"Same": (V.C.TYPE_NAMES[0], 1.0), "Short": (V.C.TYPE_NAMES[0], 0.0), "Zero": (V.C.TYPE_NAMES[0], 0.0)}
        pairs = spark.createDataFrame([(1, "Same", "Short"), (1, "Same", "Zero"), (1, "Same", "Same")], "project_id long, src string, dst string")
        assert {r.dst: round(r.cosine, 9) for r in V.pair_similarity(pairs, cv).collect()} == {"Short": 0.0, "Zero": 0.0, "Same": 1.0}


def test_bad_files_are_reported(spark, tmp_path):
    from pkgsift.sources.files import bad_files

    (tmp_path / "petclinic" / "src").mkdir(parents=True)
    (tmp_path / "petclinic" / "src" / "A.java").write_bytes(b"class A { \xff }")
    (tmp_path / "petclinic" / "src" / "B.java").write_bytes("class Ä { }".encode())
    assert [tuple(r) for r in bad_files(spark, str(tmp_path)).collect()] == [("petclinic", "src/A.java", "invalid UTF-8")]


def test_hashing_encoder_against_a_plain_one(spark):
    import hashlib
    import math

    from pkgsift.operators.vectors import hashing_encoder

    def plain(text):
        v = [0.0] * 64
        for t in re.split(r"[^a-z0-9_]+", (text or "").lower()):
            if t:
                h = hashlib.md5(t.encode()).hexdigest()
                v[int(h[:8], 16) % 64] += -1.0 if int(h[8], 16) % 2 else 1.0
        n = math.sqrt(sum(x * x for x in v))
        return [x / n for x in v] if n else v

    texts = ["Class name: UserDao Methods: get_user getUser, get_user", "", None, "  ;;  ", "a", "a " * 5000 + "b",
             "café 中文 x1"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r.i: list(r.vec) for r in hashing_encoder(rows).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
