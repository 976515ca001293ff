"""The scan patterns of extraction give the matches of the full patterns, on texts of random tokens."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from pkgsift.functions import constants as C
from pkgsift.functions.text import cap_ws_runs, rx_all
from pkgsift.operators import extract as X

TOKENS = ["public", "private", "protected", "class", "interface", "enum", "import", "static", "final", "void", "abstract", " ", "  ", "\n", "    ", "\t", "\x0b",
          "cl", "cnum", "elass", "p", "pub", "in", "e", "foo", "_b9", "9", "é", "x", "(", ")", "(int a)", ";", "=", "<T>", "[", ",", ".", "a.b.C", "@", "{", "}"]


def test_scans_match_the_full_patterns(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice(TOKENS) for _ in range(r.randint(1, 60)))) for i in range(8000)]
    rows += [(-1, None), (-2, ""), (-3, "public static final int foo ( int a ) { } private int b = 1; protected List<int[]>  c  ;")]
    df, c = spark.createDataFrame(rows, "id long, content string"), F.col("content")
    pairs = {"imports": (X.imports_of(c), rx_all(c, C.IMPORT_RX)), "names": (X.class_names_of(c), rx_all(c, C.CLASS_RX)),
             "methods": (rx_all(c, X.METHOD_SCAN_RX), rx_all(c, C.METHOD_RX)), "fields": (rx_all(c, X.FIELD_SCAN_RX), rx_all(c, C.FIELD_RX)),
             "blanks": (cap_ws_runs(c), F.regexp_replace(c, r"\s{4,}", "   "))}
    got = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()]).first()
    assert got.asDict() == dict.fromkeys(pairs, 0)
    found = df.agg(*[F.sum(F.size(a)).alias(k) for k, (a, _) in pairs.items() if k != "blanks"]).first()
    assert min(found) > 20


def test_class_types_look_for_the_name_in_the_text(spark):
    df = spark.createDataFrame([("enum A { } interface B { } class C { }",), (None,)], "content string")
    names = F.array(*[F.lit(n) for n in "ABC"])
    assert [r[0] for r in df.select(X.class_types_of(F.col("content"), names)).collect()] == [["enum", "interface", "class"], ["class"] * 3]


def test_members_and_names_match_the_full_patterns(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(TOKENS) for _ in range(r.randint(1, 60)))) for i in range(6000)]
    rows += [(-1, None), (-2, ""), (-3, "public int a(int b) { } public class A { private int c; int d() { } public int e = 1; protected void\n\n\n\n f () }"),
             (-4, "private int g() { } public  (int a) public x(int b)"), (-5, "class A { } class B"), (-6, "class A { } enum B { } interface C")]
    df, c = spark.createDataFrame(rows, "id long, content string"), F.col("content")
    fields = F.filter(rx_all(c, C.FIELD_RX), lambda x: ~x.isin(*C.JAVA_KEYWORDS))
    pairs = {"names": (X.class_names_of(c), rx_all(c, C.CLASS_RX)), "methods": (X.methods_of(c), rx_all(c, C.METHOD_RX)), "fields": (X.fields_of(c), fields)}
    assert df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in pairs.items()]).first().asDict() == dict.fromkeys(pairs, 0)
    found = df.agg(*[F.sum(F.size(a)).alias(k) for k, (a, _) in pairs.items()]).first()
    assert min(found) > 20


def test_implements_of_odd_texts(spark):
    rows = [(None,), ("",), ("implements",), ("implements A",), ("implements ,A , B{",), ("implements \n{",)]
    got = [r[0] for r in spark.createDataFrame(rows, "content string").select(X.implements_of(F.col("content"))).collect()]
    assert got[:3] == [None, [], []] and got[3:5] == [["A"], ["", "A", "B"]] and got[5] in ([], [""])


def test_each_scan_is_in_the_plan_once(spark):
    df = spark.createDataFrame([(1, "/c/A.java", "A.java", "class A { }")], "project_id long, file_path string, relative_path string, content string")
    out = io.StringIO()
    with redirect_stdout(out):
        X.classes_from_files(df).explain()
    plan = out.getvalue()
    assert [plan.count(x) for x in (r"class\s++", "(?<=c)lass", r"implements\s+", r"import\s++")] == [1, 1, 1, 1] and r"\s\s\s\s++" not in plan
