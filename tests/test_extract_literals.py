"""Literal edge cases of the extraction (FIXTURES.md §5)."""

from conftest import java_files_df

from pkgsift.operators.extract import classes_from_files, file_features


def _classes(spark, content, rel="src/A.java"):
    return classes_from_files(java_files_df(spark, [(1, rel, content)])).orderBy("class_pos").collect()


def _feats(spark, content):
    return file_features(java_files_df(spark, [(1, "src/A.java", content)])).collect()[0]


def test_phantom_class_from_comment(spark):
    rows = _classes(spark, "// this class is old\nclass A {}")
    assert [r.class_name for r in rows] == ["is", "A"]


def test_annotation_interface(spark):
    rows = _classes(spark, "@interface Foo {}")
    assert [(r.class_name, r.class_type) for r in rows] == [("Foo", "interface")]
    assert rows[0].annotations == ["interface"]


def test_static_and_wildcard_imports_dropped(spark):
    assert _feats(spark, "import static a.B.c; import a.*; import a.B;").imports == ["a.B"]


def test_field_list_keeps_last_name(spark):
    assert _feats(spark, "private int a, b;").fields == ["b"]


def test_method_after_newline_and_blanks(spark):
    assert _feats(spark, "public\n    Foo() {}").methods == ["Foo"]


def test_constructor_is_not_a_method(spark):
    assert _feats(spark, "public Foo() {}").methods == []


def test_long_blank_run_is_linear(spark):
    f = _feats(spark, "public " + " " * 3000 + "x")
    assert f.methods == []


def test_every_class_gets_file_features(spark):
    rows = _classes(spark, "class A {} class B extends A {}")
    assert [r.extends for r in rows] == ["A", "A"]


def test_implements_across_lines(spark):
    assert _feats(spark, "class X implements A,\n  B {").implements == ["A", "B"]


def test_implements_stops_at_generic(spark):
    assert _feats(spark, "class X implements Comparable<T>, B {").implements == ["Comparable"]


def test_package_default_and_first(spark):
    assert _feats(spark, "class A {}").package == "default"
    assert _feats(spark, "package a.b;\npackage c;\nclass A {}").package == "a.b"


def test_preview_after_newline_normalisation(spark):
    from pkgsift.sources.files import decode_text
    from pyspark.sql import functions as F

    text = ("x" * 10 + "\r\n") * 60  # 720 characters with CRLF
    df = spark.createDataFrame([(bytearray(text.encode()),)], "b binary").select(
        decode_text(F.col("b")).alias("content"))
    content = df.collect()[0].content
    assert "\r" not in content
    feats = _feats(spark, content)
    expected = content[:500].replace("\n", " ")
    assert feats.content_preview == expected


def test_invalid_utf8_bytes_dropped(spark):
    from pkgsift.sources.files import decode_text
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(bytearray(b"class \xff\xfeBad {}"),)], "b binary")
    content = df.select(decode_text(F.col("b")).alias("c")).collect()[0].c
    rows = _classes(spark, content)
    assert [r.class_name for r in rows] == ["Bad"]


def test_file_without_class_gives_no_row(spark):
    assert _classes(spark, "package a; import b.C;") == []
