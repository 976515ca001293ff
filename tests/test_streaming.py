"""Structured Streaming class ingest on a small literal tree."""

import os
import tempfile

from pkgsift.streaming.ingest import start_class_ingest


def _write(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def test_ingest_extracts_new_files_once(spark):
    base = tempfile.mkdtemp(prefix="pkgsift-stream-")
    root, table, ckpt = (os.path.join(base, d) for d in ("src", "table", "ckpt"))
    _write(root, "7/src/A.java", "package p.model;\nclass A {}\nclass B extends A {}\n")
    _write(root, "7/target/Gen.java", "class Gen {}\n")          # pruned folder
    _write(root, "petclinic/x/C.java", "public interface C {}\n")
    start_class_ingest(spark, root, table, ckpt).awaitTermination()
    rows = sorted((r.project_id, r.class_name, r.package, r.class_type)
                  for r in spark.read.parquet(table).collect())
    assert rows == [("7", "A", "p.model", "class"), ("7", "B", "p.model", "class"),
                    ("petclinic", "C", "default", "interface")]
    # a second run with one new file only adds that file's classes
    _write(root, "petclinic/x/D.java", "enum D { X }\n")
    start_class_ingest(spark, root, table, ckpt).awaitTermination()
    names = sorted(r.class_name for r in spark.read.parquet(table).collect())
    assert names == ["A", "B", "C", "D"]
