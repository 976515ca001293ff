"""Java source corpus derived from the order tables.

The driver's tables hold no Java text, so a corpus is generated from them:
one order is one source file, one customer is one project. Lineitems become
import / field / method lines. Everything is a DataFrame job: one aggregation
of ``lineitem`` by order key (partial-aggregation friendly, bounded per order)
and one equi-join with ``orders`` on the same key, so the aggregated side is
already hash-partitioned for the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import TYPE_NAMES
from ..functions.text import pick
from ..session import read_table

# Word lists of the generated corpus (test-data recipe, see FIXTURES.md).
STEMS = ["Order", "User", "Report", "Invoice", "Payment", "Audit", "Data", "Web", "Util", "Config"]
SUFFIXES = ["Entity", "Service", "Controller", "Repository", "DAO", "Helper", "Config",
            "Exception", "Dto", "Manager", "Utils", "Properties", "Thing"]
PACKAGES = ["model", "service", "controller", "repository", "util", "config", "exception", "core"]
VERBS = ["get", "set", "find", "save", "delete", "process", "handle", "execute", "convert",
         "parse", "configure", "getMessage"]
ANNOTATIONS = ["Entity", "Service", "RestController", "Repository", "Component", "Configuration",
               "Override", "ResponseStatus", "Table"]

NL = "\n"


def _name(k):
    return F.concat(pick(STEMS, k % 10), pick(SUFFIXES, F.floor(k / 10).cast("long") % 13))


def java_files_from_orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """java_files(project_id, file_path, relative_path, content)."""
    li = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    # collect_list gains nothing from map-side partial aggregation, so the
    # narrow numeric rows are hash-partitioned by order key first and all
    # text is built after the shuffle, in parallel (the aggregation reuses the
    # partitioning: one exchange).
    per_order = (
        li.repartition("l_orderkey")
        .groupBy("l_orderkey")
        .agg(F.array_sort(F.collect_list(
            F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))).alias("ps"))
    )
    pk, sk = (lambda p: p["l_partkey"]), (lambda p: p["l_suppkey"])

    def lines(fn):
        return F.array_join(F.transform("ps", fn), "")

    per_order = per_order.select(
        F.col("l_orderkey"),
        lines(lambda p: F.concat(F.lit("import com.acme."), pick(PACKAGES, pk(p) % 8), F.lit("."),
                                 pick(STEMS, pk(p) % 10), pick(SUFFIXES, sk(p) % 13),
                                 F.lit(";" + NL))).alias("imps"),
        lines(lambda p: F.concat(F.lit("  private static final String f"), (pk(p) % 17).cast("string"),
                                 F.lit(" = null;" + NL))).alias("flds"),
        lines(lambda p: F.concat(F.lit("  public void "), pick(VERBS, pk(p) % 12), pick(STEMS, sk(p) % 10),
                                 F.lit("(int a) { }" + NL))).alias("mths"),
    )
    o = orders.select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("project_id"),
                      F.col("o_orderstatus").alias("status"))
    # The per-order text grows with the data: never broadcast it. A sort-merge
    # join reuses the aggregation's hash partitioning on the order key, so only
    # the three narrow order columns are shuffled.
    j = o.join(per_order.hint("merge"), o["k"] == per_order["l_orderkey"], "left")
    k = F.col("k")
    kind = (F.when(k % 11 == 9, F.lit("interface ")).when(k % 11 == 10, F.lit("enum "))
            .otherwise(F.lit("class ")))
    content = F.concat(
        F.when(k % 13 == 12, F.lit("")).otherwise(
            F.concat(F.lit("package com.acme."), pick(PACKAGES, F.floor(k / 7).cast("long") % 8),
                     F.lit(";" + NL))),
        F.coalesce(F.col("imps"), F.lit("")),
        F.lit("@"), pick(ANNOTATIONS, k % 9), F.lit(NL),
        F.lit("public "), kind, _name(k),
        F.when(F.col("status") == "F", F.concat(F.lit(" extends "), _name(k + 1))).otherwise(F.lit("")),
        F.when(F.col("status") == "O",
               F.concat(F.lit(" implements "), _name(k + 3), F.lit(", Runnable"))).otherwise(F.lit("")),
        F.lit(" {" + NL),
        F.coalesce(F.col("flds"), F.lit("")),
        F.coalesce(F.col("mths"), F.lit("")),
        F.lit("}" + NL),
        F.when(k % 10 == 7, F.concat(F.lit("class "), _name(k + 5), F.lit(" { }" + NL))).otherwise(F.lit("")),
    )
    rel = F.concat(F.lit("src/main/java/F"), k.cast("string"), F.lit(".java"))
    return j.select(
        F.col("project_id"),
        F.concat(F.lit("/corpus/"), F.col("project_id").cast("string"), F.lit("/"), rel).alias("file_path"),
        rel.alias("relative_path"),
        content.alias("content"),
    )


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return java_files_from_orders(read_table(spark, sf_dir, "orders"),
                                  read_table(spark, sf_dir, "lineitem"))


def file_key(relative_path_col):
    """Order key encoded in a generated relative path ('src/main/java/F12.java' -> 12)."""
    return F.regexp_extract(relative_path_col, r"F(\d+)\.java$", 1).cast("long")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing (project_id, root, path) over the generated corpus.

    Some files sit below build-output or VCS folders so that directory
    pruning and relative-path recovery have something to do.
    """
    files = java_files(spark, sf_dir).select("project_id", "relative_path")
    k = file_key(F.col("relative_path"))
    mid = (F.when(k % 9 == 0, F.lit("target/")).when(k % 9 == 1, F.lit("mod/build/"))
           .when(k % 9 == 2, F.lit(".git/")).otherwise(F.lit("")))
    root = F.concat(F.lit("/corpus/"), F.col("project_id").cast("string"))
    return files.select("project_id", root.alias("root"),
                        F.concat(root, F.lit("/"), mid, F.col("relative_path")).alias("path"))


def class_vector_ids(classes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(project_id, class_name, vec_id): the id of the vector of the last row of a name.

    The vector id of a row is its file's order key modulo the number of vectors in the table.
    """
    # the last row in (relative_path, class_pos) order has the largest path
    last = (classes.groupBy("project_id", "class_name").agg(F.max("relative_path").alias("last_path"))
            .select("project_id", "class_name", file_key(F.col("last_path")).alias("k")))
    count = max(1, embeddings.count())
    return last.select("project_id", "class_name", (F.col("k") % count).alias("vec_id"))


def vectors_by_id(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))


def class_vectors(classes: DataFrame, embeddings: DataFrame) -> DataFrame:
    """class_vec(project_id, class_name, vec): the given vector of the last row of a name."""
    return (class_vector_ids(classes, embeddings).join(vectors_by_id(embeddings), "vec_id")
            .select("project_id", "class_name", "vec"))


def type_vectors(embeddings: DataFrame) -> DataFrame:
    """type_vec(package_type, type_ord, vec): vector ids 0..6 in rule type order."""
    return embeddings.where(F.col("vec_id") < len(TYPE_NAMES)).select(
        pick(TYPE_NAMES, F.col("vec_id")).alias("package_type"),
        F.col("vec_id").cast("int").alias("type_ord"),
        F.col("embedding").cast("array<double>").alias("vec"))
