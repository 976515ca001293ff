"""Class dependency graph.

Keys always include ``project_id``; the class key inside a project is the
simple name (two classes with one name are one node). Shuffles are keyed on
(project_id, class name). Edge candidates meet the name table before they are
de-duplicated: one shuffle of the candidates, whose side of the join AQE can split
where a target name is hot, and an aggregation of the few that are edges.
Counting operators pre-aggregate duplicate class rows into a weight ``n``
instead of joining every row with every edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_segment

PID = "project_id"


def order_key():
    """Row order of the class table: (relative_path, class_pos) ascending."""
    return F.struct("relative_path", "class_pos")


def class_index(classes: DataFrame) -> DataFrame:
    """(project_id, class_name) -> package of the last row of that name."""
    return (classes.groupBy(PID, "class_name")
            .agg(F.max_by("package", order_key()).alias("package")))


def known_names(classes: DataFrame) -> DataFrame:
    return classes.select(PID, "class_name").distinct()


def _resolve(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Keep distinct candidate edges whose target is a known class name.

    Most targets are no class of the project, and only rows of one name repeat an edge. So the
    candidates meet the names first, in one shuffle, and only those found are made distinct.
    """
    names = known_names(classes).withColumnRenamed("class_name", "dst")
    return candidates.join(names, [PID, "dst"], "left_semi").select(PID, "src", "dst").distinct()


def _import_candidates(classes: DataFrame) -> DataFrame:
    targets = F.array_distinct(F.transform("imports", last_segment))
    return classes.select(PID, F.col("class_name").alias("src"), F.explode(targets).alias("dst"))


def _extends_candidates(classes: DataFrame) -> DataFrame:
    return (classes.where(F.col("extends") != "")
            .select(PID, F.col("class_name").alias("src"), F.col("extends").alias("dst")))


def _implements_candidates(classes: DataFrame) -> DataFrame:
    return classes.select(PID, F.col("class_name").alias("src"),
                          F.explode(F.array_distinct("implements")).alias("dst"))


def import_edges(classes: DataFrame) -> DataFrame:
    """Class -> imported class (last import segment is a known class)."""
    return _resolve(_import_candidates(classes), classes)


def extends_edges(classes: DataFrame) -> DataFrame:
    """D3: class -> parent class."""
    return _resolve(_extends_candidates(classes), classes)


def implements_edges(classes: DataFrame) -> DataFrame:
    """Class -> implemented interface."""
    return _resolve(_implements_candidates(classes), classes)


def edges(classes: DataFrame) -> DataFrame:
    """Distinct (project_id, src, dst) over imports, extends and implements.

    All three candidate kinds come out of one explode over one pass of the
    class table.
    """
    targets = F.array_distinct(F.concat(
        F.transform("imports", last_segment),
        F.when(F.col("extends") != "", F.array("extends")).otherwise(F.array().cast("array<string>")),
        F.col("implements")))
    cands = classes.select(PID, F.col("class_name").alias("src"), F.explode(targets).alias("dst"))
    return _resolve(cands, classes)


def adjacency(edge_df: DataFrame, reverse: bool = False) -> DataFrame:
    """Class -> its dependencies (or dependents when reverse), in long form.

    One row per (class, neighbour) plus the class's degree. The reverse
    adjacency is a projection of the edge table, not a copy, and no
    neighbour list is ever collected into one row (a hub class can have a
    third of all classes as dependents).
    """
    key, val = ("dst", "src") if reverse else ("src", "dst")
    deg = edge_df.groupBy(PID, key).agg(F.count(F.lit(1)).alias("degree"))
    return (edge_df.select(PID, key, val).join(deg, [PID, key])
            .select(PID, F.col(key).alias("class_name"), F.col(val).alias("neighbour"), "degree"))


def package_dependencies(classes: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(package -> other package) through imports of known classes only."""
    index = class_index(classes) if index is None else index
    targets = F.array_distinct(F.transform("imports", last_segment))
    cands = classes.select(PID, "package", F.explode(targets).alias("class_name")).distinct()
    idx = index.withColumnRenamed("package", "dep_package")
    return (cands.join(idx, [PID, "class_name"])
            .where(F.col("dep_package") != F.col("package"))
            .select(PID, "package", "dep_package").distinct())


def total_dependencies(edge_df: DataFrame) -> DataFrame:
    """Number of distinct edges per project."""
    return edge_df.groupBy(PID).agg(F.count(F.lit(1)).alias("total_dependencies"))


def row_weights(classes: DataFrame) -> DataFrame:
    """Class rows folded to (project_id, package, class_name, n)."""
    return classes.groupBy(PID, "package", "class_name").agg(F.count(F.lit(1)).alias("n"))


def package_cohesion(classes: DataFrame, edge_df: DataFrame) -> DataFrame:
    """Internal / (internal + external) edges per package, counted per class row.

    An edge is internal when its target name has a row in the same package.
    1.0 for packages with at most one class row or without edges.
    """
    w = row_weights(classes)
    rows = w.groupBy(PID, "package").agg(F.sum("n").alias("class_rows"))
    out = (w.join(edge_df.withColumnRenamed("src", "class_name"), [PID, "class_name"])
           .select(PID, "package", "dst", "n"))
    members = w.select(PID, "package", F.col("class_name").alias("dst"), F.lit(True).alias("member"))
    counted = (out.join(members, [PID, "package", "dst"], "left")
               .groupBy(PID, "package")
               .agg(F.sum(F.when(F.col("member"), F.col("n")).otherwise(0)).alias("internal_deps"),
                    F.sum("n").alias("total_deps")))
    j = rows.join(counted, [PID, "package"], "left")
    internal = F.coalesce(F.col("internal_deps"), F.lit(0)).cast("long")
    total = F.coalesce(F.col("total_deps"), F.lit(0)).cast("long")
    cohesion = (F.when(F.col("class_rows") <= 1, F.lit(1.0))
                .when(total == 0, F.lit(1.0))
                .otherwise(internal.cast("double") / total.cast("double")))
    return j.select(PID, "package", F.col("class_rows").cast("long").alias("class_rows"),
                    internal.alias("internal_deps"), (total - internal).alias("external_deps"),
                    cohesion.alias("cohesion"))


def _coupling(classes: DataFrame, edge_df: DataFrame, index: DataFrame,
              own: str, other: str, name: str) -> DataFrame:
    w = row_weights(classes)
    idx = index.select(PID, F.col("class_name").alias(other), F.col("package").alias("other_package"))
    e = edge_df.select(PID, F.col(own).alias("class_name"), F.col(other).alias(other))
    return (w.join(e, [PID, "class_name"])
            .join(idx, [PID, other])
            .where(F.col("other_package") != F.col("package"))
            .groupBy(PID, "package").agg(F.sum("n").cast("long").alias(name)))


def efferent_coupling(classes: DataFrame, edge_df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Ce, outgoing edges to classes indexed in another package (per class row)."""
    index = class_index(classes) if index is None else index
    return _coupling(classes, edge_df, index, "src", "dst", "efferent")


def afferent_coupling(classes: DataFrame, edge_df: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Ca, incoming edges from classes indexed in another package (per class row)."""
    index = class_index(classes) if index is None else index
    return _coupling(classes, edge_df, index, "dst", "src", "afferent")


def dependency_summary(classes: DataFrame, edge_df: DataFrame | None = None,
                       cyclic: DataFrame | None = None) -> DataFrame:
    """One row per project summarising the dependency analysis."""
    edge_df = edges(classes) if edge_df is None else edge_df
    index = class_index(classes)
    coh = package_cohesion(classes, edge_df)
    ce = efferent_coupling(classes, edge_df, index)
    ca = afferent_coupling(classes, edge_df, index)
    pdeps = package_dependencies(classes, index)
    projects = classes.select(PID).distinct()
    e_stats = edge_df.groupBy(PID).agg(
        F.count(F.lit(1)).alias("total_dependencies"),
        F.count_distinct("src").alias("dependent_classes"),
        F.count_distinct("dst").alias("depended_classes"))
    c_stats = coh.groupBy(PID).agg(
        F.count(F.lit(1)).alias("packages"),
        F.min("cohesion").alias("min_cohesion"),
        F.max("cohesion").alias("max_cohesion"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("package", "cohesion"))))
        .alias("package_cohesion"))
    ce_stats = ce.groupBy(PID).agg(
        F.sum("efferent").alias("efferent_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("package", "efferent"))))
        .alias("efferent_coupling"))
    ca_stats = ca.groupBy(PID).agg(
        F.sum("afferent").alias("afferent_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("package", "afferent"))))
        .alias("afferent_coupling"))
    pd_stats = pdeps.groupBy(PID).agg(F.count(F.lit(1)).alias("package_dependencies"))
    out = projects
    for t in (e_stats, c_stats, ce_stats, ca_stats, pd_stats):
        out = out.join(t, PID, "left")
    if cyclic is not None:
        cyc = cyclic.groupBy(PID).agg(F.count(F.lit(1)).alias("cyclic_classes"))
        out = out.join(cyc, PID, "left")
        out = out.withColumn("has_cycle", F.coalesce(F.col("cyclic_classes"), F.lit(0)) > 0)
        out = out.withColumn("cyclic_classes", F.coalesce(F.col("cyclic_classes"), F.lit(0)).cast("long"))
    zero = F.lit(0).cast("long")
    return (out.fillna(0, ["total_dependencies", "dependent_classes", "depended_classes",
                           "efferent_total", "afferent_total", "package_dependencies"])
            .withColumn("total_dependencies", F.col("total_dependencies").cast("long"))
            .withColumn("efferent_total", F.coalesce(F.col("efferent_total"), zero).cast("long"))
            .withColumn("afferent_total", F.coalesce(F.col("afferent_total"), zero).cast("long")))
