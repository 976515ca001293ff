"""Misplacement detection, suggestions and the result table.

All joins are equi-joins on (project_id, class_name). The side tables
(dependency flags, embedding scores, suggestions) hold one row per name, so a
hot name only skews the class-row side; AQE's skew-join split handles that,
and AQE turns a join into a broadcast only after measuring the side's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from . import rules as RU
from .graph import order_key
from .vectors import nearest_type

PID = "project_id"
D = RU.D


def dependency_scores(edge_df: DataFrame) -> DataFrame:
    """1.0 for every class with at least one outgoing edge."""
    return edge_df.select(PID, F.col("src").alias("class_name")).distinct().withColumn("dep_score", D(1.0))


def embedding_scores(class_vec: DataFrame, types) -> DataFrame:
    """Best package-type cosine of the class vector."""
    return nearest_type(class_vec, types).select(PID, "class_name", "emb_score")


def scored_rows(classes: DataFrame, edge_df: DataFrame | None, emb: DataFrame | None) -> DataFrame:
    """R2-R10 per class row: rule, embedding and dependency scores, total, types."""
    # the package's type before the joins, so that they don't carry the package for it
    rows = RU.with_rule_scores(classes).withColumn("current_type", RU.package_type(F.col("package")))
    if edge_df is not None:
        rows = rows.join(dependency_scores(edge_df), [PID, "class_name"], "left")
        dep = F.coalesce(F.col("dep_score"), D(0.0))
    else:
        dep = D(0.0)
    if emb is not None:
        rows = rows.join(emb, [PID, "class_name"], "left")
        es = F.coalesce(F.col("emb_score"), D(0.0))
    else:
        es = D(0.0)
    total = F.col("rule_score") * D(C.RULE_MIX) + es * D(C.EMBEDDING_MIX) + dep * D(C.DEPENDENCY_MIX)
    return rows.select(
        *[c for c in rows.columns if c not in ("dep_score", "emb_score", "current_type")],
        es.alias("embedding_score"), dep.alias("dependency_score"), total.alias("total_score"), "current_type")


def flag_expr() -> Column:
    """R11 (row level): total above the threshold and a different suggested type."""
    return ((F.col("total_score") > D(C.MISPLACED_THRESHOLD))
            & (F.col("current_type") != F.col("rule_type")))


def flagged_rows(scored: DataFrame) -> DataFrame:
    return scored.where(flag_expr())


def misplaced_names(scored: DataFrame) -> DataFrame:
    """Distinct (project_id, class_name) flagged by at least one of its rows."""
    return flagged_rows(scored).select(PID, "class_name").distinct()


LAST_SCORES, LAST_ARRAYS = ["rule_score", "rule_type", "rule_ord"], ["methods", "annotations"]


def name_summary(scored: DataFrame) -> DataFrame:
    """Per name, in one aggregation: flagged by any row, and scores and arrays of the last row.

    The rows are already dealt by name for the score joins, so this is no further shuffle. Scores and arrays
    are two aggregates: Spark drops the second, and the arrays from the shuffle, where no text is asked for.
    """
    agg = (scored.groupBy(PID, "class_name")
           .agg(F.max(flag_expr()).alias("flagged"),
                *[F.max_by(F.struct(*cols), order_key()).alias(at) for at, cols in (("s", LAST_SCORES), ("a", LAST_ARRAYS))]))
    return agg.select(PID, "class_name", "flagged", *[F.col(at)[c].alias(c) for at, cols in (("s", LAST_SCORES), ("a", LAST_ARRAYS)) for c in cols])


def _matching_methods(methods: Column, ord_col: Column, scanned: int) -> Column:
    rm = RU.rule_list("methods", ord_col)
    return F.filter(F.slice(methods, 1, scanned),
                    lambda m: F.exists(rm, lambda r: F.instr(F.lower(m), r) > 0))


def reasoning(name: Column, methods: Column, annotations: Column, s: Column, o: Column) -> Column:
    """Name reason; annotation reason (looks up lower-cased names, as specified);
    methods reason over the first 5 methods showing 3; fallback text."""
    r_name = F.when(F.instr(F.lower(name), s) > 0,
                    F.concat(F.lit("Class name '"), name, F.lit("' suggests "), s, F.lit(" functionality")))
    rel_ann = F.filter(annotations, lambda a: F.array_contains(RU.rule_list("annotations", o), F.lower(a)))
    r_ann = F.when(F.size(rel_ann) > 0, F.concat(F.lit("Contains "), s, F.lit("-specific annotations: "),
                                                 F.array_join(rel_ann, ", ")))
    rel_m = _matching_methods(methods, o, C.REASON_METHODS_SCANNED)
    r_m = F.when(F.size(rel_m) > 0, F.concat(F.lit("Contains "), s, F.lit("-typical methods: "),
                                             F.array_join(F.slice(rel_m, 1, C.METHODS_SHOWN), ", ")))
    joined = F.concat_ws("; ", r_name, r_ann, r_m)
    return F.when(joined != "", joined).otherwise(
        F.concat(F.lit("Semantic analysis suggests better fit in "), s, F.lit(" package")))


def evidence(name: Column, methods: Column, annotations: Column, s: Column, o: Column) -> Column:
    """Pattern hit (once); all matching annotations; methods (first 10, show 3); fallback."""
    lname = F.lower(name)
    e_pat = F.when(F.exists(RU.pattern_suffixes(o), lambda p: F.endswith(lname, p)),
                   F.concat(F.lit("Name matches "), s, F.lit(" pattern")))
    anns = F.filter(annotations, lambda a: F.array_contains(RU.rule_list("annotations", o), a))
    e_ann = F.when(F.size(anns) > 0, F.concat(F.lit("Annotations: "), F.array_join(anns, ", ")))
    mm = _matching_methods(methods, o, C.EVIDENCE_METHODS_SCANNED)
    e_m = F.when(F.size(mm) > 0, F.concat(F.lit("Methods: "),
                                          F.array_join(F.slice(mm, 1, C.METHODS_SHOWN), ", ")))
    joined = F.concat_ws("; ", e_pat, e_ann, e_m)
    return F.when(joined != "", joined).otherwise(F.lit(C.EVIDENCE_FALLBACK))


def suggestions(scored: DataFrame) -> DataFrame:
    """One suggestion per misplaced name, from the last row of that name."""
    last = name_summary(scored).where(F.col("flagged"))
    s, o = F.col("rule_type"), F.col("rule_ord")
    return last.select(
        PID, "class_name",
        s.alias("suggested_package"),
        F.least(F.col("rule_score"), D(C.CONFIDENCE_CAP)).alias("confidence"),
        reasoning(F.col("class_name"), F.col("methods"), F.col("annotations"), s, o).alias("reasoning"),
        evidence(F.col("class_name"), F.col("methods"), F.col("annotations"), s, o).alias("evidence"),
        F.lit(C.METHOD_USED_SUGGESTION).alias("method_used"))


RESULT_COLUMNS = ["project_id", "relative_path", "class_pos", "class_id", "class_name",
                  "current_package", "is_misplaced", "confidence", "reasoning",
                  "suggested_package", "evidence", "method_used"]


def assemble_results(classes: DataFrame, sugg: DataFrame) -> DataFrame:
    """O1: every class row with its name's suggestion, or the fixed defaults."""
    s = sugg.select(PID, "class_name", F.lit(True).alias("_hit"),
                    *[F.col(c).alias("_s_" + c) for c in
                      ("confidence", "reasoning", "suggested_package", "evidence", "method_used")])
    j = classes.select(PID, "relative_path", "class_pos", "class_name", "package").join(
        s, [PID, "class_name"], "left")
    hit = F.col("_hit").isNotNull()
    return j.select(
        PID, "relative_path", "class_pos",
        F.col("class_name").alias("class_id"), "class_name",
        F.col("package").alias("current_package"),
        hit.alias("is_misplaced"),
        F.when(hit, F.col("_s_confidence")).otherwise(D(C.DEFAULT_CONFIDENCE)).alias("confidence"),
        F.when(hit, F.col("_s_reasoning")).otherwise(F.lit(C.DEFAULT_REASONING)).alias("reasoning"),
        F.when(hit, F.col("_s_suggested_package")).otherwise(F.col("package")).alias("suggested_package"),
        F.when(hit, F.col("_s_evidence")).otherwise(F.lit(C.DEFAULT_EVIDENCE)).alias("evidence"),
        F.when(hit, F.col("_s_method_used")).otherwise(F.lit(C.METHOD_USED_DEFAULT)).alias("method_used"),
    )


def with_run_metadata(results: DataFrame, analysis_time: float, timestamp: str | None = None) -> DataFrame:
    """O2: analysis_time (rounded to 2) and an ISO timestamp on every row."""
    ts = (F.lit(timestamp) if timestamp is not None
          else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return results.select("*", F.lit(round(float(analysis_time), 2)).alias("analysis_time"),
                          ts.alias("analysis_timestamp"))


def apply_confidence_threshold(results: DataFrame, threshold: float) -> DataFrame:
    """O3: above the default 0.6, rows with confidence below the threshold are un-flagged."""
    if threshold <= C.CLI_CONFIDENCE_DEFAULT:
        return results
    return results.withColumn(
        "is_misplaced", F.col("is_misplaced") & ~(F.col("confidence") < D(threshold)))


def limit_classes(classes: DataFrame, max_classes: int) -> DataFrame:
    """The first N class rows of every project in row order.

    ``row_number() <= N`` lets Spark insert a partial per-group limit before
    the shuffle (WindowGroupLimit), so a huge project sends at most N rows
    per map task to the window.
    """
    w = Window.partitionBy(PID).orderBy("relative_path", "class_pos")
    return classes.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max_classes).drop("_rn")


def top_recommendations(results: DataFrame, n: int = C.TOP_RECOMMENDATIONS,
                        reason_chars: int = C.TOP_REASON_CHARS) -> DataFrame:
    """Per project, the n misplaced rows of highest confidence (ties: name, row order)."""
    w = Window.partitionBy(PID).orderBy(F.col("confidence").desc(), "class_name", "relative_path", "class_pos")
    return (results.where("is_misplaced").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .select(PID, F.col("rank").cast("int").alias("rank"), "class_name", "current_package",
                    "suggested_package", "confidence",
                    F.substring("reasoning", 1, reason_chars).alias("reason")))


def first_misplaced(results: DataFrame, n: int = C.TOP_RECOMMENDATIONS,
                    reason_chars: int = C.FIRST_MISPLACED_REASON_CHARS) -> DataFrame:
    """Per project, the first n misplaced rows in row order."""
    w = Window.partitionBy(PID).orderBy("relative_path", "class_pos")
    return (results.where("is_misplaced").withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .select(PID, F.col("rank").cast("int").alias("rank"), "class_name", "current_package",
                    "suggested_package", "confidence",
                    F.substring("reasoning", 1, reason_chars).alias("reason")))


def summary_counts(results: DataFrame) -> DataFrame:
    """Total rows, misplaced rows and their rate per project."""
    g = results.groupBy(PID).agg(F.count(F.lit(1)).alias("total_classes"),
                                 F.count_if(F.col("is_misplaced")).alias("misplaced_classes"))
    return g.withColumn("misplacement_rate",
                        F.col("misplaced_classes").cast("double") / F.col("total_classes").cast("double"))
