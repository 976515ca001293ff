"""Result metrics (P1-P12), one row (or one row per key) per project.

Every metric is a grouped aggregation with map-side partial aggregation;
ranking steps (P6, P11) run on already aggregated per-package rows, so a
huge project never sends its class rows to one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import word_count

PID = "project_id"
ROUND = 9  # aggregated doubles are rounded: summation order differs between engines


def _mis():
    return F.col("is_misplaced")


def _d(x):
    return F.lit(float(x)).cast("double")


def _rate(num, den):
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(_d(0.0))


def overview(results: DataFrame) -> DataFrame:
    """Totals, misplacement rate and 'accuracy' (correct / total)."""
    g = results.groupBy(PID).agg(F.count(F.lit(1)).alias("total_classes_analyzed"),
                                 F.count_if(_mis()).alias("misplaced_classes_found"))
    correct = F.col("total_classes_analyzed") - F.col("misplaced_classes_found")
    return g.select(PID, "total_classes_analyzed", "misplaced_classes_found",
                    correct.alias("correctly_placed_classes"),
                    _rate(F.col("misplaced_classes_found"), F.col("total_classes_analyzed")).alias("misplacement_rate"),
                    _rate(correct, F.col("total_classes_analyzed")).alias("accuracy_rate"))


def confidence_stats(results: DataFrame) -> DataFrame:
    """Mean / min / max / sample std of misplaced confidences (projects with any)."""
    m = results.where(_mis())
    return m.groupBy(PID).agg(
        F.round(F.avg("confidence"), ROUND).alias("average_confidence"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        F.round(F.stddev_samp("confidence"), ROUND).alias("confidence_std"))


def package_distribution(results: DataFrame) -> DataFrame:
    """Class rows per current package."""
    return results.groupBy(PID, F.col("current_package").alias("package")).agg(
        F.count(F.lit(1)).alias("classes"))


def suggested_distribution(results: DataFrame) -> DataFrame:
    """Misplaced rows per suggested package."""
    return results.where(_mis()).groupBy(PID, "suggested_package").agg(F.count(F.lit(1)).alias("classes"))


def package_misplacement_rates(results: DataFrame) -> DataFrame:
    """P5: per package: total rows, misplaced rows, rate; plus the first-seen row key."""
    g = results.groupBy(PID, F.col("current_package").alias("package")).agg(
        F.count(F.lit(1)).alias("total_classes"),
        F.count_if(_mis()).alias("misplaced_classes"),
        F.min(F.struct("relative_path", "class_pos")).alias("first_seen"))
    return g.withColumn("misplacement_rate", _rate(F.col("misplaced_classes"), F.col("total_classes")))


def most_problematic_package(results: DataFrame) -> DataFrame:
    """The package with the highest rate; ties go to the package seen first."""
    rates = package_misplacement_rates(results)
    w = Window.partitionBy(PID).orderBy(F.col("misplacement_rate").desc(), F.col("first_seen"))
    return (rates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
            .select(PID, F.col("package").alias("most_problematic_package"), "misplacement_rate"))


def confidence_buckets(results: DataFrame) -> DataFrame:
    """Misplaced rows with confidence >= 0.8, in [0.6, 0.8), < 0.6 (zeros if none)."""
    c = F.col("confidence")
    return results.groupBy(PID).agg(
        F.count_if(_mis() & (c >= _d(C.HIGH_CONFIDENCE))).alias("high_confidence_suggestions"),
        F.count_if(_mis() & (c >= _d(C.MEDIUM_CONFIDENCE)) & (c < _d(C.HIGH_CONFIDENCE)))
        .alias("medium_confidence_suggestions"),
        F.count_if(_mis() & (c < _d(C.MEDIUM_CONFIDENCE))).alias("low_confidence_suggestions"))


def reasoning_score(reason) -> F.Column:
    lr = F.lower(reason)
    bonus = reduce(lambda a, b: a | b, [F.instr(lr, F.lit(k)) > 0 for k in C.REASONING_KEYWORDS])
    base = F.least(word_count(reason).cast("double") / _d(C.REASONING_WORDS_FULL), _d(1.0))
    return F.least(base + F.when(bonus, _d(C.REASONING_BONUS)).otherwise(_d(0.0)), _d(1.0))


def reasoning_quality(results: DataFrame) -> DataFrame:
    """Mean reasoning score over misplaced rows; 1.0 for a project without any."""
    g = results.groupBy(PID).agg(F.avg(F.when(_mis(), reasoning_score(F.col("reasoning")))).alias("q"))
    return g.select(PID, F.round(F.coalesce(F.col("q"), _d(1.0)), ROUND).alias("reasoning_quality_score"))


def time_stats(results: DataFrame) -> DataFrame:
    """Mean analysis time, the first row's time, mean / rows."""
    g = results.groupBy(PID).agg(
        F.avg("analysis_time").alias("average_analysis_time"),
        F.min_by("analysis_time", F.struct("relative_path", "class_pos")).alias("total_analysis_time"),
        F.count(F.lit(1)).alias("_n"))
    return g.select(PID, F.round("average_analysis_time", ROUND).alias("average_analysis_time"),
                    "total_analysis_time",
                    F.round(F.col("average_analysis_time") / F.col("_n").cast("double"), ROUND)
                    .alias("analysis_time_per_class"))


def methods_used(results: DataFrame) -> DataFrame:
    """P10: rows per method_used."""
    return results.groupBy(PID, "method_used").agg(F.count(F.lit(1)).alias("rows"))


def top_packages(results: DataFrame, n: int = C.TOP_PACKAGES) -> DataFrame:
    """The n largest packages by rows; ties go to the package seen first."""
    g = results.groupBy(PID, F.col("current_package").alias("package")).agg(
        F.count(F.lit(1)).alias("classes"), F.min(F.struct("relative_path", "class_pos")).alias("first_seen"))
    w = Window.partitionBy(PID).orderBy(F.col("classes").desc(), F.col("first_seen"))
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(PID, F.col("rank").cast("int").alias("rank"), "package", "classes"))


def _count_map(df: DataFrame, key: str, val: str, name: str) -> DataFrame:
    return df.groupBy(PID).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), F.col(val))))).alias(name))


def project_scalars(results: DataFrame) -> DataFrame:
    """P1, P2, P7, P8 (and P9 when timed) in one grouped aggregation."""
    mis, c = _mis(), F.col("confidence")
    mc = F.when(mis, c)
    aggs = [F.count(F.lit(1)).alias("total_classes_analyzed"),
            F.count_if(mis).alias("misplaced_classes_found"),
            F.round(F.avg(mc), ROUND).alias("average_confidence"),
            F.min(mc).alias("min_confidence"), F.max(mc).alias("max_confidence"),
            F.round(F.stddev_samp(mc), ROUND).alias("confidence_std"),
            F.count_if(mis & (c >= _d(C.HIGH_CONFIDENCE))).alias("high_confidence_suggestions"),
            F.count_if(mis & (c >= _d(C.MEDIUM_CONFIDENCE)) & (c < _d(C.HIGH_CONFIDENCE)))
            .alias("medium_confidence_suggestions"),
            F.count_if(mis & (c < _d(C.MEDIUM_CONFIDENCE))).alias("low_confidence_suggestions"),
            F.avg(F.when(mis, reasoning_score(F.col("reasoning")))).alias("_q")]
    timed = "analysis_time" in results.columns
    if timed:
        aggs += [F.avg("analysis_time").alias("_avg_t"),
                 F.min_by("analysis_time", F.struct("relative_path", "class_pos")).alias("total_analysis_time")]
    g = results.groupBy(PID).agg(*aggs)
    tot, mis_n = F.col("total_classes_analyzed"), F.col("misplaced_classes_found")
    cols = [PID, "total_classes_analyzed", "misplaced_classes_found",
            (tot - mis_n).alias("correctly_placed_classes"),
            _rate(mis_n, tot).alias("misplacement_rate"), _rate(tot - mis_n, tot).alias("accuracy_rate"),
            "average_confidence", "min_confidence", "max_confidence", "confidence_std",
            "high_confidence_suggestions", "medium_confidence_suggestions", "low_confidence_suggestions",
            F.round(F.coalesce(F.col("_q"), _d(1.0)), ROUND).alias("reasoning_quality_score")]
    if timed:
        cols += [F.round("_avg_t", ROUND).alias("average_analysis_time"), "total_analysis_time",
                 F.round(F.col("_avg_t") / tot.cast("double"), ROUND).alias("analysis_time_per_class")]
    return g.select(*cols)


def full_metrics(results: DataFrame) -> DataFrame:
    """One row per project with every metric; distributions as maps.

    Four grouped aggregations in total: per project (scalars), per package
    (distribution + rates -> most problematic), per suggested package, per
    method. Materialise ``results`` first when it is an expensive plan.
    """
    rates = package_misplacement_rates(results)
    w = Window.partitionBy(PID).orderBy(F.col("misplacement_rate").desc(), F.col("first_seen"))
    worst = (rates.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
             .select(PID, F.col("package").alias("most_problematic_package")))
    out = project_scalars(results)
    for part in (_count_map(rates, "package", "total_classes", "package_distribution"),
                 _count_map(suggested_distribution(results), "suggested_package", "classes",
                            "suggested_package_distribution"),
                 worst,
                 _count_map(methods_used(results), "method_used", "rows", "analysis_methods_used")):
        out = out.join(part, PID, "left")
    return out.withColumn("suggested_package_distribution",
                          F.coalesce("suggested_package_distribution",
                                     F.create_map().cast("map<string,bigint>")))


def map_text(col) -> F.Column:
    """'k1=v1,k2=v2' in key order (for comparing map columns as text)."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
