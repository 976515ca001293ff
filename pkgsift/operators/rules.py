"""Rule scoring (R1-R6, R10) and the quick demo classifier.

Scores for the seven package types are seven columns of one projection,
generated from the rules table: no join, no row blow-up. Each score is a
left-to-right double sum in the order patterns, keywords, methods,
annotations, so ties and near-ties come out exactly as in sequential Python.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.text import str_array

D = lambda x: F.lit(float(x)).cast("double")


def rules_table(spark: SparkSession) -> DataFrame:
    """The placement rules as a 7-row table (type order = tie order)."""
    rows = [(t, i, r["keywords"], r["patterns"], r["methods"], r["annotations"])
            for i, (t, r) in enumerate(C.PLACEMENT_RULES)]
    return spark.createDataFrame(
        rows, "package_type string, type_ord int, keywords array<string>, patterns array<string>, "
              "methods array<string>, annotations array<string>")


def _any_contains(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def pattern_part(lname: Column, rules: dict, start: Column | None = None) -> Column:
    """R2: +0.4 per matching name suffix pattern (duplicates count)."""
    score = D(0.0) if start is None else start
    for p in rules["patterns"]:
        score = score + F.when(F.endswith(lname, F.lit(C.pattern_suffix(p))), D(C.PATTERN_WEIGHT)).otherwise(D(0.0))
    return score


def keyword_part(lname: Column, rules: dict, start: Column | None = None) -> Column:
    """+0.2 per keyword contained in the lower-cased name."""
    score = D(0.0) if start is None else start
    for k in rules["keywords"]:
        score = score + F.when(F.contains(lname, F.lit(k)), D(C.KEYWORD_WEIGHT)).otherwise(D(0.0))
    return score


def method_part(methods: Column, rules: dict) -> Column:
    """min(0.1 x methods containing a rule method, 0.3); methods are lower-cased."""
    return lowered_method_part(F.transform(methods, F.lower), rules)


def lowered_method_part(lmethods: Column, rules: dict) -> Column:
    """R4 for methods in lower case."""
    n = F.size(F.filter(lmethods, lambda m: _any_contains(m, rules["methods"])))
    return F.least(n.cast("double") * D(C.METHOD_WEIGHT), D(C.METHOD_CAP))


def annotation_part(annotations: Column, rules: dict) -> Column:
    """min(0.15 x annotations in the rule list (case-sensitive), 0.3)."""
    n = F.size(F.filter(annotations, lambda a: a.isin(*rules["annotations"])))
    return F.least(n.cast("double") * D(C.ANNOTATION_WEIGHT), D(C.ANNOTATION_CAP))


def type_score(lname: Column, lmethods: Column, annotations: Column, rules: dict) -> Column:
    """R2-R5 for one type as one left-to-right sum, capped at 1.0; name and methods in lower case."""
    score = keyword_part(lname, rules, pattern_part(lname, rules))
    score = score + lowered_method_part(lmethods, rules)
    score = score + annotation_part(annotations, rules)
    return F.least(score, D(C.RULE_CAP))


def score_columns(df: DataFrame, prefix: str = "score_") -> DataFrame:
    """Adds one score column per type (score_model, score_service, ...)."""
    # lower case once for all types
    rows = df.select("*", F.lower("class_name").alias("_lname"), F.transform("methods", F.lower).alias("_lmethods"))
    cols = [type_score(F.col("_lname"), F.col("_lmethods"), F.col("annotations"), r)
            .alias(prefix + t) for t, r in C.PLACEMENT_RULES]
    return rows.select("*", *cols).drop("_lname", "_lmethods")


def best_type(prefix: str = "score_") -> Column:
    """struct(score, neg_ord, type) of the best type; ties go to the earlier type."""
    return F.greatest(*[F.struct(F.col(prefix + t).alias("score"), F.lit(-i).alias("neg_ord"),
                                 F.lit(t).alias("type"))
                        for i, (t, _) in enumerate(C.PLACEMENT_RULES)])


def with_rule_scores(classes: DataFrame, keep_type_scores: bool = False) -> DataFrame:
    """Adds rule_score, rule_type, rule_ord (R2-R6) to every class row."""
    scored = score_columns(classes)
    b = best_type()
    out = scored.select("*", b["score"].alias("rule_score"), b["type"].alias("rule_type"),
                        (-b["neg_ord"]).alias("rule_ord"))
    if not keep_type_scores:
        out = out.drop(*["score_" + t for t in C.TYPE_NAMES])
    return out


def package_type(package: Column) -> Column:
    """First type name contained in the lower-cased package, else 'unknown'."""
    lp = F.lower(package)
    expr = F.lit(C.UNKNOWN_TYPE)
    for t in reversed(C.TYPE_NAMES):
        expr = F.when(F.contains(lp, F.lit(t)), F.lit(t)).otherwise(expr)
    return expr


def rule_list(kind: str, ord_col: Column) -> Column:
    """The rule list ``kind`` of the type with ordinal ``ord_col``."""
    arrays = F.array(*[str_array(r[kind]) for _, r in C.PLACEMENT_RULES])
    return F.element_at(arrays, (ord_col + F.lit(1)).cast("int"))


def pattern_suffixes(ord_col: Column) -> Column:
    arrays = F.array(*[str_array([C.pattern_suffix(p) for p in r["patterns"]])
                       for _, r in C.PLACEMENT_RULES])
    return F.element_at(arrays, (ord_col + F.lit(1)).cast("int"))


def quick_classify(classes: DataFrame) -> DataFrame:
    """The four-branch demo rule (name / annotations / methods)."""
    name, ann, pkg = F.col("class_name"), F.col("annotations"), F.col("package")
    ctrl = (F.instr(name, F.lit("Controller")) > 0) & F.array_contains(ann, "RestController")
    svc = (F.instr(name, F.lit("Generator")) > 0) | F.exists("methods", lambda m: F.instr(m, F.lit("export")) > 0)
    ent = F.array_contains(ann, "Entity")
    in_model = F.instr(pkg, F.lit("model")) > 0
    c1, c2, c3, c4 = C.DEMO_CONFIDENCES
    return classes.select(
        "project_id", "relative_path", "class_pos", "class_name", "package",
        F.when(ctrl | svc, in_model).otherwise(F.lit(False)).alias("is_misplaced"),
        F.when(ctrl, F.lit(C.DEMO_CONTROLLER_PACKAGE)).when(svc, F.lit(C.DEMO_SERVICE_PACKAGE))
        .otherwise(pkg).alias("suggested_package"),
        F.when(ctrl, D(c1)).when(svc, D(c2)).when(ent, D(c3)).otherwise(D(c4)).alias("confidence"),
        F.when(ctrl, F.lit(C.DEMO_CONTROLLER_REASON)).when(svc, F.lit(C.DEMO_SERVICE_REASON))
        .when(ent, F.lit(C.DEMO_ENTITY_REASON)).otherwise(F.lit(C.DEMO_DEFAULT_REASON)).alias("reasoning"),
    )
