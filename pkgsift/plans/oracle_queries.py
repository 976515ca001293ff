"""Oracle SQL per registered query id (DuckDB dialect)."""

from __future__ import annotations

from .oracle import BASE, EVIDENCE_PATHS, GRAPH, REACH, with_ctes

SQL: dict[str, str] = {}


def sql(name: str, body: str, *extra: str) -> None:
    SQL[name] = with_ctes(*BASE, *extra, body=body)


FK = "project_id, relative_path"
RK = "project_id, relative_path, class_pos"


def _j(c: str) -> str:
    return f"array_to_string({c}, '|')"


# ------------------------------------------------------------------ E
sql("E1", f"SELECT {FK}, package FROM files")
sql("E2", f"SELECT {FK}, {_j('imports')} AS imports, CAST(len(imports) AS INTEGER) AS n_imports FROM files")
sql("E3", f"SELECT {RK}, class_name FROM classes")
sql("E4", f"SELECT {FK}, {_j('methods')} AS methods, CAST(len(methods) AS INTEGER) AS n_methods FROM files")
sql("E5", f"SELECT {FK}, {_j('fields')} AS fields, CAST(len(fields) AS INTEGER) AS n_fields FROM files")
sql("E6", f"SELECT {FK}, {_j('annotations')} AS annotations, "
          f"CAST(len(annotations) AS INTEGER) AS n_annotations FROM files")
sql("E7", f"SELECT {FK}, extends FROM files")
sql("E8", f"SELECT {FK}, {_j('implements')} AS implements, "
          f"CAST(len(implements) AS INTEGER) AS n_implements FROM files")
sql("E9", f"SELECT {RK}, class_name, class_type FROM classes")
sql("E10", f"SELECT {FK}, content_preview FROM files")
sql("E11", f"SELECT {RK}, class_name, package, file_path, {_j('imports')} AS imports, "
           f"{_j('methods')} AS methods, {_j('fields')} AS fields, {_j('annotations')} AS annotations, "
           f"extends, {_j('implements')} AS implements, class_type, content_preview FROM classes")


# ------------------------------------------------------------------ D
def gsql(name: str, body: str, *extra: str) -> None:
    sql(name, body, GRAPH, *extra)


gsql("D1", "SELECT project_id, class_name, package FROM class_index")
gsql("D2", "SELECT project_id, src, dst FROM imp_edges")
gsql("D3", "SELECT project_id, src, dst FROM ext_edges")
gsql("D4", "SELECT project_id, src, dst FROM impl_edges")
gsql("D5", "SELECT project_id, src, dst FROM edges")
gsql("D6", """
SELECT project_id, src AS class_name, dst AS neighbour,
       count(*) OVER (PARTITION BY project_id, src) AS degree, 'dependencies' AS direction
FROM edges
UNION ALL
SELECT project_id, dst AS class_name, src AS neighbour,
       count(*) OVER (PARTITION BY project_id, dst) AS degree, 'dependents' AS direction
FROM edges""")
gsql("D7", """
SELECT DISTINCT i.project_id, i.package, x.package AS dep_package
FROM imp_raw i JOIN class_index x ON x.project_id = i.project_id AND x.class_name = i.dst
WHERE x.package <> i.package""")
gsql("D8", "SELECT project_id, count(*) AS total_dependencies FROM edges GROUP BY project_id")

COHESION = """
pkg_rows AS (SELECT project_id, package, count(*) AS class_rows FROM classes GROUP BY ALL),
dep_uses AS (
  SELECT c.project_id, c.package, e.dst,
         EXISTS (SELECT 1 FROM classes m WHERE m.project_id = c.project_id
                 AND m.package = c.package AND m.class_name = e.dst) AS internal
  FROM classes c JOIN edges e ON e.project_id = c.project_id AND e.src = c.class_name
),
dep_counts AS (
  SELECT project_id, package, count(*) FILTER (WHERE internal) AS internal_deps, count(*) AS total_deps
  FROM dep_uses GROUP BY ALL
),
cohesion AS (
  SELECT r.project_id, r.package, CAST(r.class_rows AS BIGINT) AS class_rows,
         CAST(coalesce(d.internal_deps, 0) AS BIGINT) AS internal_deps,
         CAST(coalesce(d.total_deps, 0) - coalesce(d.internal_deps, 0) AS BIGINT) AS external_deps,
         CASE WHEN r.class_rows <= 1 THEN 1.0::DOUBLE
              WHEN coalesce(d.total_deps, 0) = 0 THEN 1.0::DOUBLE
              ELSE CAST(d.internal_deps AS DOUBLE) / CAST(d.total_deps AS DOUBLE) END AS cohesion
  FROM pkg_rows r LEFT JOIN dep_counts d USING (project_id, package)
),
efferent AS (
  SELECT c.project_id, c.package, count(*) AS efferent
  FROM classes c JOIN edges e ON e.project_id = c.project_id AND e.src = c.class_name
  JOIN class_index x ON x.project_id = e.project_id AND x.class_name = e.dst
  WHERE x.package <> c.package GROUP BY ALL
),
afferent AS (
  SELECT c.project_id, c.package, count(*) AS afferent
  FROM classes c JOIN edges e ON e.project_id = c.project_id AND e.dst = c.class_name
  JOIN class_index x ON x.project_id = e.project_id AND x.class_name = e.src
  WHERE x.package <> c.package GROUP BY ALL
),
pkg_deps AS (
  SELECT DISTINCT i.project_id, i.package, x.package AS dep_package
  FROM imp_raw i JOIN class_index x ON x.project_id = i.project_id AND x.class_name = i.dst
  WHERE x.package <> i.package
),
dep_summary AS (
  SELECT p.project_id,
    CAST(coalesce((SELECT count(*) FROM edges e WHERE e.project_id = p.project_id), 0) AS BIGINT) AS total_dependencies,
    CAST(coalesce((SELECT count(DISTINCT src) FROM edges e WHERE e.project_id = p.project_id), 0) AS BIGINT) AS dependent_classes,
    CAST(coalesce((SELECT count(DISTINCT dst) FROM edges e WHERE e.project_id = p.project_id), 0) AS BIGINT) AS depended_classes,
    (SELECT count(*) FROM cohesion h WHERE h.project_id = p.project_id) AS packages,
    (SELECT min(cohesion) FROM cohesion h WHERE h.project_id = p.project_id) AS min_cohesion,
    (SELECT max(cohesion) FROM cohesion h WHERE h.project_id = p.project_id) AS max_cohesion,
    CAST(coalesce((SELECT sum(efferent) FROM efferent f WHERE f.project_id = p.project_id), 0) AS BIGINT) AS efferent_total,
    CAST(coalesce((SELECT sum(afferent) FROM afferent f WHERE f.project_id = p.project_id), 0) AS BIGINT) AS afferent_total,
    CAST(coalesce((SELECT count(*) FROM pkg_deps d WHERE d.project_id = p.project_id), 0) AS BIGINT) AS package_dependencies
  FROM (SELECT DISTINCT project_id FROM classes) p
)"""

gsql("D9", "SELECT * FROM cohesion", COHESION)
gsql("D10", "SELECT project_id, package, CAST(efferent AS BIGINT) AS efferent FROM efferent", COHESION)
gsql("D11", "SELECT project_id, package, CAST(afferent AS BIGINT) AS afferent FROM afferent", COHESION)
gsql("D13", """
SELECT d.*, coalesce(c.n, 0) > 0 AS has_cycle, CAST(coalesce(c.n, 0) AS BIGINT) AS cyclic_classes
FROM dep_summary d LEFT JOIN (SELECT project_id, count(*) AS n FROM cyclic GROUP BY ALL) c USING (project_id)""",
     COHESION, REACH)
gsql("D12", "SELECT project_id, class_name FROM cyclic", REACH)
gsql("D12_cycles", "SELECT project_id, cycle, CAST(length AS INTEGER) AS length FROM cycles", REACH)
gsql("D12_evidence", "SELECT project_id, class_name, cycle, CAST(length AS INTEGER) AS length FROM evidence", REACH, EVIDENCE_PATHS)


# ------------------------------------------------------------------ R, M, O
from ..functions import constants as C  # noqa: E402
from .oracle import (RULE_SCORES, VECTORS, _d, _list, _q, _score_sql, cosine_sql,  # noqa: E402
                     pipeline)


def psql(name: str, body: str, with_emb: bool = True, with_dep: bool = True, *extra: str) -> None:
    sql(name, body, *pipeline(with_emb, with_dep), *extra)


def _part_sql(rules: dict, kind: str) -> str:
    if kind == "pattern":
        s = "0.0::DOUBLE"
        for p in rules["patterns"]:
            s = f"({s} + CASE WHEN ends_with(lower(class_name), {_q(C.pattern_suffix(p))}) THEN {_d(C.PATTERN_WEIGHT)} ELSE 0.0::DOUBLE END)"
        return s
    if kind == "keyword":
        s = "0.0::DOUBLE"
        for k in rules["keywords"]:
            s = f"({s} + CASE WHEN contains(lower(class_name), {_q(k)}) THEN {_d(C.KEYWORD_WEIGHT)} ELSE 0.0::DOUBLE END)"
        return s
    if kind == "method":
        meth = " OR ".join(f"contains(lower(m), {_q(r)})" for r in rules["methods"])
        return (f"least(CAST(len(list_filter(methods, lambda m: {meth})) AS DOUBLE) * {_d(C.METHOD_WEIGHT)}, "
                f"{_d(C.METHOD_CAP)})")
    return (f"least(CAST(len(list_filter(annotations, lambda a: list_contains({_list(rules['annotations'])}, a))) "
            f"AS DOUBLE) * {_d(C.ANNOTATION_WEIGHT)}, {_d(C.ANNOTATION_CAP)})")


for _rid, _kind in (("R2", "pattern"), ("R3", "keyword"), ("R4", "method"), ("R5", "annotation")):
    _cols = ", ".join(f"{_part_sql(r, _kind)} AS {_kind}_{t}" for t, r in C.PLACEMENT_RULES)
    sql(_rid, f"SELECT {RK}, class_name, {_cols} FROM classes")

_TYPE_ROWS = " UNION ALL ".join(
    f"SELECT {_q(t)} AS package_type, CAST({i} AS INTEGER) AS type_ord, "
    f"{_q('|'.join(r['keywords']))} AS keywords, {_q('|'.join(r['patterns']))} AS patterns, "
    f"{_q('|'.join(r['methods']))} AS methods, {_q('|'.join(r['annotations']))} AS annotations"
    for i, (t, r) in enumerate(C.PLACEMENT_RULES))
_LONG = " UNION ALL ".join(f"SELECT rule_type, {_q(t)} AS package_type, s_{t} AS s FROM rule_rows"
                           for t in C.TYPE_NAMES)
sql("R1", f"""
SELECT t.*, coalesce(u.rows_scored, 0) AS rows_scored, coalesce(u.rows_best, 0) AS rows_best
FROM ({_TYPE_ROWS}) t LEFT JOIN (
  SELECT package_type, count(*) FILTER (WHERE s > 0) AS rows_scored,
         count(*) FILTER (WHERE rule_type = package_type) AS rows_best
  FROM ({_LONG}) GROUP BY package_type) u USING (package_type)""", RULE_SCORES)
_SC = ", ".join(f"s_{t} AS score_{t}" for t in C.TYPE_NAMES)
sql("R6", f"SELECT {RK}, class_name, {_SC}, rule_score, rule_type FROM rule_rows", RULE_SCORES)
sql("R7", """
SELECT n.project_id, n.class_name, coalesce(e.emb_score, 0.0::DOUBLE) AS embedding_score
FROM (SELECT DISTINCT project_id, class_name FROM classes) n
LEFT JOIN emb e ON e.project_id = n.project_id AND e.class_name = n.class_name""", VECTORS)
gsql("R8", """
SELECT n.project_id, n.class_name,
       CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.project_id = n.project_id AND e.src = n.class_name)
            THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS dependency_score
FROM names n""")
sql("R10", f"SELECT {RK}, package, current_type FROM rule_rows", RULE_SCORES)
psql("R9", f"SELECT {RK}, class_name, rule_score, embedding_score, dependency_score, total_score FROM scored")
psql("R11", "SELECT project_id, class_name FROM flagged")
psql("R12", "SELECT project_id, class_name, confidence FROM sugg")
psql("R13", "SELECT project_id, class_name, reasoning FROM sugg")
psql("R14", "SELECT project_id, class_name, evidence FROM sugg")
psql("R15", "SELECT * FROM sugg")

_SEM = f"""concat_ws(' ',
  'Class name: ' || class_name,
  CASE WHEN len(methods) > 0 THEN 'Methods: ' || array_to_string(methods[1:{C.SEMANTIC_METHODS}], ' ') END,
  CASE WHEN len(fields) > 0 THEN 'Fields: ' || array_to_string(fields[1:{C.SEMANTIC_FIELDS}], ' ') END,
  CASE WHEN len(annotations) > 0 THEN 'Annotations: ' || array_to_string(annotations, ' ') END,
  'Type: ' || class_type,
  CASE WHEN content_preview <> '' THEN 'Content: ' || content_preview END)"""
sql("M1", f"SELECT {RK}, class_name, {_SEM} AS semantic_text FROM classes")
sql("M6", "SELECT project_id, class_name, emb_type, emb_score FROM emb", VECTORS)
sql("M7", f"""
SELECT e.project_id, e.src, e.dst, {cosine_sql('a.vec', 'b.vec')} AS cosine
FROM edges e JOIN class_vec a ON a.project_id = e.project_id AND a.class_name = e.src
JOIN class_vec b ON b.project_id = e.project_id AND b.class_name = e.dst""", GRAPH, VECTORS)

VEC_GROUPS = """
vec_groups AS (SELECT project_id, vec, min(class_name) AS a FROM class_vec GROUP BY ALL)"""
M4_PAIRS = f"""
SELECT a.project_id, a.a, b.a AS b, {cosine_sql('a.vec', 'b.vec')} AS cosine, 'pair' AS kind
FROM vec_groups a JOIN vec_groups b ON a.project_id = b.project_id AND a.a < b.a
WHERE {cosine_sql('a.vec', 'b.vec')} >= 0.9::DOUBLE
UNION ALL
SELECT v.project_id, g.a, v.class_name, {cosine_sql('v.vec', 'v.vec')}, 'copy'
FROM class_vec v JOIN vec_groups g ON g.project_id = v.project_id AND g.vec = v.vec
WHERE v.class_name <> g.a AND {cosine_sql('v.vec', 'v.vec')} >= 0.9::DOUBLE"""
sql("M4", M4_PAIRS, VECTORS, VEC_GROUPS)
sql("M4_exact", M4_PAIRS, VECTORS, VEC_GROUPS)
sql("M4_nearest", f"""
SELECT project_id, a, CAST(rank AS INTEGER) AS rank, b, cosine FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id, a ORDER BY cosine DESC, b) AS rank FROM (
    SELECT a.project_id, a.a, b.a AS b, {cosine_sql('a.vec', 'b.vec')} AS cosine
    FROM vec_groups a JOIN vec_groups b ON a.project_id = b.project_id AND a.a <> b.a)) WHERE rank <= 5""", VECTORS, VEC_GROUPS)

# default encoder: signed feature hashing by md5
_H = "CAST('0x' || substring(md5(t), 1, 8) AS BIGINT) % 64"
_SIGN = "CASE WHEN CAST('0x' || substring(md5(t), 9, 1) AS BIGINT) % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


def _encoded(name: str, key: str, src: str) -> str:
    """CTE ``name``(key, vec) of the texts in ``src``(key, text)."""
    return f"""
{name}_sums AS (
  SELECT {key}, dim, sum(w) AS v FROM (
    SELECT {key}, {_H} AS dim, {_SIGN} AS w FROM (
      SELECT {key}, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS t FROM {src}) WHERE t <> '')
  GROUP BY ALL
),
{name} AS (
  SELECT {key}, list(v / nullif(length, 0) ORDER BY dim) AS vec FROM (
    SELECT s.*, sqrt(sum(v * v) OVER (PARTITION BY {key})) AS length FROM (
      SELECT {key}, d.dim, coalesce(x.v, 0.0::DOUBLE) AS v
      FROM {src} CROSS JOIN (SELECT unnest(range(64)) AS dim) d LEFT JOIN {name}_sums x USING ({key}, dim)) s)
  GROUP BY {key}
)"""


CLASS_TEXTS = f"""
class_texts AS (
  SELECT project_id, class_name, text FROM (
    SELECT project_id, class_name, {_SEM} AS text,
           row_number() OVER (PARTITION BY project_id, class_name ORDER BY relative_path DESC, class_pos DESC) AS rn
    FROM classes) WHERE rn = 1
),""" + _encoded("class_code", "project_id, class_name", "class_texts")
TYPE_TEXTS = "type_texts AS (" + " UNION ALL ".join(
    f"SELECT {_q(t)} AS package_type, CAST({i} AS INTEGER) AS type_ord, "
    f"{_q(C.TYPE_DESCRIPTION_TEMPLATE.format(type=t, keywords=' '.join(kws)))} AS text"
    for i, (t, kws) in enumerate(C.TYPE_DESCRIPTION_KEYWORDS)) + ")," + _encoded("type_code", "package_type, type_ord", "type_texts")
_E9 = "array_to_string(list_transform(vec, lambda x: CAST(floor(x * 1e9::DOUBLE) AS BIGINT)), '|') AS vec_e9"
sql("M2", f"SELECT project_id, class_name, {_E9} FROM class_code", CLASS_TEXTS)
sql("M3", f"""
SELECT t.package_type, t.type_ord, {_E9}, coalesce(n.classes, 0) AS classes FROM type_code t LEFT JOIN (
  SELECT package_type, count(*) AS classes FROM (
    SELECT project_id, class_name, arg_min(package_type, (-cos, type_ord)) AS package_type FROM (
      SELECT c.project_id, c.class_name, y.package_type, y.type_ord, {cosine_sql('c.vec', 'y.vec')} AS cos
      FROM class_code c CROSS JOIN type_code y) GROUP BY ALL) GROUP BY ALL) n USING (package_type)""", CLASS_TEXTS, TYPE_TEXTS)
sql("M8", f"""
SELECT project_id, v.vectors, CASE WHEN v.vectors < 2 THEN 0 ELSE v.vectors END AS clustered,
       CASE WHEN v.vectors < 2 THEN 0 ELSE least(greatest({C.KMEANS_MIN_K}, v.vectors // 3), {C.KMEANS_MAX_K}) END AS n_clusters, coalesce(p.n, 0) AS similar_pairs, v.vectors - v.texts AS copies
FROM (SELECT project_id, count(*) AS vectors, count(DISTINCT vec) AS texts FROM class_code GROUP BY ALL) v
LEFT JOIN (
  SELECT a.project_id, count(*) AS n FROM code_groups a JOIN code_groups b ON a.project_id = b.project_id AND a.a < b.a
  WHERE {cosine_sql('a.vec', 'b.vec')} >= 0.9::DOUBLE GROUP BY ALL) p USING (project_id)""", CLASS_TEXTS, """
code_groups AS (SELECT project_id, vec, min(class_name) AS a FROM class_code GROUP BY ALL)""")

RESULT_COLS = ("project_id, relative_path, class_pos, class_id, class_name, current_package, is_misplaced, "
               "confidence, reasoning, suggested_package, evidence, method_used")
psql("O1", f"SELECT {RESULT_COLS} FROM results")
psql("O9", f"SELECT {RESULT_COLS} FROM results")
psql("O2", f"SELECT {RESULT_COLS}, true AS timed FROM results")
psql("K1", """SELECT project_id, class_id, class_name, current_package,
  CASE WHEN is_misplaced THEN 'True' ELSE 'False' END AS is_misplaced, confidence, reasoning, suggested_package,
  evidence, method_used, true AS timed FROM results""")
psql("O5", f"SELECT {RESULT_COLS} FROM results", False, True)
psql("O5_no_dependencies", f"SELECT {RESULT_COLS} FROM results", True, False)
THRESH = "(is_misplaced AND NOT (confidence < 0.8::DOUBLE))"
psql("O3", f"SELECT {RK}, class_name, {THRESH} AS is_misplaced, confidence FROM results")
sql("O4", f"""
SELECT {RK}, class_name FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, class_pos) AS rn FROM classes)
WHERE rn <= 3""")
psql("O6", f"""
SELECT project_id, CAST(rank AS INTEGER) AS rank, class_name, current_package, suggested_package, confidence,
       substring(reasoning, 1, {C.TOP_REASON_CHARS}) AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id
                               ORDER BY confidence DESC, class_name, relative_path, class_pos) AS rank
  FROM results WHERE is_misplaced) WHERE rank <= {C.TOP_RECOMMENDATIONS}""")
psql("O7", f"""
SELECT project_id, CAST(rank AS INTEGER) AS rank, class_name, current_package, suggested_package, confidence,
       substring(reasoning, 1, {C.FIRST_MISPLACED_REASON_CHARS}) AS reason FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, class_pos) AS rank
  FROM results WHERE is_misplaced) WHERE rank <= {C.TOP_RECOMMENDATIONS}""")
_c1, _c2, _c3, _c4 = C.DEMO_CONFIDENCES
sql("O8", f"""
SELECT {RK}, class_name, package,
  CASE WHEN (contains(class_name, 'Controller') AND list_contains(annotations, 'RestController'))
         OR contains(class_name, 'Generator') OR len(list_filter(methods, lambda m: contains(m, 'export'))) > 0
       THEN contains(package, 'model') ELSE false END AS is_misplaced,
  CASE WHEN contains(class_name, 'Controller') AND list_contains(annotations, 'RestController') THEN {_q(C.DEMO_CONTROLLER_PACKAGE)}
       WHEN contains(class_name, 'Generator') OR len(list_filter(methods, lambda m: contains(m, 'export'))) > 0 THEN {_q(C.DEMO_SERVICE_PACKAGE)}
       ELSE package END AS suggested_package,
  CASE WHEN contains(class_name, 'Controller') AND list_contains(annotations, 'RestController') THEN {_d(_c1)}
       WHEN contains(class_name, 'Generator') OR len(list_filter(methods, lambda m: contains(m, 'export'))) > 0 THEN {_d(_c2)}
       WHEN list_contains(annotations, 'Entity') THEN {_d(_c3)} ELSE {_d(_c4)} END AS confidence,
  CASE WHEN contains(class_name, 'Controller') AND list_contains(annotations, 'RestController') THEN {_q(C.DEMO_CONTROLLER_REASON)}
       WHEN contains(class_name, 'Generator') OR len(list_filter(methods, lambda m: contains(m, 'export'))) > 0 THEN {_q(C.DEMO_SERVICE_REASON)}
       WHEN list_contains(annotations, 'Entity') THEN {_q(C.DEMO_ENTITY_REASON)} ELSE {_q(C.DEMO_DEFAULT_REASON)} END AS reasoning
FROM classes""")
psql("O10", f"""
SELECT project_id, count(*) AS total_classes, count(*) FILTER (WHERE {THRESH}) AS misplaced_classes,
       CAST(count(*) FILTER (WHERE {THRESH}) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS misplacement_rate
FROM results GROUP BY project_id""")


# ------------------------------------------------------------------ P
_R9 = 9
_T = "CAST(count(*) AS DOUBLE)"
_M = "count(*) FILTER (WHERE is_misplaced)"
P1_SQL = f"""
SELECT project_id, count(*) AS total_classes_analyzed, {_M} AS misplaced_classes_found,
       count(*) - {_M} AS correctly_placed_classes,
       CASE WHEN count(*) > 0 THEN CAST({_M} AS DOUBLE) / {_T} ELSE 0.0::DOUBLE END AS misplacement_rate,
       CASE WHEN count(*) > 0 THEN CAST(count(*) - {_M} AS DOUBLE) / {_T} ELSE 0.0::DOUBLE END AS accuracy_rate
FROM results GROUP BY project_id"""
P2_SQL = f"""
SELECT project_id, round(avg(confidence), {_R9}) AS average_confidence, min(confidence) AS min_confidence,
       max(confidence) AS max_confidence, round(stddev_samp(confidence), {_R9}) AS confidence_std
FROM results WHERE is_misplaced GROUP BY project_id"""
P5_SQL = """
SELECT project_id, current_package AS package, count(*) AS total_classes,
       count(*) FILTER (WHERE is_misplaced) AS misplaced_classes,
       CAST(count(*) FILTER (WHERE is_misplaced) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS misplacement_rate,
       min(relative_path || chr(0) || lpad(CAST(class_pos AS VARCHAR), 10, '0')) AS first_seen
FROM results GROUP BY ALL"""
P6_SQL = f"""
SELECT project_id, package AS most_problematic_package, misplacement_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY misplacement_rate DESC, first_seen) AS rn
  FROM ({P5_SQL})) WHERE rn = 1"""
P7_SQL = f"""
SELECT project_id,
  count(*) FILTER (WHERE is_misplaced AND confidence >= {C.HIGH_CONFIDENCE!r}::DOUBLE) AS high_confidence_suggestions,
  count(*) FILTER (WHERE is_misplaced AND confidence >= {C.MEDIUM_CONFIDENCE!r}::DOUBLE
                   AND confidence < {C.HIGH_CONFIDENCE!r}::DOUBLE) AS medium_confidence_suggestions,
  count(*) FILTER (WHERE is_misplaced AND confidence < {C.MEDIUM_CONFIDENCE!r}::DOUBLE) AS low_confidence_suggestions
FROM results GROUP BY project_id"""
_KWS = " OR ".join(f"contains(lower(reasoning), {_q(k)})" for k in C.REASONING_KEYWORDS)
_WORDS = "len(list_filter(regexp_split_to_array(reasoning, '\\s+'), lambda w: w <> ''))"
P8_SQL = f"""
SELECT project_id, round(coalesce(avg(CASE WHEN is_misplaced THEN
         least(least(CAST({_WORDS} AS DOUBLE) / {C.REASONING_WORDS_FULL!r}::DOUBLE, 1.0::DOUBLE)
               + CASE WHEN {_KWS} THEN {C.REASONING_BONUS!r}::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END),
         1.0::DOUBLE), {_R9}) AS reasoning_quality_score
FROM results GROUP BY project_id"""
TIMED = "results_t AS (SELECT *, 1.25::DOUBLE AS analysis_time FROM results)"
P9_SQL = f"""
SELECT project_id, round(avg(analysis_time), {_R9}) AS average_analysis_time,
       arg_min(analysis_time, relative_path || chr(0) || lpad(CAST(class_pos AS VARCHAR), 10, '0')) AS total_analysis_time,
       round(avg(analysis_time) / CAST(count(*) AS DOUBLE), {_R9}) AS analysis_time_per_class
FROM results_t GROUP BY project_id"""


def _map_sql(key: str, src: str, where: str = "") -> str:
    return (f"SELECT project_id, string_agg({key} || '=' || CAST(n AS VARCHAR), ',' ORDER BY {key}) AS m "
            f"FROM (SELECT project_id, {key}, count(*) AS n FROM {src} {where} GROUP BY ALL) GROUP BY project_id")


psql("P1", P1_SQL)
psql("P2", P2_SQL)
psql("P3", "SELECT project_id, current_package AS package, count(*) AS classes FROM results GROUP BY ALL")
psql("P4", "SELECT project_id, suggested_package, count(*) AS classes FROM results WHERE is_misplaced GROUP BY ALL")
psql("P5", f"SELECT * EXCLUDE (first_seen) FROM ({P5_SQL})")
psql("P6", P6_SQL)
psql("P7", P7_SQL)
psql("P8", P8_SQL)
psql("P9", P9_SQL, True, True, TIMED)
psql("P10", "SELECT project_id, method_used, count(*) AS rows FROM results GROUP BY ALL")
psql("P11", f"""
SELECT project_id, CAST(rank AS INTEGER) AS rank, package, classes FROM (
  SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY classes DESC, first_seen) AS rank FROM (
    SELECT project_id, current_package AS package, count(*) AS classes,
           min(relative_path || chr(0) || lpad(CAST(class_pos AS VARCHAR), 10, '0')) AS first_seen
    FROM results GROUP BY ALL)) WHERE rank <= {C.TOP_PACKAGES}""")
P12_SQL = f"""
SELECT o.*, c.average_confidence, c.min_confidence, c.max_confidence, c.confidence_std,
       pd.m AS package_distribution, coalesce(sd.m, '') AS suggested_package_distribution,
       mp.most_problematic_package, b.high_confidence_suggestions, b.medium_confidence_suggestions,
       b.low_confidence_suggestions, q.reasoning_quality_score, t.average_analysis_time,
       t.total_analysis_time, t.analysis_time_per_class, mu.m AS analysis_methods_used
FROM ({P1_SQL}) o
LEFT JOIN ({P2_SQL}) c USING (project_id)
LEFT JOIN ({_map_sql('current_package', 'results')}) pd USING (project_id)
LEFT JOIN ({_map_sql('suggested_package', 'results', 'WHERE is_misplaced')}) sd USING (project_id)
LEFT JOIN ({P6_SQL}) mp USING (project_id)
LEFT JOIN ({P7_SQL}) b USING (project_id)
LEFT JOIN ({P8_SQL}) q USING (project_id)
LEFT JOIN ({P9_SQL}) t USING (project_id)
LEFT JOIN ({_map_sql('method_used', 'results')}) mu USING (project_id)"""
psql("P12", P12_SQL, True, True, TIMED)
psql("K2", f"SELECT * EXCLUDE (average_analysis_time, total_analysis_time, analysis_time_per_class), true AS timed FROM ({P12_SQL})",
     True, True, TIMED)


# ------------------------------------------------------------------ S
_MID = "CASE k % 9 WHEN 0 THEN 'target/' WHEN 1 THEN 'mod/build/' WHEN 2 THEN '.git/' ELSE '' END"
_ROOT = "'/corpus/' || CAST(project_id AS VARCHAR)"
sql("S1", f"""
SELECT project_id, {_MID} || relative_path AS relative_path, CAST(strlen(content) + CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS BIGINT) AS length
FROM java_files WHERE k % 9 <> 2""")
sql("S5", f"""
SELECT project_id, {_MID} || relative_path AS relative_path, 'invalid UTF-8' AS reason
FROM java_files WHERE k % 9 <> 2 AND k % 29 = 0""")
sql("S6_files", "SELECT project_id, count(*) AS java_files FROM java_files WHERE k % 9 <> 2 GROUP BY project_id")
sql("S2", f"""
SELECT project_id, {_ROOT} || '/' || relative_path AS path, relative_path
FROM java_files WHERE k % 9 > 2""")
sql("S3", "SELECT project_id, relative_path, content FROM java_files WHERE k % 9 > 2")
sql("S4", f"""
SELECT project_id, {_ROOT} || '/' || {_MID} || relative_path AS path, {_MID} || relative_path AS relative_path
FROM java_files""")
sql("S6", "SELECT project_id, count(*) AS java_files FROM java_files GROUP BY project_id")
sql("E11_stream", f"SELECT {RK}, class_name, package FROM classes WHERE k % 9 > 2")
