"""DuckDB oracle SQL: an independent statement of each operator's semantics.

The views ``orders``, ``lineitem``, ``embeddings`` ... are registered by the
checker. Every statement is a shared CTE chain (corpus -> files -> classes ->
edges -> scores -> results) followed by the operator itself. Decimal literals
are written as ``::DOUBLE`` so that float semantics match the Spark side.
"""

from __future__ import annotations

from ..functions import constants as C
from ..sources.corpus import ANNOTATIONS, PACKAGES, STEMS, SUFFIXES, VERBS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _name(k: str) -> str:
    return f"({_list(STEMS)}[({k}) % 10 + 1] || {_list(SUFFIXES)}[(({k}) // 10) % 13 + 1])"


NL = "chr(10)"
LI_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice"

# ---------------------------------------------------------------- corpus
JAVA_FILES = f"""
li_text AS (
  SELECT l_orderkey,
    string_agg('import com.acme.' || {_list(PACKAGES)}[l_partkey % 8 + 1] || '.'
               || {_list(STEMS)}[l_partkey % 10 + 1] || {_list(SUFFIXES)}[l_suppkey % 13 + 1]
               || ';' || {NL}, '' {LI_ORDER}) AS imps,
    string_agg('  private static final String f' || CAST(l_partkey % 17 AS VARCHAR)
               || ' = null;' || {NL}, '' {LI_ORDER}) AS flds,
    string_agg('  public void ' || {_list(VERBS)}[l_partkey % 12 + 1]
               || {_list(STEMS)}[l_suppkey % 10 + 1] || '(int a) {{ }}' || {NL}, '' {LI_ORDER}) AS mths
  FROM lineitem GROUP BY l_orderkey
),
java_files AS (
  SELECT o_custkey AS project_id,
    '/corpus/' || CAST(o_custkey AS VARCHAR) || '/src/main/java/F' || CAST(o_orderkey AS VARCHAR) || '.java' AS file_path,
    'src/main/java/F' || CAST(o_orderkey AS VARCHAR) || '.java' AS relative_path,
    o_orderkey AS k,
    CASE WHEN o_orderkey % 13 = 12 THEN ''
         ELSE 'package com.acme.' || {_list(PACKAGES)}[(o_orderkey // 7) % 8 + 1] || ';' || {NL} END
    || coalesce(imps, '')
    || '@' || {_list(ANNOTATIONS)}[o_orderkey % 9 + 1] || {NL}
    || 'public ' || CASE WHEN o_orderkey % 11 = 9 THEN 'interface ' WHEN o_orderkey % 11 = 10 THEN 'enum ' ELSE 'class ' END
    || {_name('o_orderkey')}
    || CASE WHEN o_orderstatus = 'F' THEN ' extends ' || {_name('o_orderkey + 1')} ELSE '' END
    || CASE WHEN o_orderstatus = 'O' THEN ' implements ' || {_name('o_orderkey + 3')} || ', Runnable' ELSE '' END
    || ' {{' || {NL}
    || coalesce(flds, '') || coalesce(mths, '')
    || '}}' || {NL}
    || CASE WHEN o_orderkey % 10 = 7 THEN 'class ' || {_name('o_orderkey + 5')} || ' {{ }}' || {NL} ELSE '' END
    AS content
  FROM orders LEFT JOIN li_text ON l_orderkey = o_orderkey
)"""

# ---------------------------------------------------------------- extraction
_KW = _list(C.JAVA_KEYWORDS)
FILES = f"""
files AS (
  SELECT project_id, file_path, relative_path, k,
    coalesce(nullif(regexp_extract(content, {_q(C.PACKAGE_RX)}, 1), ''), 'default') AS package,
    regexp_extract_all(content, {_q(C.IMPORT_RX)}, 1) AS imports,
    regexp_extract_all(content, {_q(C.CLASS_RX)}, 1) AS class_names,
    regexp_extract_all(content, {_q(C.METHOD_RX)}, 1) AS methods,
    list_filter(regexp_extract_all(content, {_q(C.FIELD_RX)}, 1), lambda x: NOT list_contains({_KW}, x)) AS fields,
    regexp_extract_all(content, {_q(C.ANNOTATION_RX)}, 1) AS annotations,
    regexp_extract(content, {_q(C.EXTENDS_RX)}, 1) AS extends,
    CASE WHEN regexp_extract(content, {_q(C.IMPLEMENTS_RX)}, 1) = '' THEN []::VARCHAR[]
         ELSE list_transform(string_split(regexp_extract(content, {_q(C.IMPLEMENTS_RX)}, 1), ','),
                             lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS implements,
    replace(replace(substring(content, 1, {C.PREVIEW_CHARS}), {NL}, ' '), chr(13), '') AS content_preview,
    content
  FROM java_files
)"""

CLASSES = """
classes_raw AS (
  SELECT project_id, file_path, relative_path, k, package, imports, methods, fields, annotations,
         extends, implements, content_preview, content,
         unnest(class_names) AS class_name,
         CAST(generate_subscripts(class_names, 1) - 1 AS INTEGER) AS class_pos
  FROM files
),
classes AS (
  SELECT project_id, class_pos, class_name, package, file_path, relative_path, k,
         imports, methods, fields, annotations, extends, implements,
         CASE WHEN contains(content, 'interface ' || class_name) THEN 'interface'
              WHEN contains(content, 'enum ' || class_name) THEN 'enum' ELSE 'class' END AS class_type,
         content_preview
  FROM classes_raw
)"""

BASE = [JAVA_FILES, FILES, CLASSES]

# ---------------------------------------------------------------- graph
GRAPH = """
names AS (SELECT DISTINCT project_id, class_name FROM classes),
class_index AS (
  SELECT project_id, class_name, package FROM (
    SELECT project_id, class_name, package,
           row_number() OVER (PARTITION BY project_id, class_name
                              ORDER BY relative_path DESC, class_pos DESC) AS rn
    FROM classes) WHERE rn = 1
),
imp_raw AS (
  SELECT project_id, class_name AS src, package, string_split(unnest(imports), '.')[-1] AS dst FROM classes
),
imp_edges AS (
  SELECT DISTINCT i.project_id, i.src, i.dst FROM imp_raw i
  JOIN names n ON n.project_id = i.project_id AND n.class_name = i.dst
),
ext_edges AS (
  SELECT DISTINCT c.project_id, c.class_name AS src, c.extends AS dst FROM classes c
  JOIN names n ON n.project_id = c.project_id AND n.class_name = c.extends
  WHERE c.extends <> ''
),
impl_raw AS (SELECT project_id, class_name AS src, unnest(implements) AS dst FROM classes),
impl_edges AS (
  SELECT DISTINCT i.project_id, i.src, i.dst FROM impl_raw i
  JOIN names n ON n.project_id = i.project_id AND n.class_name = i.dst
),
edges AS (
  SELECT * FROM imp_edges UNION SELECT * FROM ext_edges UNION SELECT * FROM impl_edges
),
row_counts AS (
  SELECT project_id, package, class_name, count(*) AS n FROM classes GROUP BY ALL
)"""


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + body


# ---------------------------------------------------------------- scores
def _score_sql(rules: dict) -> str:
    s = "0.0::DOUBLE"
    for p in rules["patterns"]:
        s = f"({s} + CASE WHEN ends_with(lower(class_name), {_q(C.pattern_suffix(p))}) THEN {_d(C.PATTERN_WEIGHT)} ELSE 0.0::DOUBLE END)"
    for k in rules["keywords"]:
        s = f"({s} + CASE WHEN contains(lower(class_name), {_q(k)}) THEN {_d(C.KEYWORD_WEIGHT)} ELSE 0.0::DOUBLE END)"
    meth = " OR ".join(f"contains(lower(m), {_q(r)})" for r in rules["methods"])
    s = (f"({s} + least(CAST(len(list_filter(methods, lambda m: {meth})) AS DOUBLE) * {_d(C.METHOD_WEIGHT)}, "
         f"{_d(C.METHOD_CAP)}))")
    s = (f"({s} + least(CAST(len(list_filter(annotations, lambda a: list_contains({_list(rules['annotations'])}, a))) "
         f"AS DOUBLE) * {_d(C.ANNOTATION_WEIGHT)}, {_d(C.ANNOTATION_CAP)}))")
    return f"least({s}, {_d(C.RULE_CAP)})"


def _lists(kind: str) -> str:
    return "[" + ", ".join(_list(r[kind]) for _, r in C.PLACEMENT_RULES) + "]"


def _suffix_lists() -> str:
    return "[" + ", ".join(_list([C.pattern_suffix(p) for p in r["patterns"]]) for _, r in C.PLACEMENT_RULES) + "]"


def cosine_sql(a: str, b: str) -> str:
    dot = f"list_reduce(list_transform(generate_series(1, len({a})), lambda i: {a}[i] * {b}[i]), lambda p, q: p + q)"
    na = f"sqrt(list_reduce(list_transform({a}, lambda x: x * x), lambda p, q: p + q))"
    nb = f"sqrt(list_reduce(list_transform({b}, lambda x: x * x), lambda p, q: p + q))"
    return f"(CASE WHEN {na} * {nb} <> 0 THEN {dot} / ({na} * {nb}) ELSE 0.0::DOUBLE END)"


_TYPES = C.TYPE_NAMES
_SCORE_COLS = ", ".join(f"{_score_sql(r)} AS s_{t}" for t, r in C.PLACEMENT_RULES)
_BEST = "greatest(" + ", ".join(f"s_{t}" for t in _TYPES) + ")"
_BEST_TYPE = "CASE " + " ".join(f"WHEN s_{t} = {_BEST} THEN {_q(t)}" for t in _TYPES) + " END"
_BEST_ORD = "CASE " + " ".join(f"WHEN s_{t} = {_BEST} THEN {i}" for i, t in enumerate(_TYPES)) + " END"
_PKG_TYPE = ("CASE " + " ".join(f"WHEN contains(lower(package), {_q(t)}) THEN {_q(t)}" for t in _TYPES)
             + f" ELSE {_q(C.UNKNOWN_TYPE)} END")

RULE_SCORES = f"""
type_scores AS (SELECT c.*, {_SCORE_COLS} FROM classes c),
rule_rows AS (
  SELECT *, {_BEST} AS rule_score, {_BEST_TYPE} AS rule_type, {_BEST_ORD} AS rule_ord,
         {_PKG_TYPE} AS current_type
  FROM type_scores
)"""

VECTORS = f"""
last_k AS (
  SELECT project_id, class_name, k FROM (
    SELECT project_id, class_name, k,
           row_number() OVER (PARTITION BY project_id, class_name ORDER BY relative_path DESC, class_pos DESC) AS rn
    FROM classes) WHERE rn = 1
),
class_vec AS (
  SELECT l.project_id, l.class_name, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM last_k l JOIN embeddings e ON e.vec_id = l.k % (SELECT count(*) FROM embeddings)
),
type_vec AS (
  SELECT CAST(vec_id AS INTEGER) AS type_ord, {_list(_TYPES)}[vec_id + 1] AS package_type,
         CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings WHERE vec_id < {len(_TYPES)}
),
type_cos AS (
  SELECT cv.project_id, cv.class_name, tv.type_ord, tv.package_type, {cosine_sql('cv.vec', 'tv.vec')} AS cos
  FROM class_vec cv CROSS JOIN type_vec tv
),
emb AS (
  SELECT project_id, class_name, max(cos) AS emb_score,
         arg_min(package_type, (-cos, type_ord)) AS emb_type
  FROM type_cos GROUP BY ALL
)"""


def scored_cte(with_emb: bool = True, with_dep: bool = True) -> str:
    emb = "coalesce(e.emb_score, 0.0::DOUBLE)" if with_emb else "0.0::DOUBLE"
    dep = "CASE WHEN d.class_name IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if with_dep else "0.0::DOUBLE"
    joins = ""
    if with_emb:
        joins += " LEFT JOIN emb e ON e.project_id = r.project_id AND e.class_name = r.class_name"
    if with_dep:
        joins += " LEFT JOIN dep d ON d.project_id = r.project_id AND d.class_name = r.class_name"
    return f"""
dep AS (SELECT DISTINCT project_id, src AS class_name FROM edges),
scored AS (
  SELECT r.*, {emb} AS embedding_score, {dep} AS dependency_score,
         r.rule_score * {_d(C.RULE_MIX)} + {emb} * {_d(C.EMBEDDING_MIX)} + {dep} * {_d(C.DEPENDENCY_MIX)} AS total_score
  FROM rule_rows r{joins}
)"""


_RM = _lists("methods")
_RA = _lists("annotations")
_RS = _suffix_lists()
_MATCH = "len(list_filter({rm}[rule_ord + 1], lambda r: contains(lower(m), r))) > 0"
REASON = f"""coalesce(nullif(concat_ws('; ',
    CASE WHEN contains(lower(class_name), rule_type)
         THEN 'Class name ''' || class_name || ''' suggests ' || rule_type || ' functionality' END,
    CASE WHEN len(list_filter(annotations, lambda a: list_contains({_RA}[rule_ord + 1], lower(a)))) > 0
         THEN 'Contains ' || rule_type || '-specific annotations: '
              || array_to_string(list_filter(annotations, lambda a: list_contains({_RA}[rule_ord + 1], lower(a))), ', ') END,
    CASE WHEN len(list_filter(methods[1:{C.REASON_METHODS_SCANNED}], lambda m: {_MATCH.format(rm=_RM)})) > 0
         THEN 'Contains ' || rule_type || '-typical methods: '
              || array_to_string(list_filter(methods[1:{C.REASON_METHODS_SCANNED}], lambda m: {_MATCH.format(rm=_RM)})[1:{C.METHODS_SHOWN}], ', ') END
  ), ''), 'Semantic analysis suggests better fit in ' || rule_type || ' package')"""
EVIDENCE = f"""coalesce(nullif(concat_ws('; ',
    CASE WHEN len(list_filter({_RS}[rule_ord + 1], lambda p: ends_with(lower(class_name), p))) > 0
         THEN 'Name matches ' || rule_type || ' pattern' END,
    CASE WHEN len(list_filter(annotations, lambda a: list_contains({_RA}[rule_ord + 1], a))) > 0
         THEN 'Annotations: ' || array_to_string(list_filter(annotations, lambda a: list_contains({_RA}[rule_ord + 1], a)), ', ') END,
    CASE WHEN len(list_filter(methods[1:{C.EVIDENCE_METHODS_SCANNED}], lambda m: {_MATCH.format(rm=_RM)})) > 0
         THEN 'Methods: '
              || array_to_string(list_filter(methods[1:{C.EVIDENCE_METHODS_SCANNED}], lambda m: {_MATCH.format(rm=_RM)})[1:{C.METHODS_SHOWN}], ', ') END
  ), ''), {_q(C.EVIDENCE_FALLBACK)})"""

RESULTS = f"""
flagged AS (
  SELECT DISTINCT project_id, class_name FROM scored
  WHERE total_score > {_d(C.MISPLACED_THRESHOLD)} AND current_type <> rule_type
),
last_scored AS (
  SELECT * FROM (
    SELECT s.*, row_number() OVER (PARTITION BY project_id, class_name
                                   ORDER BY relative_path DESC, class_pos DESC) AS rn_last
    FROM scored s) WHERE rn_last = 1
),
sugg AS (
  SELECT l.project_id, l.class_name, l.rule_type AS suggested_package,
         least(l.rule_score, {_d(C.CONFIDENCE_CAP)}) AS confidence,
         {REASON} AS reasoning, {EVIDENCE} AS evidence,
         {_q(C.METHOD_USED_SUGGESTION)} AS method_used
  FROM last_scored l
  WHERE EXISTS (SELECT 1 FROM flagged f WHERE f.project_id = l.project_id AND f.class_name = l.class_name)
),
results AS (
  SELECT c.project_id, c.relative_path, c.class_pos, c.class_name AS class_id, c.class_name,
         c.package AS current_package, s.class_name IS NOT NULL AS is_misplaced,
         CASE WHEN s.class_name IS NOT NULL THEN s.confidence ELSE {_d(C.DEFAULT_CONFIDENCE)} END AS confidence,
         CASE WHEN s.class_name IS NOT NULL THEN s.reasoning ELSE {_q(C.DEFAULT_REASONING)} END AS reasoning,
         CASE WHEN s.class_name IS NOT NULL THEN s.suggested_package ELSE c.package END AS suggested_package,
         CASE WHEN s.class_name IS NOT NULL THEN s.evidence ELSE {_q(C.DEFAULT_EVIDENCE)} END AS evidence,
         CASE WHEN s.class_name IS NOT NULL THEN s.method_used ELSE {_q(C.METHOD_USED_DEFAULT)} END AS method_used
  FROM classes c LEFT JOIN sugg s ON s.project_id = c.project_id AND s.class_name = c.class_name
)"""


def pipeline(with_emb: bool = True, with_dep: bool = True) -> list[str]:
    return [GRAPH, RULE_SCORES, VECTORS, scored_cte(with_emb, with_dep), RESULTS]


# ---------------------------------------------------------------- cycles
REACH = """
reach AS (
  SELECT project_id, src AS a, dst AS b FROM edges
  UNION
  SELECT r.project_id, r.a, e.dst FROM reach r JOIN edges e ON e.project_id = r.project_id AND e.src = r.b
),
cyclic AS (SELECT DISTINCT project_id, a AS class_name FROM reach WHERE a = b),
cyc_edges AS (
  SELECT e.project_id, e.src, e.dst FROM edges e
  WHERE EXISTS (SELECT 1 FROM reach r WHERE r.project_id = e.project_id AND r.a = e.dst AND r.b = e.src)
),
paths AS (
  SELECT project_id, src AS start, dst AS last, [src, dst] AS path FROM cyc_edges WHERE dst > src
  UNION ALL
  SELECT p.project_id, p.start, e.dst, list_append(p.path, e.dst)
  FROM paths p JOIN cyc_edges e ON e.project_id = p.project_id AND e.src = p.last
  WHERE e.dst > p.start AND NOT list_contains(p.path, e.dst)
),
cycles AS (
  SELECT project_id, src || '->' || dst AS cycle, 1 AS length FROM edges WHERE src = dst
  UNION ALL
  SELECT p.project_id, array_to_string(list_append(p.path, p.start), '->') AS cycle, len(p.path) AS length
  FROM paths p JOIN cyc_edges e ON e.project_id = p.project_id AND e.src = p.last AND e.dst = p.start
)"""


# one shortest cycle through each cyclic class, the least in name order
EVIDENCE_PATHS = """
epaths AS (
  SELECT project_id, src AS root, dst AS last, [src, dst] AS path FROM cyc_edges WHERE src <> dst
  UNION ALL
  SELECT p.project_id, p.root, e.dst, list_append(p.path, e.dst)
  FROM epaths p JOIN cyc_edges e ON e.project_id = p.project_id AND e.src = p.last
  WHERE e.dst <> p.root AND NOT list_contains(p.path, e.dst)
),
closed AS (
  SELECT project_id, src AS root, [src] AS path FROM edges WHERE src = dst
  UNION ALL
  SELECT p.project_id, p.root, p.path
  FROM epaths p JOIN cyc_edges e ON e.project_id = p.project_id AND e.src = p.last AND e.dst = p.root
),
evidence AS (
  SELECT project_id, root AS class_name, array_to_string(list_append(path, root), '->') AS cycle, len(path) AS length
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, root ORDER BY len(path), path) AS rn FROM closed) WHERE rn = 1
)"""
