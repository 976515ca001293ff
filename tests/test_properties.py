"""Property checks: regex parity with the whitespace cap, graph and metric invariants."""

import random
import re

from conftest import SF_SMALL, java_files_df
from pyspark.sql import functions as F

from pkgsift.functions import constants as C
from pkgsift.operators import cycles as CY
from pkgsift.operators import graph as G
from pkgsift.operators import metrics as P
from pkgsift.operators.extract import file_features
from pkgsift.plans import catalog as K

TOKENS = ["public", "private", "protected", "static", "final", "abstract", "void", "int", "Foo", "bar",
          "List<T>", "a,", "b", "[]", "(", ")", "(int x)", ";", "=", "{", "}", "class", "interface", "enum",
          "X", "publicclass", "static final", "@Id", "import a.B;", "package p.q;"]
BLANKS = [" ", "  ", "\n", "\t", "    ", " \n      ", " " * 12]


def _text(rng):
    parts = []
    for _ in range(rng.randint(1, 30)):
        parts.append(rng.choice(TOKENS))
        parts.append(rng.choice(BLANKS) if rng.random() < 0.8 else "")
    return "".join(parts)


def test_whitespace_cap_keeps_python_matches(spark):
    rng = random.Random(7)
    texts = [_text(rng) for _ in range(2000)]
    df = java_files_df(spark, [(1, f"F{i}.java", t) for i, t in enumerate(texts)])
    got = {r.relative_path: (r.methods, r.fields, r.class_names) for r in file_features(df).collect()}
    kw = set(C.JAVA_KEYWORDS)
    for i, t in enumerate(texts):
        m = re.findall(C.METHOD_RX, t, flags=re.ASCII)
        f = [x for x in re.findall(C.FIELD_RX, t, flags=re.ASCII) if x not in kw]
        c = re.findall(C.CLASS_RX, t, flags=re.ASCII)
        assert got[f"F{i}.java"] == (m, f, c), t


def test_graph_and_metric_invariants(spark):
    cls = K.classes_table(spark, SF_SMALL)
    e = G.edges(cls)
    # every edge target and source is a known class of the project
    names = cls.select("project_id", "class_name").distinct()
    assert e.join(names.withColumnRenamed("class_name", "dst"), ["project_id", "dst"], "left_anti").count() == 0
    assert e.join(names.withColumnRenamed("class_name", "src"), ["project_id", "src"], "left_anti").count() == 0
    # each reported cycle is a closed walk over edges
    pairs = {(r.project_id, r.src, r.dst) for r in e.collect()}
    for r in CY.simple_cycles(e).collect():
        nodes = r.cycle.split("->")
        assert nodes[0] == nodes[-1] and min(nodes) == nodes[0]
        assert all((r.project_id, a, b) in pairs for a, b in zip(nodes, nodes[1:]))
    a = K.analysis(spark, SF_SMALL)
    assert a.results.count() == cls.count()
    p1 = {r.project_id: r.total_classes_analyzed for r in P.overview(a.results).collect()}
    p3 = {}
    for r in P.package_distribution(a.results).collect():
        p3[r.project_id] = p3.get(r.project_id, 0) + r.classes
    assert p1 == p3


def test_cosine_symmetry(spark):
    cls = K.classes_table(spark, SF_SMALL)
    cv, _ = K.vector_inputs(spark, SF_SMALL, cls)
    from pkgsift.operators.vectors import pair_similarity
    e = G.edges(cls)
    fwd = pair_similarity(e, cv)
    rev = pair_similarity(e.select("project_id", F.col("dst").alias("src"), F.col("src").alias("dst")), cv)
    a = {(r.project_id, r.src, r.dst): r.cosine for r in fwd.collect()}
    b = {(r.project_id, r.dst, r.src): r.cosine for r in rev.collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)
