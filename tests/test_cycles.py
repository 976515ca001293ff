"""Components and cycle evidence: one task per small project, and distributed rounds, against plain search."""

import random
from collections import deque

import pytest

from pkgsift.operators import cycles as CY
from pkgsift.session import materialize

SCHEMA = "project_id long, src string, dst string"


def reach(adjacent, start):
    seen, queue = set(), deque([start])
    while queue:
        for d in adjacent.get(queue.popleft(), ()):
            if d not in seen:
                seen.add(d)
                queue.append(d)
    return seen


def plain(rows):
    """{project: adjacency}, cyclic classes, {(project, class): component} of components of two or more."""
    graphs = {}
    for p, s, d in rows:
        graphs.setdefault(p, {}).setdefault(s, set()).add(d)
    cyclic, comp = set(), {}
    for p, adjacent in graphs.items():
        far = {n: reach(adjacent, n) for n in adjacent}
        for n in adjacent:
            if n in far[n]:
                cyclic.add((p, n))
                same = {m for m in far[n] if n in far.get(m, ())}
                if len(same) > 1:
                    comp[p, n] = (min(same), len(same))
    return graphs, cyclic, comp


def shortest(adjacent, root):
    level = {(root,)}
    while True:
        level = {path + (d,) for path in level for d in adjacent.get(path[-1], ()) if d == root or d not in path}
        closed = [p for p in level if p[-1] == root]
        if closed:
            return min(closed)


def graphs(seed):
    r = random.Random(seed)
    rows = set()
    for p in range(8):
        n = r.randint(2, 14)
        for _ in range(r.randint(1, int(1.6 * n) + 1)):
            rows.add((p, f"c{r.randrange(n):02}", f"c{r.randrange(n):02}"))
    # two rings that share a class, a ring with a chain through it, a chain that returns to its start, a dead chain
    for a in ("x0 x1 x2 x0 x3 x4 x0", "k0 k1 k2 k3 k4 k5 k6 k7 k0 m0 m1 m2 k4", "u a1 a2 a3 u v", "d0 d1 d2 d3 d4 d5"):
        w = a.split()
        rows |= {(90, s, d) for s, d in zip(w, w[1:])}
    return sorted(rows)


@pytest.mark.parametrize("small", [2000, 0, 9])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_evidence_match_plain_search(spark, seed, small):
    rows = graphs(seed)
    adjacent, cyclic, comp = plain(rows)
    edges = materialize(spark.createDataFrame(rows + rows[:5], SCHEMA), "edges")
    got = {(r.project_id, r.node): (r.component, r.size) for r in CY.components(edges, small).collect()}
    assert got == comp
    assert sorted(map(tuple, CY.cyclic_classes(edges, small).collect())) == sorted(cyclic)
    evidence = CY.cycle_evidence(edges, small).collect()
    assert sorted((r.project_id, r.class_name) for r in evidence) == sorted(cyclic)
    for r in evidence:
        assert tuple(r.cycle.split("->")) == shortest(adjacent[r.project_id], r.class_name) if r.length > 1 else r.cycle == f"{r.class_name}->{r.class_name}"
    empty = edges.limit(0)
    assert CY.components(empty, small).count() == 0 and CY.cycle_evidence(empty, small).count() == 0


def test_long_chain_and_ring_take_few_rounds(spark, monkeypatch):
    """10,000 classes in a chain and in a ring: rounds grow with the logarithm of the length."""
    n, rounds = 10_000, []
    chain = spark.range(n).selectExpr("1L as project_id", "format_string('c%05d', id) as src", "format_string('c%05d', id + 1) as dst")
    ring = spark.range(n).selectExpr("2L as project_id", "format_string('r%05d', id) as src", f"format_string('r%05d', (id + 1) % {n}) as dst")
    keep = CY.materialize
    monkeypatch.setattr(CY, "materialize", lambda df, name: rounds.append(name) or keep(df, name))
    out = CY.components(chain.unionByName(ring)).groupBy("project_id", "component", "size").count().collect()
    assert [tuple(r) for r in out] == [(2, "r00000", n, n)]
    assert sum(r in ("cyc-jump", "cyc-core") for r in rounds) <= 20
