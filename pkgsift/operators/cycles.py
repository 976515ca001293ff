"""Dependency cycles (D12), all projects at once.

Contract: (a) ``has_cycle`` per project; (b) cyclic classes = classes that reach themselves;
(c) ``cycle_evidence``: one shortest cycle through each cyclic class, so as many rows as (b).
``simple_cycles`` lists all simple cycles instead; their number can grow exponentially.

Projects of at most SMALL edges are solved whole after a single shuffle by project: no
rounds. A larger project stays distributed, and its rounds (joins and aggregations keyed by
project and name) work on what is left of it:

1. Reduce: classes without an edge in or out are dropped, and chains of classes with one edge in and one out
   are contracted to one edge by pointer jumping, in as many rounds as the logarithm
   of the longest chain. A chain that closes on itself is a component. This repeats until nothing changes.
2. Colour: the least name spreads along the edges, from the classes whose colour changed last
   only; the class that keeps its own name is a root, and what reaches it backwards within
   its colour is its component. The rest is reduced and coloured again.
3. Contracted classes belong to the component that both ends of their chain are in.

Each round's state is written to the shared checkpoint folder (Parquet), so lineage stays short
and a lost executor only recomputes one round.
"""

from __future__ import annotations

import itertools
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, ship_package

PID = "project_id"
#: Edges of a project that one task solves; larger projects go through distributed rounds.
SMALL = 2000
#: Result rows of a batch.
FLUSH = 20_000
COMPONENT = "node string, component string, size long"


def split_by_size(edges: DataFrame, small: int) -> tuple[DataFrame, DataFrame | None]:
    """(edges of small projects, edges of the others or None), both distinct."""
    edges = materialize(edges.select(PID, "src", "dst").distinct(), "cyc-edges")
    large = materialize(edges.groupBy(F.col(PID).alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("p"), "cyc-large")
    if large.isEmpty():
        return edges, None
    same = F.col(PID).eqNullSafe(F.col("p"))
    return edges.join(large, same, "left_anti"), materialize(edges.join(large, same, "left_semi"), "cyc-large-edges")


# ------------------------------------------------------------------ one project in a task
def _adjacent(edges: list[tuple[str, str]]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for s, d in sorted(edges):
        out.setdefault(s, []).append(d)
        out.setdefault(d, [])
    return out


def _strong_components(adjacent: dict[str, list[str]]) -> list[list[str]]:
    """Depth-first search with an explicit stack; the components of two classes or more."""
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    path, open_, found = [], set(), []
    for start in adjacent:
        if start in seen:
            continue
        work = [(start, iter(adjacent[start]))]
        while work:
            node, rest = work[-1]
            if node not in seen:
                seen[node] = low[node] = len(seen)
                path.append(node)
                open_.add(node)
            step = next(rest, None)
            if step is not None:
                if step not in seen:
                    work.append((step, iter(adjacent[step])))
                elif step in open_:
                    low[node] = min(low[node], seen[step])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[node])
            if low[node] == seen[node]:
                cut = path.index(node) if path[-1] != node else len(path) - 1
                part, path = path[cut:], path[:cut]
                open_.difference_update(part)
                if len(part) > 1:
                    found.append(part)
    return found


def _shortest_cycle(root: str, adjacent: dict[str, list[str]], inside: set[str]) -> list[str]:
    """Breadth first in name order with parent pointers: the least of the shortest cycles from ``root``."""
    if root in adjacent[root]:
        return [root, root]
    parent, queue = {root: root}, deque([root])
    while queue:
        node = queue.popleft()
        for step in adjacent[node]:
            if step == root:
                out = [root]
                while node != root:
                    out.append(node)
                    node = parent[node]
                return [root] + out[:0:-1] + [root]
            if step in inside and step not in parent:
                parent[step] = node
                queue.append(step)
    raise AssertionError(f"{root} is on no cycle")


def _components_of(edges: list[tuple[str, str]]) -> list[tuple]:
    return [(n, min(c), len(c)) for c in _strong_components(_adjacent(edges)) for n in c]


def _evidence_of(edges: list[tuple[str, str]]) -> list[tuple]:
    adjacent = _adjacent(edges)
    inside = {n: set(c) for c in _strong_components(adjacent) for n in c}
    return [(n, _shortest_cycle(n, adjacent, inside.get(n, set()))) for n, d in adjacent.items() if n in inside or n in d]


def _in_tasks(edges: DataFrame, solve, fields: str) -> DataFrame:
    """``solve`` on the edges of each project, as a stream of the projects of a task (a group of its own costs 6 ms each)."""
    schema = T.StructType([edges.schema[PID], *T.StructType.fromDDL(fields).fields])
    ship_package(edges.sparkSession)
    kinds = to_arrow_schema(schema)

    def run(batches):
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        out = []
        for project, group in itertools.groupby(rows, key=lambda r: r[0]):
            out += [(project, *x) for x in solve([r[1:] for r in group])]
            if len(out) > FLUSH:
                yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], kinds)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, r)) for r in out], kinds)

    return edges.select(PID, "src", "dst").repartition(PID).sortWithinPartitions(PID).mapInArrow(run, schema)


# ------------------------------------------------------------------ large projects in rounds
def _key(df: DataFrame, **names: str) -> DataFrame:
    """The project with some columns under other names."""
    return df.select(PID, *[F.col(old).alias(new) for new, old in names.items()])


def jump_chains(inner: DataFrame) -> DataFrame:
    """(project, node, fwd, bwd, ring): the first classes outside ``inner`` on both sides of each chain.

    ``inner`` has one next and one previous class each. Every round doubles the reach; a pointer that is
    still inside after as many steps as there are classes runs in a ring, whose least name is ``ring``.
    """
    state = materialize(inner.select(PID, "node", F.col("nxt").alias("fwd"), F.col("prv").alias("bwd"), F.least("node", "nxt").alias("least"), F.lit(True).alias("open")), "cyc-jump")
    n, reach = state.count(), 1
    while reach < 2 * n:
        ahead, behind = _key(state, fwd="node", fwd2="fwd", least2="least"), _key(state, bwd="node", bwd2="bwd")
        moving = state.where("open").join(ahead, [PID, "fwd"], "left").join(behind, [PID, "bwd"], "left")
        moved = moving.select(PID, "node", F.coalesce("fwd2", "fwd").alias("fwd"), F.coalesce("bwd2", "bwd").alias("bwd"),
                              F.least("least", F.coalesce("least2", "least")).alias("least"), (F.col("fwd2").isNotNull() | F.col("bwd2").isNotNull()).alias("open"))
        state = materialize(moved.unionByName(state.where("not open")), "cyc-jump")
        reach *= 2
        if state.where("open").isEmpty():
            break
    return state.select(PID, "node", "fwd", "bwd", F.when(F.col("open"), F.col("least")).alias("ring"))


def reduce_graph(core: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(what is left, chains of each pass): drops dead ends and contracts chains until nothing changes.

    ``core`` has no self-edges. A row of a pass has (project, node, fwd, bwd, ring).
    """
    passes = []
    while not core.isEmpty():
        outs = core.groupBy(PID, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"), F.min("dst").alias("nxt"))
        ins = core.groupBy(PID, F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"), F.min("src").alias("prv"))
        nodes = materialize(outs.join(ins, [PID, "node"], "full"), "cyc-nodes")
        alive = nodes.where("n_in is not null and n_out is not null").select(PID, "node")
        inner = nodes.where("n_in = 1 and n_out = 1")
        kept = core
        if not inner.isEmpty():
            chains = jump_chains(inner)
            passes.append(chains)
            there = _key(chains, n="node")
            kept = (core.join(_key(there, src="n"), [PID, "src"], "left_anti").join(_key(there, dst="n"), [PID, "dst"], "left_anti")
                    .unionByName(chains.where("ring is null").select(PID, F.col("bwd").alias("src"), F.col("fwd").alias("dst"))))
        kept = kept.where("src <> dst").join(_key(alive, src="node"), [PID, "src"], "left_semi").join(_key(alive, dst="node"), [PID, "dst"], "left_semi")
        before, core = core, materialize(kept.select(PID, "src", "dst").distinct(), "cyc-core")
        if inner.isEmpty() and core.count() == before.count():
            break
    return core, passes


def colour(core: DataFrame) -> DataFrame:
    """(project, node, component): the components whose least name reaches no smaller one, by frontier rounds."""
    state = core.select(PID, F.col("src").alias("node")).unionByName(core.select(PID, F.col("dst").alias("node"))).distinct()
    state = materialize(state.select(PID, "node", F.col("node").alias("color"), F.lit(True).alias("new")), "cyc-color")
    while not state.where("new").isEmpty():
        sent = core.join(_key(state.where("new"), src="node", c="color"), [PID, "src"]).groupBy(PID, F.col("dst").alias("node")).agg(F.min("c").alias("c"))
        less = F.coalesce(F.col("c") < F.col("color"), F.lit(False))
        state = materialize(state.join(sent, [PID, "node"], "left").select(PID, "node", F.when(less, F.col("c")).otherwise(F.col("color")).alias("color"), less.alias("new")), "cyc-color")
    inside = materialize(core.join(_key(state, src="node", color="color"), [PID, "src"]).join(_key(state, dst="node", color="color"), [PID, "dst", "color"]).select(PID, "src", "dst", "color"), "cyc-inside")
    frontier = materialize(state.where("node = color").select(PID, "node", "color"), "cyc-member")
    members = frontier
    while True:
        back = inside.join(_key(frontier, dst="node", color="color"), [PID, "dst", "color"]).select(PID, F.col("src").alias("node"), "color").distinct()
        frontier = materialize(back.join(members, [PID, "node", "color"], "left_anti"), "cyc-member")
        if frontier.isEmpty():
            return members.select(PID, "node", F.col("color").alias("component"))
        members = materialize(members.unionByName(frontier), "cyc-members")


def large_components(edges: DataFrame) -> DataFrame:
    """(project, node, component, size) of the classes in components of two or more."""
    core = materialize(edges.where("src <> dst"), "cyc-core")
    found, passes = [], []
    while True:
        core, chains = reduce_graph(core)
        passes += chains
        if core.isEmpty():
            break
        members = materialize(colour(core), "cyc-found")
        found.append(members)
        core = materialize(core.join(_key(members, src="node"), [PID, "src"], "left_anti").join(_key(members, dst="node"), [PID, "dst"], "left_anti"), "cyc-core")
    empty = edges.select(PID, F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    known = empty
    for f in found:
        known = known.unionByName(f)
    # later passes first: the ends of a chain may be inside a chain of a later pass
    for chains in reversed(passes):
        known = materialize(known, "cyc-known")
        ends = (chains.join(_key(known, fwd="node", cf="component"), [PID, "fwd"], "left").join(_key(known, bwd="node", cb="component"), [PID, "bwd"], "left"))
        own = F.when(F.col("ring").isNotNull(), F.col("ring")).when(F.col("fwd") == F.col("bwd"), F.coalesce("cf", "fwd")).when(F.col("cf") == F.col("cb"), F.col("cf"))
        mine = ends.select(PID, "node", own.alias("component")).where("component is not null")
        # the one end of a chain that returns to it is in its component, too
        turn = ends.where("ring is null and fwd = bwd and cf is null").select(PID, F.col("fwd").alias("node"), F.col("fwd").alias("component")).distinct()
        known = known.unionByName(mine).unionByName(turn)
    known = materialize(known.distinct(), "cyc-known")
    sizes = known.groupBy(PID, F.col("component").alias("c")).agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
    return (known.join(_key(sizes, component="c", size="size", least="least"), [PID, "component"]).where("size > 1")
            .select(PID, "node", F.col("least").alias("component"), "size"))


def components(edges: DataFrame, small: int | None = None) -> DataFrame:
    """(project_id, node, component, size): the strongly connected components of two classes or more; component is the least name."""
    few, many = split_by_size(edges, SMALL if small is None else small)
    out = _in_tasks(few.where("src <> dst"), _components_of, COMPONENT)
    return out if many is None else out.unionByName(large_components(many))


def cyclic_classes(edges: DataFrame, small: int | None = None) -> DataFrame:
    """D12 (b): (project_id, class_name) of classes that reach themselves."""
    comp = components(edges, small).select(PID, F.col("node").alias("class_name"))
    self_loops = edges.where(F.col("src") == F.col("dst")).select(PID, F.col("src").alias("class_name"))
    return comp.unionByName(self_loops).distinct()


def has_cycle(classes: DataFrame, cyclic: DataFrame) -> DataFrame:
    """D12 (a): per project, whether any cycle exists."""
    c = cyclic.groupBy(PID).agg(F.count(F.lit(1)).alias("cyclic_classes"))
    return (classes.select(PID).distinct().join(c, PID, "left")
            .select(PID, (F.coalesce("cyclic_classes", F.lit(0)) > 0).alias("has_cycle"),
                    F.coalesce("cyclic_classes", F.lit(0)).cast("long").alias("cyclic_classes")))


def component_edges(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """Edges inside one component, without self-edges."""
    c = comp.select(PID, "node", "component")
    return (edges.where("src <> dst").join(_key(c, src="node", cs="component"), [PID, "src"]).join(_key(c, dst="node", cd="component"), [PID, "dst"])
            .where(F.col("cs") == F.col("cd")).select(PID, "src", "dst").distinct())


def _large_evidence(edges: DataFrame) -> DataFrame:
    """(project, class_name, path): level-synchronous breadth-first search from every class inside its component.

    A level keeps one path for each (root, class), the least in name order; a root stops with its first cycle.
    """
    comp = materialize(large_components(edges), "cyc-comp")
    inside = materialize(component_edges(edges, comp), "cyc-inside")
    loops = edges.where("src = dst").select(PID, F.col("src").alias("class_name"), F.array("src", "dst").alias("path"))
    roots = comp.join(_key(loops, node="class_name"), [PID, "node"], "left_anti")
    level = materialize(roots.select(PID, F.col("node").alias("root"), F.col("node").alias("at"), F.array("node").alias("path")), "cyc-level")
    out, seen = loops, level.select(PID, "root", "at")
    while not level.isEmpty():
        step = (level.join(_key(inside, at="src", to="dst"), [PID, "at"])
                .groupBy(PID, "root", "to").agg(F.min("path").alias("path")).select(PID, "root", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path")))
        step = materialize(step, "cyc-step")
        closed = step.where("at = root")
        out = out.unionByName(closed.select(PID, F.col("root").alias("class_name"), "path"))
        level = materialize(step.join(closed.select(PID, "root"), [PID, "root"], "left_anti").join(seen, [PID, "root", "at"], "left_anti"), "cyc-level")
        seen = seen.unionByName(level.select(PID, "root", "at"))
    return out


def cycle_evidence(edges: DataFrame, small: int | None = None) -> DataFrame:
    """D12 (c): (project_id, class_name, cycle, length): one shortest cycle through each cyclic class.

    It starts and ends at the class; of several shortest ones it is the least in name order.
    """
    few, many = split_by_size(edges, SMALL if small is None else small)
    out = _in_tasks(few, _evidence_of, "class_name string, path array<string>")
    if many is not None:
        out = out.unionByName(_large_evidence(many))
    return out.select(PID, "class_name", F.array_join("path", "->").alias("cycle"), (F.size("path") - 1).cast("int").alias("length"))


def simple_cycles(edges: DataFrame, max_length: int | None = None) -> DataFrame:
    """All simple cycles, or those of at most ``max_length`` edges.

    Their number can grow exponentially with a component's size: ask for a length on dense graphs.

    Paths start at a node s and only visit nodes of s's component whose name
    is greater than s, so every cycle is produced once, already rotated to
    its least name. Only nodes on cycles (component size >= 2, or self-edges)
    take part.
    """
    ce = materialize(component_edges(edges, materialize(components(edges), "cyc-comp")), "cyc-ce")
    self_cycles = (edges.where(F.col("src") == F.col("dst"))
                   .select(PID, F.array("src", "dst").alias("path")))
    paths = ce.where(F.col("dst") > F.col("src")).select(
        PID, F.col("src").alias("start"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out = [self_cycles]
    for step in itertools.count(2):
        paths = materialize(paths, "cyc-paths")
        if step - 1 == max_length or paths.isEmpty():
            break
        nxt = paths.join(ce.withColumnRenamed("src", "last"), [PID, "last"])
        closed = nxt.where(F.col("dst") == F.col("start")).select(
            PID, F.concat("path", F.array("dst")).alias("path"))
        out.append(closed)
        paths = nxt.where((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))).select(
            PID, "start", F.col("dst").alias("last"), F.concat("path", F.array("dst")).alias("path"))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res.select(PID, F.array_join("path", "->").alias("cycle"),
                      (F.size("path") - 1).cast("int").alias("length"))
