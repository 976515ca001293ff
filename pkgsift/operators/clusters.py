"""k-means of the class vectors of every project (M5).

Lloyd's algorithm with ten restarts; k = min(max(2, n // 3), 10). Centres of all restarts
of a project are one small array (10 x 10 x dimensions), so a point meets them in its own
row: nothing is repeated per centre, restart or dimension.

* A project of at most BLOCK points is solved whole in one task: one shuffle, no rounds.
* Larger projects lie in range partitions by (project, hash of the name), so one that holds
  a third of all points is spread over as many tasks as its size asks for. Each round sends
  the centres to the tasks (groups of projects are taken in turn, so that a group's centres
  measure CENTRE_BYTES at most on average) and gets back one partial sum per task, project,
  restart and cluster; points are read where they lie and never shuffled again. Restarts that
  have converged take no part in later rounds.

Every round is a job of its own over stored points, so a lost executor costs at most a round.

Defined results: start centres are the k points with the least seeded hash of their name (ties:
name); a point between equally near centres goes to the smaller number; a cluster that loses all
points keeps its centre; the restart with the least sum of squared distances wins (ties: the
first). Vectors that are null, hold a null or NaN, or are shorter than others of their project
take no part; a project with fewer than two vectors has no clusters. A project that still moves after
``max_iter`` rounds gets its last centres, and ``converged`` is false there; others are not affected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import materialize, ship_package
from .projects import by_project

PID = "project_id"
#: Points of a project that one task solves whole, points of one vectorised step, bytes of centres in one round.
BLOCK, STEP, CENTRE_BYTES = 10_000, 1000, 32 << 20
#: A restart has converged when no update moves its centres by more than this share of their length.
TOLERANCE = 1e-9


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(labels, squared distances), both (restarts, points), of points (points, dim) and centres (restarts, k, dim)."""
    label, best = np.zeros((len(c), len(x)), np.int32), np.full((len(c), len(x)), np.inf)
    for a in range(0, len(x), STEP):
        part, l_, b_ = x[a:a + STEP], label[:, a:a + STEP], best[:, a:a + STEP]
        for j in range(c.shape[1]):
            d2 = ((part[None] - c[:, j, None]) ** 2).sum(-1)
            closer = d2 < b_
            b_[closer], l_[closer] = d2[closer], j
    return label, best


def sums_of(x: np.ndarray, label: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the points, their number) per restart and cluster."""
    member = label[:, None] == np.arange(k)[None, :, None]
    return member.astype(np.float64) @ x, member.sum(2)


def moved(c: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centres, which restarts stand still)."""
    new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], c)
    return new, ((new - c) ** 2).sum((1, 2)) <= TOLERANCE ** 2 * (c ** 2).sum((1, 2))


def solve(x: np.ndarray, c: np.ndarray, max_iter: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(labels, centres, converged) of the best restart."""
    c, still = c.copy(), np.zeros(len(c), bool)
    for _ in range(max_iter):
        on = np.flatnonzero(~still)
        if not len(on):
            break
        label, _ = nearest(x, c[on])
        c[on], still[on] = moved(c[on], *sums_of(x, label, c.shape[1]))
    label, d2 = nearest(x, c)
    run = int(d2.sum(1).argmin())
    return label[run], c[run], bool(still[run])


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def small_projects(points: DataFrame, starts: Column, max_iter: int) -> DataFrame:
    """Of points (project_id, class_name, vec), ``starts`` being the hashes of each: project_id, class_name, cluster_id, center, converged: a row per point (no center) and per centre (no class_name)."""

    def run(rows: list[tuple]) -> list[tuple]:
        dim = max(len(v) for _, v, _ in rows)
        rows = sorted((r for r in rows if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or ""))
        if len(rows) < 2:
            return []
        x, hashes = np.stack([v for _, v, _ in rows]), np.stack([h for _, _, h in rows])
        k = min(max(C.KMEANS_MIN_K, len(rows) // 3), C.KMEANS_MAX_K)
        label, c, still = solve(x, x[np.argsort(hashes, axis=0, kind="stable")[:k].T], max_iter)
        return [(r[0], j, None, still) for r, j in zip(rows, label.tolist())] + [(None, j, v, still) for j, v in enumerate(c.tolist())]

    return by_project(points, [F.col("class_name"), F.col("vec"), starts], run,
                      "class_name string, cluster_id int, center array<double>, converged boolean")


def start_centres(points: DataFrame) -> DataFrame:
    """project_id, run, cid, vec. Names are ranked without their vectors; the literal bound is applied in each task first."""
    ranked = points.select(PID, "class_name", "k", F.posexplode("starts").alias("run", "hash"))
    rank = F.row_number().over(Window.partitionBy(PID, "run").orderBy("hash", "class_name"))
    first = (ranked.withColumn("cid", rank).where(F.col("cid") <= F.lit(C.KMEANS_MAX_K)).where(F.col("cid") <= F.col("k"))
             .select(PID, "class_name", "run", (F.col("cid") - 1).alias("cid")))
    return first.join(points.select(PID, "class_name", "vec"), [PID, "class_name"]).dropDuplicates([PID, "run", "cid"])


def large_projects(points: DataFrame, max_iter: int) -> DataFrame:
    """As small_projects, in rounds over ``points`` (one group of projects, stored)."""
    spark, kind = points.sparkSession, dict(points.dtypes)[PID]
    ship_package(spark)
    centres, still = {}, {}
    for pid, rows in start_centres(points).toPandas().sort_values([PID, "run", "cid"]).groupby(PID):
        flat = matrix(rows["vec"])
        centres[pid] = flat.reshape(rows["run"].nunique(), -1, flat.shape[1])
        still[pid] = np.zeros(len(centres[pid]), bool)

    def sweep(active: dict) -> pd.DataFrame:
        """project_id, run, cid, dim, total, n, cost, summed over all points; dim -1 holds n and cost."""
        shared = spark.sparkContext.broadcast({p: (on, centres[p][on]) for p, on in active.items()})

        def partial(batches):
            held: dict = {}
            for pdf in batches:
                for pid, rows in pdf.groupby(PID, sort=False):
                    if pid not in shared.value:
                        continue
                    c, x = shared.value[pid][1], matrix(rows["vec"])
                    label, d2 = nearest(x, c)
                    total, n = sums_of(x, label, c.shape[1])
                    cost = np.where(label[:, None] == np.arange(c.shape[1])[None, :, None], d2[:, None], 0.0).sum(2)
                    old = held.get(pid, (0, 0, 0))
                    held[pid] = old[0] + total, old[1] + n, old[2] + cost
            for pid, (total, n, cost) in held.items():
                on = shared.value[pid][0]
                r, j = np.indices(n.shape).reshape(2, -1)
                yield pd.DataFrame({PID: [pid] * r.size, "run": on[r].astype(np.int32), "cid": j.astype(np.int32),
                                    "total": total[r, j].tolist(), "n": n[r, j].astype(np.int64), "cost": cost[r, j]})

        part = points.select(PID, "vec").mapInPandas(partial, f"{PID} {kind}, run int, cid int, total array<double>, n long, cost double")
        cells = part.select(PID, "run", "cid", F.posexplode(F.concat("total", F.array(F.col("n").cast("double"), "cost"))).alias("dim", "value"))
        out = cells.groupBy(PID, "run", "cid", "dim").agg(F.sum("value").alias("value")).toPandas()
        shared.unpersist()
        return out.sort_values([PID, "run", "cid", "dim"])

    def tables(active: dict):
        """Per project: (sums, numbers, costs) of its active restarts."""
        for pid, rows in sweep(active).groupby(PID):
            cells = rows["value"].to_numpy().reshape(len(active[pid]), centres[pid].shape[1], -1)
            yield pid, cells[..., :-2], cells[..., -2], cells[..., -1]

    for _ in range(max_iter):
        active = {p: np.flatnonzero(~s) for p, s in still.items() if not s.all()}
        if not active:
            break
        for pid, total, n, _ in tables(active):
            on = active[pid]
            centres[pid][on], still[pid][on] = moved(centres[pid][on], total, n)
    best, rows = {}, []
    for pid, _, _, cost in tables({p: np.arange(len(c)) for p, c in centres.items()}):
        run = int(cost.sum(1).argmin())
        best[pid] = centres[pid][run]
        rows += [(pid, None, j, c.tolist(), bool(still[pid][run])) for j, c in enumerate(best[pid])]
    shared = spark.sparkContext.broadcast(best)

    def assign(batches):
        for pdf in batches:
            for pid, part in pdf.groupby(PID, sort=False):
                label, _ = nearest(matrix(part["vec"]), shared.value[pid][None])
                yield pd.DataFrame({PID: part[PID], "class_name": part["class_name"], "cluster_id": label[0]})

    schema = f"{PID} {kind}, class_name string, cluster_id int"
    labels = points.select(PID, "class_name", "vec").mapInPandas(assign, schema)
    ends = spark.createDataFrame([(p if kind == "string" else int(p), *rest) for p, *rest in rows], schema + ", center array<double>, converged boolean")
    return labels.select("*", F.lit(None).cast("array<double>").alias("center"), F.lit(None).cast("boolean").alias("converged")).unionByName(ends)


def kmeans(class_vec: DataFrame, restarts: int = C.KMEANS_RESTARTS, max_iter: int = 300,
           seed: int = C.KMEANS_SEED) -> tuple[DataFrame, DataFrame]:
    """M5: (assignments(project_id, class_name, cluster_id), centres(project_id, cluster_id, center, converged))."""
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    usable = (class_vec.select(PID, "class_name", F.col("vec").cast("array<double>").alias("vec"))
              .where((F.size("vec") > 0) & whole))
    sizes = usable.groupBy(PID, F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy(PID).agg(F.max(F.struct("dim", "n")).alias("s"), F.sum("n").alias("rows")).select(PID, "s.*", "rows").where("n >= 2")
    k = F.least(F.greatest(F.lit(C.KMEANS_MIN_K), F.floor(F.col("n") / 3).cast("int")), F.lit(C.KMEANS_MAX_K))
    sizes = materialize(sizes.withColumn("k", k), "km-sizes")
    starts = F.array(*[F.xxhash64("class_name", F.lit(r + seed)) for r in range(restarts)])
    large = sizes.where(F.col("n") > BLOCK)
    # with many vectors that are too short, only the others go to the task
    mixed = sizes.where((F.col("n") <= BLOCK) & (F.col("rows") > BLOCK)).select(PID, "dim")
    few, apart = usable.where(F.col(PID).isNotNull()), sizes.where(F.col("rows") > BLOCK).select(PID)
    if not apart.isEmpty():
        few = few.join(apart, PID, "left_anti").unionByName(usable.join(mixed, PID).where(F.size("vec") == F.col("dim")).drop("dim"))
    solved = materialize(small_projects(few, starts, max_iter), "km-small")
    rows, held = large.agg(F.sum("n"), F.sum(F.col("k") * F.col("dim") * 8 * restarts)).first()
    if rows:
        groups = -(-int(held) // CENTRE_BYTES)
        group = F.pmod(F.xxhash64(F.lit(seed), PID), F.lit(groups))
        points = usable.join(large, PID).where(F.size("vec") == F.col("dim")).select(PID, "class_name", "vec", "k", starts.alias("starts"))
        large = points.withColumn("group", group)
        large = materialize(large.repartitionByRange(-(-int(rows) // BLOCK), "group", PID, F.xxhash64("class_name")), "km-points")
        for g in range(groups):
            solved = solved.unionByName(materialize(large_projects(large.where(F.col("group") == g), max_iter), "km-large"))
    return (solved.where("center is null").select(PID, "class_name", "cluster_id"),
            solved.where("center is not null").select(PID, "cluster_id", "center", "converged"))
