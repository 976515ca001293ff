"""Small projects solved whole: one shuffle by project, then a stream of projects in each task.

A group of its own in ``applyInPandas`` costs some 6 ms a project; here the projects of a task come one
after the other from the same Arrow batches. A solver gets all rows of one project and must be able to hold them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialize, ship_package

PID = "project_id"
#: Result rows of a batch.
FLUSH = 20_000


def split_by_rows(rows: DataFrame, small: int, name: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows of projects of at most ``small`` rows, rows of the others or None); rows without a project are dropped."""
    rows = rows.where(F.col(PID).isNotNull())
    large = materialize(rows.groupBy(PID).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select(PID), name)
    if large.isEmpty():
        return rows, None
    return rows.join(large, PID, "left_anti"), rows.join(large, PID, "left_semi")


def values_of(column: pa.Array) -> list:
    """Python values; a list becomes a numpy array, or None if it is null or holds a null."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat = column.flatten()
    values, sizes = flat.to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    bad = (holes[ends] > holes[ends - sizes]) | column.is_null().to_numpy(zero_copy_only=False)
    return [None if b else values[e - n:e] for n, e, b in zip(sizes.tolist(), ends.tolist(), bad.tolist())]


def by_project(rows: DataFrame, columns: list[Column], solve: Callable[[list[tuple]], list[tuple]], fields: str) -> DataFrame:
    """``solve`` on the rows (tuples of ``columns``, made after the shuffle) of each project; project_id is put before its results."""
    schema = T.StructType([rows.schema[PID], *T.StructType.fromDDL(fields).fields])
    ship_package(rows.sparkSession)
    kinds = to_arrow_schema(schema)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind.type) for c, kind in zip(zip(*out), kinds)], schema=kinds)

    def run(batches):
        stream = (r for b in batches for r in zip(*(values_of(b.column(i)) for i in range(b.num_columns))))
        out: list[tuple] = []
        for project, group in itertools.groupby(stream, key=lambda r: r[0]):
            out += [(project, *x) for x in solve([r[1:] for r in group])]
            if len(out) > FLUSH:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return rows.repartition(PID).sortWithinPartitions(PID).select(PID, *columns).mapInArrow(run, schema)
