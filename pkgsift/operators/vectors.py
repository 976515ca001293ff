"""Class vectors and similarities (M1-M8).

* M1 builds the semantic text of a class with built-in string functions.
* M2/M3 encode texts: any batch encoder as an Arrow ``pandas_udf`` (model
  loaded once per task), or the default deterministic hashing encoder
  (signed feature hashing by md5 + L2 norm, in Arrow batches). Given vector tables work too.
* M6/M7 are cosine folds in double (M6 over Arrow batches, one column at a time). The seven package-type
  vectors are a fixed-size parameter table (checked to hold exactly seven
  rows) and are inlined as literals, so scoring a class needs no join.
* M4 never enumerates all pairs of a project: equal vectors are one group, and exact
  similarities are computed for pairs of groups that share a sign-hash bucket, with the
  number of tables set by the wanted recall; or for given pairs (M7 over dependency edges).
  ``neighbours.py`` has the exact pairs and the k nearest.
* M5, k-means per project, is in ``clusters.py``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.vec import cosine
from ..session import materialize, ship_package
from . import neighbours
from .clusters import kmeans
from .neighbours import exact_pairs, small_project_pairs, vector_groups, with_cosine
from .projects import split_by_rows

PID = "project_id"
#: Words of the default encoder; tokens whose slot a worker keeps.
TOKEN_RX, KNOWN_TOKENS = re.compile(r"[a-z0-9_]+"), 200_000


# ------------------------------------------------------------------ M1
def semantic_text(classes: DataFrame) -> DataFrame:
    """M1: 'Class name: X Methods: ... Fields: ... Annotations: ... Type: t Content: ...'."""
    def part(label: str, arr: Column, limit: int | None) -> Column:
        items = F.slice(arr, 1, limit) if limit else arr
        return F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(items, " ")))

    text = F.concat_ws(
        " ",
        F.concat(F.lit("Class name: "), F.col("class_name")),
        part("Methods: ", F.col("methods"), C.SEMANTIC_METHODS),
        part("Fields: ", F.col("fields"), C.SEMANTIC_FIELDS),
        part("Annotations: ", F.col("annotations"), None),
        F.concat(F.lit("Type: "), F.col("class_type")),
        F.when(F.col("content_preview") != "", F.concat(F.lit("Content: "), F.col("content_preview"))),
    )
    return classes.select(PID, "relative_path", "class_pos", "class_name", text.alias("semantic_text"))


def type_description_texts(spark) -> DataFrame:
    """M3 input: one description text per package type (fixed 7 rows)."""
    rows = [(t, i, C.TYPE_DESCRIPTION_TEMPLATE.format(type=t, keywords=" ".join(kws)))
            for i, (t, kws) in enumerate(C.TYPE_DESCRIPTION_KEYWORDS)]
    return spark.createDataFrame(rows, "package_type string, type_ord int, text string")


# ------------------------------------------------------------------ M2 / M3 encoders
def hashed_slots(num_features: int):
    """An Arrow ``pandas_udf``: the signed counts of a lower-case text's hashed tokens, divided by their length."""
    def slot(token: str) -> int:
        h = hashlib.md5(token.encode()).hexdigest()
        return int(h[:8], 16) % num_features + int(h[8], 16) % 2 * num_features

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            cells: list[int] = []
            for i, text in enumerate(texts):
                base = i * 2 * num_features
                for token in TOKEN_RX.findall(text):
                    at = known.get(token)
                    if at is None:
                        at = slot(token)
                        if len(known) < KNOWN_TOKENS:
                            known[token] = at
                    cells.append(base + at)
            halves = np.bincount(np.array(cells, np.int64), minlength=len(texts) * 2 * num_features).reshape(-1, 2, num_features)
            sums = (halves[:, 0] - halves[:, 1]).astype(np.float64)
            # whole numbers: exact in any order
            length = np.sqrt((sums * sums).sum(1))
            yield pd.Series(list(sums / np.where(length == 0, 1.0, length)[:, None]))

    return encode


def hashing_encoder(df: DataFrame, text_col: str = "text", num_features: int = 64,
                    out_col: str = "vec") -> DataFrame:
    """Deterministic default encoder: signed feature hashing of the tokens, L2-normalised array<double>.

    The first eight hex digits of a token's md5, as a number modulo ``num_features``, name its dimension;
    an odd ninth digit makes it count -1 instead of 1. Counts are whole numbers, so any engine gets the
    same doubles. A text that is null or has no tokens, or whose tokens cancel out, gets the zero vector.
    A worker keeps the slots of its first KNOWN_TOKENS tokens; others are hashed each time.
    """
    ship_package(df.sparkSession)
    return df.withColumn(out_col, hashed_slots(num_features)(F.coalesce(F.lower(F.col(text_col)), F.lit(""))))


def udf_encoder(make_encoder, dim: int):
    """An Arrow ``pandas_udf`` (iterator form) around a batch text encoder.

    ``make_encoder()`` returns ``encode(list[str]) -> list[list[float]]``; it is
    called once per task (load the model there), then every Arrow batch of
    texts is encoded in one call. A vector of another length than ``dim`` is an error.
    """
    def fit(v) -> list[float]:
        v = [float(x) for x in v]
        if len(v) != dim:
            raise ValueError(f"the encoder gave {len(v)} numbers, not {dim}")
        return v

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = make_encoder()
        for texts in batches:
            yield pd.Series([fit(v) for v in enc(texts.tolist())])

    return encode


def encode_classes(classes: DataFrame, encoder=None) -> DataFrame:
    """M2: class_vec(project_id, class_name, vec) from the semantic text; last row wins."""
    texts = (semantic_text(classes).groupBy(PID, "class_name")
             .agg(F.max_by("semantic_text", F.struct("relative_path", "class_pos")).alias("text")))
    vecs = hashing_encoder(texts) if encoder is None else texts.withColumn("vec", encoder(F.col("text")))
    return vecs.select(PID, "class_name", "vec")


def encode_types(spark, encoder=None) -> DataFrame:
    """M3: type_vec(package_type, type_ord, vec) from the type description texts."""
    t = type_description_texts(spark)
    return hashing_encoder(t) if encoder is None else t.withColumn("vec", encoder(F.col("text")))


# ------------------------------------------------------------------ M6 / M7
def type_vectors_literal(type_vec: DataFrame) -> list[tuple[str, int, list[float]]]:
    """The seven package-type vectors as a bounded parameter list."""
    rows = type_vec.select("package_type", "type_ord", "vec").limit(len(C.TYPE_NAMES) + 1).collect()
    if len(rows) != len(C.TYPE_NAMES):
        raise ValueError(f"expected {len(C.TYPE_NAMES)} package-type vectors, got {len(rows)}")
    return sorted(((r["package_type"], int(r["type_ord"]), [float(x) for x in r["vec"]]) for r in rows),
                  key=lambda x: x[1])


def _py_norm(v: list[float]) -> float:
    """The norm as norm() sums it, left to right."""
    acc = 0.0
    for x in v:
        acc = acc + x * x
    return math.sqrt(acc)


def type_scores(values: np.ndarray, null: np.ndarray, types: list[tuple[str, int, list[float]]]) -> np.ndarray:
    """Cosines (types, rows) of vectors (rows, dim) with the type vectors, summed left to right; 0 for a null component or another length."""
    columns = np.ascontiguousarray(values.T)
    out = np.zeros((len(types), len(values)))

    def fold(other) -> np.ndarray:
        acc = np.zeros(len(values))
        for x, y in zip(columns, other):
            acc += x * y
        return acc

    with np.errstate(all="ignore"):
        length = np.sqrt(fold(columns))
        for i, (_, _, tv) in enumerate(types):
            if len(tv) == len(columns):
                denom = length * _py_norm(tv)
                there = (denom != 0) & ~null
                out[i, there] = (fold(tv) / np.where(denom == 0, 1.0, denom))[there]
    return out


def nearest_type(class_vec: DataFrame, types: list[tuple[str, int, list[float]]]) -> DataFrame:
    """M6: (project_id, class_name, emb_type, emb_score): best cosine, first type wins ties."""
    types = sorted(types, key=lambda t: t[1])

    def run(batches):
        names = pa.array([t for t, _, _ in types])
        for batch in batches:
            vecs = batch.column(2)
            sizes = vecs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = vecs.flatten()
            values, nulls = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
            begin = np.cumsum(sizes) - sizes
            scores = np.zeros((len(types), len(sizes)))
            for dim in {len(tv) for _, _, tv in types}:
                rows = np.flatnonzero(sizes == dim)
                at = begin[rows, None] + np.arange(dim)
                scores[:, rows] = type_scores(values[at], nulls[at].any(1), types)
            # the first of equal scores; a NaN is above all others, as in Spark's order
            best = scores.argmax(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), names.take(pa.array(best)), pa.array(scores[best, np.arange(len(best))])],
                                             names=[PID, "class_name", "emb_type", "emb_score"])

    ship_package(class_vec.sparkSession)
    rows = class_vec.select(PID, "class_name", F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, f"{PID} {dict(rows.dtypes)[PID]}, class_name string, emb_type string, emb_score double")


def pair_similarity(pairs: DataFrame, class_vec: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """M7: cosine of the vectors of two classes for every given pair (0 on a zero norm)."""
    va = class_vec.select(PID, F.col("class_name").alias(a), F.col("vec").alias("_va"))
    vb = class_vec.select(PID, F.col("class_name").alias(b), F.col("vec").alias("_vb"))
    return (pairs.join(va, [PID, a]).join(vb, [PID, b])
            .select(PID, a, b, cosine(F.col("_va"), F.col("_vb")).alias("cosine")))


def pair_similarity_by_id(pairs: DataFrame, class_ids: DataFrame, vectors: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """M7 where classes name their vectors: class_ids (project_id, class_name, vec_id), vectors (vec_id, vec).

    The rows of :func:`pair_similarity`, but the pairs find their classes by narrow rows and take the vectors last.
    """
    ia = class_ids.select(PID, F.col("class_name").alias(a), F.col("vec_id").alias("_ia"))
    ib = class_ids.select(PID, F.col("class_name").alias(b), F.col("vec_id").alias("_ib"))
    va, vb = (vectors.select(F.col("vec_id").alias(i), F.col("vec").alias(v)) for i, v in (("_ia", "_va"), ("_ib", "_vb")))
    return (pairs.join(ia, [PID, a]).join(ib, [PID, b]).join(va, "_ia").join(vb, "_ib")
            .select(PID, a, b, cosine(F.col("_va"), F.col("_vb")).alias("cosine")))


# ------------------------------------------------------------------ M4
def sign_tables(threshold: float, recall: float, bits: int) -> int:
    """Tables of ``bits`` sign bits, so that a pair at the threshold shares a bucket with probability ``recall``."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return math.ceil(math.log(1 - recall) / math.log(1 - same))


def sign_keys(vectors: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """Adds ``keys``: per table, the side of ``bits`` seeded random planes on which the vector lies."""
    import numpy as np

    def run(batches):
        planes = {}
        for pdf in batches:
            dims = pdf["vec"].map(len)
            keys = pd.Series([None] * len(pdf), index=pdf.index, dtype=object)
            for dim, rows in pdf["vec"].groupby(dims):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))
                side = (np.stack(rows.to_list()) @ planes[dim] > 0).reshape(len(rows), tables, bits)
                keys[rows.index] = pd.Series(list(side @ (1 << np.arange(bits))), index=rows.index)
            yield pdf.assign(keys=keys)

    ship_package(vectors.sparkSession)
    names = ", ".join(f"{n} {t}" for n, t in vectors.dtypes)
    return vectors.mapInPandas(run, f"{names}, keys array<long>")


def similar_pairs(class_vec: DataFrame, threshold: float = 0.9, recall: float = 0.999, bits: int = 12,
                  seed: int = C.KMEANS_SEED) -> DataFrame:
    """M4: (project_id, a, b, cosine, kind) of classes of one project with cosine >= threshold.

    Classes with equal vectors are a group, named by its least class name a: each other member
    b is a row of kind ``copy``. Rows of kind ``pair`` (a < b) are pairs of group names; their
    members are as similar. So nothing is lost, and equal vectors don't give all their pairs.

    A project of at most BLOCK classes is compared whole in a task and misses no pair. In a larger one,
    candidates share a bucket of sign bits in some table: a pair of groups at the threshold is found with
    probability ``recall``, a closer one with more; the exact cosine decides. Candidates carry names
    only; the vectors join what is left after duplicates are dropped. Vectors that are null, empty or zero have no pairs.
    """
    few, many = split_by_rows(class_vec, neighbours.BLOCK, "vec-large")
    out = small_project_pairs(few, threshold)
    return out if many is None else out.unionByName(large_similar_pairs(many, threshold, recall, bits, seed))


def large_similar_pairs(class_vec: DataFrame, threshold: float, recall: float, bits: int, seed: int) -> DataFrame:
    groups, copies = vector_groups(class_vec)
    keyed = sign_keys(groups, sign_tables(threshold, recall, bits), bits, seed).select(
        PID, "a", F.size("vec").alias("dim"), F.posexplode("keys").alias("tbl", "bucket"))
    keyed = materialize(keyed, "vec-keys")
    other = keyed.withColumnRenamed("a", "b")
    cand = keyed.join(other, [PID, "dim", "tbl", "bucket"]).where(F.col("a") < F.col("b")).select(PID, "a", "b").distinct()
    pairs = with_cosine(cand, groups).withColumn("kind", F.lit("pair"))
    return pairs.unionByName(copies).where(F.col("cosine") >= F.lit(threshold))


# ------------------------------------------------------------------ M8
def compute_embeddings(classes: DataFrame, encoder=None, threshold: float = 0.9, exact: bool = False) -> dict[str, DataFrame]:
    """M8: the embedding bundle: class vectors, type vectors, similar pairs, clusters.

    ``exact`` misses no similar pair; otherwise they are found with the recall of :func:`similar_pairs`.
    """
    cv = materialize(encode_classes(classes, encoder), "class-vec")
    tv = encode_types(classes.sparkSession, encoder)
    assignments, centres = kmeans(cv)
    return {"class_embeddings": cv, "package_type_embeddings": tv,
            "similar_pairs": exact_pairs(cv, threshold) if exact else similar_pairs(cv, threshold), "clusters": assignments,
            "cluster_centers": centres}
