"""Helpers shared by the training-data operators.

Everything here works on one Arrow batch inside a task: text columns as flat
UTF-8 bytes with offsets, vectorised word spans, 64-bit hashes of byte spans and
the selection of window anchors. Spark does the partitioning and the shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, read_table  # noqa: F401  (re-used by the operators)

U64 = np.uint64
#: Bytes of text that one vectorised step handles (the temporaries are about 40 times as large).
STEP_BYTES = 1 << 20
#: Odd multipliers of the span hash and of the n-gram hash.
MULT = 0x9E3779B97F4A7C15
GRAM_MULT = 0xD6E8FEB86659FD93

#: ASCII white space, the separators of a word ``[^\x20\x09-\x0D]+``.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def as_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if len(column) == 0 or offs[-1] == offs[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of ``batch`` with at most ``limit`` bytes of text, or one row, each."""
    data, offs = as_utf8(batch.column(batch.schema.get_field_index(column)))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a), data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words; row i has words first[i] .. first[i + 1]."""
    if not len(data):
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offs), np.int64)
    space = IS_SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    before[offs[:-1][offs[:-1] < len(data)]] = True
    after = np.empty_like(space)
    after[-1], after[:-1] = True, space[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    return starts, np.flatnonzero(~space & after) + 1, np.searchsorted(starts, offs)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift, multiply; wraps around)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=U64) * U64(MULT))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i modulo 2**64 for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, STEP_BYTES + 4096)
        for key, base in (("up", MULT), ("down", pow(MULT, -1, 1 << 64))):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (polynomial with a random value per byte, then mixed).

    Spans are sorted and disjoint; they are hashed in groups that cover about STEP_BYTES.
    """
    out = np.empty(len(starts), dtype=U64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP_BYTES, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum(_BYTE_VALUES[data[lo:hi]] * up[:hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64) * U64(GRAM_MULT)
        a = b
    return mix64(out)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive items of ``h`` (runs over row ends included)."""
    n = max(0, len(h) - k + 1)
    acc = np.zeros(n, dtype=U64)
    for j in range(k):
        acc = acc * U64(GRAM_MULT) + h[j:j + n]
    return mix64(acc)


def window_mask(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """True at each of the n items where a run of k items starts and stays in its row."""
    ok = np.ones(n + 1, dtype=bool)
    for j in range(1, k):  # the last k - 1 items of a row start none
        at = first[1:] - j
        ok[at[at >= first[:-1]]] = False
    ok[n - min(n, k - 1):] = False
    return ok[:n]


def sliding(h: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each run of w items, by doubling."""
    done, cur = 1, h
    while done < w:
        step = min(done, w - done)
        cur = pick(cur[:len(cur) - step], cur[step:])
        done += step
    return cur


def anchors(grams: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions of the grams that are least in some run of w grams (ties included).

    ``ok[i]`` says that the run which starts at i is a window of one row. Equal windows
    choose equal grams at equal offsets, so any two equal windows share an anchor.
    """
    if len(grams) < w:
        return np.zeros(0, np.int64)
    grams = grams | U64(1)
    least = sliding(grams, w, np.minimum)
    least[~ok[:len(least)]] = 0
    pad = np.zeros(w - 1, dtype=U64)
    best = sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    return np.flatnonzero(best == grams)


def unclash(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the needed columns, so that extra columns of any name can't clash; missing ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in needed])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores appended while ``df`` has such a column (Spark ignores case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        out.append(name)
    return out


def parts_for(spark: SparkSession, total: int, target: int, least: int = 1) -> int:
    """Partitions or shards, so that each gets about ``target`` of ``total``."""
    return max(least, -(-int(total) // target))


def uniform53(*parts):
    """A number in [0, 1) from the md5 of the parts: the same in any SQL engine."""
    text = F.concat_ws(":", *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """The rows of each key (the first n_keys columns) of a stream that is sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        new[0] = last is not None and tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        cuts = np.flatnonzero(new).tolist()
        begin = 0
        for cut in cuts:
            if cut > begin:
                held.append(batch.slice(begin, cut - begin))
            if held:
                yield pa.Table.from_batches(held)
            held, begin = [], cut
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def list_column(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    """values[offs[i]:offs[i + 1]] as the list of row i."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(offs), pa.int32()), pa.array(values))
