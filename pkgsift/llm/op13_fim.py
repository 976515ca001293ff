"""Fill-in-middle transformation: cuts at unit boundaries, found in a roaring-style set.

The units of a text are runs of ASCII letters and single other characters. The ends of all units
of a slice of texts form one sorted set of byte positions, held in containers of 2**16
positions: an array of the low halves, a bitmap, or runs, whichever is smallest, with the
cumulative cardinality before each. A cut after t units is a ``select``: a search of the
cumulative cardinalities names the container, a local select in it the position. Both
cuts of every text of a slice are selected at once.

A document's draws come from a hash of its id, so they don't depend on partitions or retries.
Rows are independent: no shuffle, and memory is bounded by a slice of texts (or one longer text).

Defined results: a null text counts as empty; an empty text, and one that holds a marker, stays
plain. A null doc_id hashes as the empty string. Repeated rows and ties get equal results.
``transform`` keeps all input columns, also those named like its own (which are replaced); the
query drops the others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, unclash

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
#: Percent of texts that are cut at all, percent of those in suffix-prefix-middle order, seed of the draws.
CUT_PERCENT, SPM_PERCENT, SEED = 90, 20, 1

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


class ArrayContainer:
    """Sorted low halves."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, rank: np.ndarray) -> np.ndarray:
        return self.low[rank].astype(np.int64)


class BitmapContainer:
    """One bit per low half, in words of 64 with the cumulative number of bits before each."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, rank, "right") - 1
        bits = np.unpackbits(self.words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # the bit that has as many set bits up to it as are asked for within the word
        inner = (np.cumsum(bits, axis=1, dtype=np.int64) <= (rank - self.before[at])[:, None]).sum(axis=1)
        return at * 64 + inner


class RunContainer:
    """Runs of neighbouring low halves, with the cumulative number of positions before each."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray):
        self.starts = starts.astype(np.uint16)
        self.before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])

    def select(self, rank: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.before, rank, "right") - 1
        return self.starts[run].astype(np.int64) + rank - self.before[run]


def container(low: np.ndarray):
    """The smallest form of a sorted set of 16-bit positions: 2 bytes each, 8 KiB, or 4 bytes a run."""
    edge = np.flatnonzero(np.diff(low) != 1) + 1
    starts = np.concatenate([[0], edge])
    costs = {ArrayContainer: 2 * len(low), BitmapContainer: 1 << 13, RunContainer: 4 * len(starts)}
    kind = min(costs, key=costs.get)
    return RunContainer(low[starts], np.diff(np.append(starts, len(low)))) if kind is RunContainer else kind(low)


class BoundarySet:
    """A sorted set of positions that answers ``select(rank)``: the position with so many smaller ones."""

    def __init__(self, positions: np.ndarray):
        high = positions >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts] << 16
        self.before = np.append(starts, len(positions))
        self.containers = [container(positions[a:b] & 0xFFFF) for a, b in zip(self.before[:-1], self.before[1:])]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, rank: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, rank, "right") - 1
        out = np.empty(len(rank), np.int64)
        for c in np.unique(at).tolist():
            here = at == c
            out[here] = self.keys[c] + self.containers[c].select(rank[here] - self.before[c])
        return out


def unit_ends(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions behind the units of all rows: behind a character, unless letters stand on both sides."""
    if not len(data):
        return np.zeros(0, np.int64)
    letter = LETTER[data]
    end = np.ones(len(data), bool)
    end[:-1] = ((data[1:] & 0xC0) != 0x80) & ~(letter[:-1] & letter[1:])
    end[offs[1:][offs[1:] > 0] - 1] = True
    return np.flatnonzero(end) + 1


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4]) for i in (0, 4, 8, 12))


def joined(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    """The output of a cut text in the given order."""
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    if form == "spm":
        return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return prefix + middle + suffix


def restored(form: str, output: bytes) -> bytes:
    """The text of an output. A cut text holds no marker, and markers can't overlap, so the first ones found are the separators."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE, 1)
    first, second = head[3:].split(SUFFIX if form == "psm" else PREFIX, 1)
    prefix, suffix = (first, second) if form == "psm" else (second, first)
    return prefix + middle + suffix


def cut_rows(ids: list, data: np.ndarray, offs: np.ndarray, cut_percent: int, spm_percent: int, seed: int):
    """(n, form, prefix_chars, middle_chars, output) of each row of a slice."""
    raw, ends = data.tobytes(), unit_ends(data, offs)
    base = np.searchsorted(ends, offs, "right")
    n = np.diff(base)
    drawn = np.array([draws(d, seed) for d in ids], np.int64).reshape(-1, 4)
    units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    # a cut after no unit is the start of the text; the set holds the others
    cuts = np.repeat(offs[:-1, None], 2, axis=1)
    later = units > 0
    if later.any():
        cuts[later] = BoundarySet(ends).select((base[:-1, None] + units - 1)[later])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    lens = np.diff(chars[np.column_stack([offs[:-1], cuts])], axis=1).tolist()
    plain = ((n == 0) | (drawn[:, 2] % 100 >= cut_percent)).tolist()
    spm = (drawn[:, 3] % 100 < spm_percent).tolist()
    for i, (lo, (a, b), hi) in enumerate(zip(offs[:-1].tolist(), cuts.tolist(), offs[1:].tolist())):
        if plain[i] or any(raw.find(m, lo, hi) >= 0 for m in MARKERS):
            yield int(n[i]), "plain", None, None, raw[lo:hi]
        else:
            form = "spm" if spm[i] else "psm"
            yield int(n[i]), form, *lens[i], joined(form, raw[lo:a], raw[a:b], raw[b:hi])


def transform(docs: DataFrame, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """All columns of ``docs``, with the transformed ``text`` and n_units, form, prefix_chars, middle_chars."""
    new = {"n_units": "n", "form": "form", "prefix_chars": "prefix_chars", "middle_chars": "middle_chars"}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    source = unclash(docs, ["doc_id", "text"]).columns  # both exist, or are null
    packed = docs.select(row.alias("row"), *[F.col(f"`{c}`").alias(c) if c in docs.columns else F.lit(None).alias(c) for c in source])

    def run(batches):
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                out = list(cut_rows(piece.column(1).to_pylist(), data, offs, cut_percent, spm_percent, seed))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_binary()))]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns[:4], columns[4].cast(pa.large_string()).cast(pa.string())],
                                                 names=["row", "n", "form", "prefix_chars", "middle_chars", "output"])

    row_type = packed.schema["row"].dataType.simpleString()
    done = packed.mapInArrow(run, f"row {row_type}, n long, form string, prefix_chars long, middle_chars long, output string")
    kept = [F.col("output").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns if c not in new]
    return done.select(*kept, *[F.col(c).alias(name) for name, c in new.items()])


def op13_fim(docs: DataFrame, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """The query's digest: units, form, lengths, and the digests of the output and of the text rebuilt from it."""

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                ids = piece.column(0).to_pylist()
                out = [(d, n, form, p, m, sha(o), sha(restored(form, o)))
                       for d, (n, form, p, m, o) in zip(ids, cut_rows(ids, data, offs, cut_percent, spm_percent, seed))]
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=NAMES)

    rows = unclash(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, text, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
