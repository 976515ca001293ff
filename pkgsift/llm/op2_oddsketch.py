"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

1. One pass turns each whole text into its shingle set, a fingerprint of that set, banded
   MinHash keys, and an odd sketch: a bitmap in which each MinHash sample flips a bit. The
   population count of the XOR of two odd sketches tells how many samples differ; at high
   similarity that is a precise estimate of the Jaccard coefficient.
2. Texts with equal sets are one class; its least doc_id stands for it from here on.
   A second bitmap flips a bit per shingle of the whole set. Its XOR count never exceeds the
   symmetric difference of the sets, so a pair it rules out can't be linked: no loss there.
3. In each band bucket every member is paired with the bucket's least member only, so the
   pairs are linear in the bucket. The bitmaps drop pairs below the threshold; the rest are confirmed on the full sets.
4. Buckets whose members now lie in several components are looked at again: members outside
   the least member's component are compared by odd sketch with all members of other components,
   in blocks, and the most similar untested partners are confirmed. The number of partners grows
   fourfold per round until no untested pair is left, so no link is lost to the pairing.
   Links inside a component can't change it and are not tested.

A pair at the very threshold shares no band with probability (1 - 0.75**4)**40 = 2.5e-7;
the sketch filter adds less than 1e-9. Everything found is exact.

Defined results: a null, empty or blank text has no shingles, is linked with nothing, and is its own
component. Rows with a null doc_id take no part in links, get a null component and are kept. Rows
that share a doc_id are taken to be copies of one document, and get one answer. Extra columns are dropped by
the query and kept by the pipeline stage; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GRAM_MULT, LOWER, U64, free_names, gram_hashes, list_column, materialize, mix64, runs, slices, span_hashes, unclash, word_spans
from .components import components

#: Words of a shingle; bands and rows of the MinHash; bits of the odd sketch.
SHINGLE, BANDS, ROWS, SKETCH_BITS = 5, 40, 4, 512
#: Bits of the bitmap of the whole set.
PARITY_BITS = 2048
#: Differing sketch bits up to which a pair is confirmed: 160 samples at 0.75 give 69 +- 9.
MOST_BITS = 140
#: Members per block in step 4, and pivots' copies: members that are confirmed against one pivot in one task.
BLOCK, STAR = 512, 2000
#: Rows of a block: its askers, its members and the pairs already tested.
ASKS, MEMBER, KNOWN = 0, 1, 2
#: Partners per member and component that the first round of step 4 confirms.
FIRST_PARTNERS = 64


def multipliers() -> np.ndarray:
    return mix64(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(GRAM_MULT)) | U64(1)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, cuts): the sorted distinct shingle hashes of row i are hashes[cuts[i]:cuts[i + 1]]."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    words = span_hashes(data, starts, ends)
    grams = gram_hashes(words, SHINGLE)
    out, total = [], 0
    cuts = [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= SHINGLE:
            found = np.unique(grams[a:b - SHINGLE + 1])
        elif b > a:
            found = gram_hashes(words[a:b], b - a)
        else:
            found = grams[:0]
        out.append(found)
        total += len(found)
        cuts.append(total)
    return np.concatenate(out) if out else grams[:0], np.array(cuts)


def signatures(hashes: np.ndarray, cuts: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """MinHash samples of the non-empty rows, one row per sample."""
    begin = cuts[:-1][np.diff(cuts) > 0]
    out = np.empty((len(mult), len(begin)), U64)
    work = np.empty_like(hashes)
    for i, m in enumerate(mult):
        np.multiply(hashes, m, out=work)
        out[i] = np.minimum.reduceat(work, begin) if len(begin) else 0
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One key per band and row; the band's number is part of the key."""
    acc = np.zeros((BANDS, samples.shape[1]), U64) + (np.arange(BANDS, dtype=U64) * U64(GRAM_MULT))[:, None]
    for j in range(ROWS):
        acc = mix64(acc * U64(GRAM_MULT) + samples[j::ROWS])
    return acc


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of each row, as SKETCH_BITS / 64 numbers."""
    n = samples.shape[1]
    bit = mix64(samples + (np.arange(len(samples), dtype=U64) * U64(GRAM_MULT))[:, None])
    return parity(bit.ravel(), np.tile(np.arange(n), len(samples)), n, SKETCH_BITS)


def parity(hashes: np.ndarray, row: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmap of each row: a bit is set if an odd number of the row's hashes fall on it."""
    flips = np.bincount(row * bits + (hashes % U64(bits)).astype(np.int64), minlength=n * bits)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def sketch_pass(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (fingerprint of the set), bands array<long>, odd array<long>, whole array<long>."""
    mult = multipliers()

    def run(batches):
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                hashes, cuts = shingle_sets(data, offs)
                n = np.diff(cuts)
                full = n > 0
                samples = signatures(hashes, cuts, mult)
                sums = [np.concatenate([np.zeros(1, U64), np.cumsum(x)]) for x in (hashes, mix64(hashes ^ U64(GRAM_MULT)))]
                prints = [(s[cuts[1:]] - s[cuts[:-1]]).view(np.int64) for s in sums]
                bands = np.ascontiguousarray(band_keys(samples).T).view(np.int64).ravel()
                at = np.concatenate([[0], np.cumsum(full * BANDS)])
                odd = np.zeros((len(n), SKETCH_BITS // 64), np.int64)
                odd[full] = odd_sketches(samples)
                whole = parity(hashes, np.repeat(np.arange(len(n)), n), len(n), PARITY_BITS)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), list_column(bands, at),
                     *[list_column(x.ravel(), np.arange(len(n) + 1) * x.shape[1]) for x in (odd, whole)]],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "odd", "whole"])

    rows = unclash(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, odd array<long>, whole array<long>")


def near(x: str, y: str):
    """Column: the bitmaps and sizes of two sets (structs n, odd, whole) leave the threshold possible."""
    differ = lambda f: F.aggregate(F.zip_with(f"{x}.{f}", f"{y}.{f}", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    n_x, n_y = F.col(f"{x}.n"), F.col(f"{y}.n")
    # at 3/4 the symmetric difference is a seventh of both sizes together
    return (100 * F.least(n_x, n_y) >= 75 * F.greatest(n_x, n_y)) & (differ("odd") <= MOST_BITS) & (7 * differ("whole") <= n_x + n_y)


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, linked of the pairs (a: the side that repeats), on the full shingle sets.

    The texts of all partners of ``a`` go to its task, and a's own text once per STAR of
    them: the task streams the rows and holds one set of ``a``. A hot ``a`` is
    dealt to several tasks.
    """
    n = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / STAR).cast("int").alias("deals"))
    dealt = pairs.join(n, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"))
    partners = dealt.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "deal", F.col("b").alias("b"), "text")
    own = n.join(texts.withColumnRenamed("doc_id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        key, own_set = None, None
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                hashes, cuts = shingle_sets(data, offs)
                keys = list(zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()))
                out = []
                for i, b in enumerate(piece.column(2).to_pylist()):
                    found = hashes[cuts[i]:cuts[i + 1]]
                    if b is None:
                        key, own_set = keys[i], found
                        continue
                    if key != keys[i]:
                        raise ValueError(f"the text of {keys[i][0]} is missing")
                    at = np.searchsorted(own_set, found)
                    common = int((own_set[np.minimum(at, len(own_set) - 1)] == found).sum())
                    out.append((key[0], b, 100 * common >= 75 * (len(found) + len(own_set) - common)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "linked"])

    both = own.union(partners).repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long, linked boolean")


def unresolved(members: DataFrame, sketches: DataFrame, where: DataFrame, tested: DataFrame, most: int) -> DataFrame:
    """Untested pairs (a, b) across components that the odd sketches leave possible.

    members: key, doc_id, pivot, n; sketches: doc_id, s (struct). Per bucket, member outside the pivot's component
    and other component, at most ``most`` partners, the nearest sketches first.
    """
    comp = where.select(F.col("node").alias("doc_id"), "component")
    m = members.join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    top = comp.select(F.col("doc_id").alias("pivot"), F.col("component").alias("pivot_component"))
    m = m.join(top, "pivot", "left").withColumn("outside", F.col("component") != F.coalesce("pivot_component", "pivot"))
    size = m.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("outside").cast("long")).alias("n_outside")).where("n_outside > 0 and n > 2")
    m = m.join(size.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("n_all"), F.ceil(F.col("n_outside") / BLOCK).cast("int").alias("n_out")), "key")
    deal = lambda n: F.pmod(F.xxhash64("doc_id", "key"), F.col(n)).cast("int")
    # the tested pairs come as rows to the one block that would compare them, never as a list per document
    ways = tested.select("a", "b").union(tested.select("b", "a")).toDF("doc_id", "other")
    asked = m.where("outside").select("key", "doc_id", deal("n_out").alias("i"))
    there = m.select("key", F.col("doc_id").alias("other"), deal("n_all").alias("j"))
    known = ways.join(asked, "doc_id").join(there, ["key", "other"])
    m = m.join(sketches, "doc_id")
    cols = ["doc_id", "component", "s.n", "s.odd", "s.whole"]
    asks = (m.where("outside")
            .select("key", deal("n_out").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(ASKS).alias("kind"), *cols, F.lit(None).cast("long").alias("other")))
    all_ = m.select("key", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), deal("n_all").alias("j"), F.lit(MEMBER).alias("kind"), *cols,
                    F.lit(None).cast("long").alias("other"))
    known = known.select("key", "i", "j", F.lit(KNOWN).alias("kind"), "doc_id",
                         *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in ("component", "n", "odd", "whole")], "other")

    def run(batches):
        for t in runs(batches, 3):
            kind = t.column("kind").to_numpy()
            done = t.filter(pa.array(kind == KNOWN))
            done = np.stack([done.column(c).to_numpy() for c in ("doc_id", "other")])
            done = done[:, np.argsort(done[0], kind="stable")]
            t, asks = t.filter(pa.array(kind != KNOWN)), kind[kind != KNOWN] == ASKS
            ids, comps, n = (t.column(c).to_numpy() for c in ("doc_id", "component", "n"))
            odd, whole = (t.column(c).combine_chunks().flatten().to_numpy().view(U64).reshape(len(ids), -1) for c in ("odd", "whole"))
            other = np.flatnonzero(~asks)
            out = []
            for r in np.flatnonzero(asks).tolist():
                hit = other[(comps[other] != comps[r]) & (100 * np.minimum(n[other], n[r]) >= 75 * np.maximum(n[other], n[r]))]
                hit = hit[np.bitwise_count(odd[hit] ^ odd[r]).sum(axis=1) <= MOST_BITS]
                bits = np.bitwise_count(whole[hit] ^ whole[r]).sum(axis=1)
                ok = 7 * bits.astype(np.int64) <= n[hit] + n[r]
                ok &= ~np.isin(ids[hit], done[1, np.searchsorted(done[0], ids[r]):np.searchsorted(done[0], ids[r], "right")])
                hit, bits = hit[ok], bits[ok]
                if not len(hit):
                    continue
                order = np.lexsort((ids[hit], bits, comps[hit]))
                c = comps[hit][order]
                rank = np.arange(len(c)) - np.searchsorted(c, c)
                out += [(min(x, int(ids[r])), max(x, int(ids[r]))) for x in ids[hit][order][rank < most].tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b"])

    both = asks.union(all_).union(known).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return both.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    rows = materialize(sketch_pass(docs), "sketches")
    real = rows.where("doc_id is not null and n_shingles > 0")
    # equal sets are one class; a partial aggregation, so a class of a third of all rows is a row per task
    several = real.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    of_class = materialize(rows.select("doc_id", "n_shingles", "set_a", "set_b")
                           .join(several, ["set_a", "set_b", "n_shingles"], "left")
                           .select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "classes")
    members = of_class.where("doc_id = rep").select("doc_id").distinct()
    reps = real.join(members, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    exploded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = exploded.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialize(exploded.join(buckets, "key").select("key", "doc_id", "pivot", "n"), "buckets")
    sketches = real.select("doc_id", F.struct(F.col("n_shingles").alias("n"), "odd", "whole").alias("s")).dropDuplicates(["doc_id"])
    pairs = keyed.where("doc_id != pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    pairs = (pairs.join(sketches.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a")
             .join(sketches.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b").where(near("x", "y")))
    pairs = materialize(pairs.select("a", "b"), "pairs")
    involved = keyed.select("doc_id").distinct()
    texts = materialize(unclash(docs, ["doc_id", "text"]).withColumn("doc_id", F.col("doc_id").cast("long"))
                        .join(involved, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")
    tested = materialize(confirm(pairs, texts), "tested")
    where = components(tested.where("linked"))
    wide = keyed.where("n > 2")
    most = FIRST_PARTNERS
    while True:
        more = materialize(unresolved(wide, sketches, where, tested, most), "pairs")
        if more.isEmpty():
            break
        fresh = materialize(confirm(more, texts), "tested")
        tested = tested.union(fresh)
        linked = fresh.where("linked").select("a", "b")
        if not linked.isEmpty():
            where = components(linked.union(where.select("node", "component")))
        most *= 4
    where = where.select(F.col("node").alias("rep"), "component")
    return of_class.join(where, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))


def op2_oddsketch(docs: DataFrame) -> DataFrame:
    """The query: every document's component, and whether it stands for it."""
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document per component, with all columns (rows that repeat a kept doc_id stay)."""
    gone_id, = free_names(docs, "gone_id")
    gone = near_duplicates(docs).where("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(gone_id), "left_anti")
