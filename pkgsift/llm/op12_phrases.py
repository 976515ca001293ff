"""Phrase collocations from one FM-index per shard over word ids.

A shard is a bounded slice of texts, cut into pieces and words; its words, told apart by language,
are its alphabet, and a separator stands between pieces. The shard's index is bidirectional:
the Burrows-Wheeler transform of the id sequence and that of the reversed sequence. An interval
of the one is the block of places where a phrase starts, an interval of the other the block where
it ends. Extending a phrase by a word on the left narrows both (the second by the number of smaller
preceding words), and so does one on the right. Phrases are enumerated by such steps up to four
words, each once: words, pairs by a left step, triples by a left step from pairs, and
quadruples by a right step from triples. Counts are summed over the shards.

A phrase that occurs ``least`` times consists of pairs that do. So the first pass counts pairs only,
as 64-bit hashes, and each shard learns which of its pairs are frequent over all shards; the second
pass steps over those only and counts the phrases themselves. A hash that two pairs
share can only let more phrases through, whose exact counts then decide.

Sorting to three symbols suffices for four words: a step needs the order of the phrase it
extends only. A sequence longer than a shard's bound is cut into parts that overlap by three
symbols, and a phrase counts where it starts.

Defined results: a null text is empty, a null language is ``und``. Rows are independent texts: repeated rows
count as often as they occur, and doc_id is not read. Ties are ranked as stated at ``collocations``. Extra
columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GRAM_MULT, LOWER, U64, materialize, mix64, slices, span_hashes, unclash

#: Words of the longest phrase, least count of a phrase, per cent of a phrase's count at which a longer one replaces it, rows per language.
DEPTH, LEAST, INSIDE, TOP = 4, 30, 80, 2000
#: Bytes of text and symbols of a shard (three symbols make one 64-bit sort key: 2**21 at most).
SHARD_BYTES, SHARD_SYMBOLS = 4 << 20, 1 << 20
UND = "und"

BLANK = np.zeros(256, bool)
BLANK[[9, 32]] = True
BREAK = np.zeros(256, bool)
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True

SHARDS = "shard long, langs array<string>, words binary, lang_of binary, ids binary, own int"


def packed(values: np.ndarray) -> bytes:
    """32-bit values by byte planes, compressed: a shard is stored and shuffled once each."""
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def word_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, opens): byte spans of the words, and whether a word opens a piece."""
    breaks = BREAK[data]
    gap = BLANK[data] | breaks
    edge = np.zeros(len(data) + 1, bool)  # a row starts or ends here
    edge[offs] = True
    word = np.concatenate([[False], ~gap, [False]])
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    ends = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    piece = np.cumsum(np.concatenate([[0], breaks])[:-1] + edge[:-1])[starts]
    return starts, ends, np.diff(piece, prepend=-1) != 0


def symbols(data: np.ndarray, offs: np.ndarray, langs: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, list]:
    """(ids, words, lang_of, names): the id sequence with separators 0, and word and language of the ids from 1."""
    starts, ends, opens = word_places(data, offs)
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), []
    gap = BLANK[data] | BREAK[data]
    lens = np.concatenate([[0], np.cumsum(ends - starts)])
    text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(lens.astype(np.int64)), pa.py_buffer(LOWER[data[~gap]])])
    coded = text.dictionary_encode()
    lang = langs.dictionary_encode()
    of_word = lang.indices.to_numpy()[np.searchsorted(offs, starts, "right") - 1].astype(np.int64)
    n_langs = len(lang.dictionary)
    kinds, ids = np.unique(coded.indices.to_numpy().astype(np.int64) * n_langs + of_word, return_inverse=True)
    at = np.arange(len(starts)) + np.cumsum(opens)
    out = np.zeros(at[-1] + 2, np.int64)
    out[at] = ids + 1
    return out, coded.dictionary.take(pa.array(kinds // n_langs)).to_pylist(), kinds % n_langs, lang.dictionary.to_pylist()


def shard_pass(limit: int, most: int):
    """lang, text -> rows of SHARDS."""

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for piece, data, offs in slices(batch, "text", limit):
                ids, words, lang_of, names = symbols(data, offs, piece.column(0))
                for a in range(0, len(ids), most):
                    part = ids[a:a + most + DEPTH - 1]
                    used, local = np.unique(part, return_inverse=True)
                    used = used[used > 0] - 1
                    if not len(used):
                        continue
                    # the separator is 0 whether or not the part has one
                    local = np.where(part > 0, np.searchsorted(used, part - 1) + 1, 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([base + n]), pa.array([names], pa.list_(pa.string())), pa.array([zstandard.ZstdCompressor(level=3).compress(b"\n".join([words[i] for i in used.tolist()]))], pa.binary()),
                         pa.array([packed(lang_of[used])], pa.binary()), pa.array([packed(local)], pa.binary()), pa.array([min(most, len(part))], pa.int32())],
                        names=["shard", "langs", "words", "lang_of", "ids", "own"])
                    n += 1

    return run


class Transform:
    """Burrows-Wheeler transform of a sequence, sorted by three symbols, with the step to the symbol before."""

    def __init__(self, seq: np.ndarray, size: int):
        follow = np.concatenate([seq, np.zeros(DEPTH - 2, np.int64)])
        n = len(seq)
        self.order = np.argsort((follow[:n] * size + follow[1:n + 1]) * size + follow[2:n + 2])
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.before = seq[self.order - 1]  # the sequence starts and ends with a separator
        self.back = place[self.order - 1]


class Intervals:
    """Phrases of one length: their words, and their blocks in both transforms."""

    def __init__(self, words: list[np.ndarray], start: np.ndarray, end: np.ndarray, size: np.ndarray, count: np.ndarray):
        self.words, self.start, self.end, self.size, self.count = words, start, end, size, count

    def where(self, keep: np.ndarray) -> Intervals:
        return Intervals([w[keep] for w in self.words], self.start[keep], self.end[keep], self.size[keep], self.count[keep])


class BidirectionalIndex:
    """FM-index over word ids; the phrases that start in the last ``n - own`` places are another shard's."""

    def __init__(self, ids: np.ndarray, own: int):
        self.alphabet = int(ids.max()) + 1
        self.ids = np.concatenate([[0], ids, [0]])
        self.mine = np.zeros(len(self.ids), np.int64)
        self.mine[1:own + 1] = 1
        self.forward = Transform(self.ids, self.alphabet)
        self._reverse = None

    @property
    def reverse(self) -> Transform:
        if self._reverse is None:
            self._reverse = Transform(self.ids[::-1], self.alphabet)
        return self._reverse

    def singles(self) -> Intervals:
        size = np.bincount(self.ids, minlength=self.alphabet)
        start = np.cumsum(size) - size
        count = np.bincount(self.ids, weights=self.mine, minlength=self.alphabet).astype(np.int64)
        # words are sorted alike in both directions
        return Intervals([np.arange(1, self.alphabet)], start[1:], start[1:], size[1:], count[1:])

    def step(self, t: Transform, lo: np.ndarray, other: np.ndarray, size: np.ndarray, first: np.ndarray):
        """Every symbol that precedes the given blocks: (block, symbol, its block here, its block there, size, count)."""
        total = np.cumsum(size)
        if not len(total):
            return (np.zeros(0, np.int64),) * 6
        offset = total - size
        rows = np.arange(total[-1]) + np.repeat(lo - offset, size)
        key = np.repeat(np.arange(len(lo)) * self.alphabet, size) + t.before[rows]
        by = np.argsort(key)
        key, rows = key[by], rows[by]
        cut = np.flatnonzero(np.diff(key, prepend=-1))
        block, symbol = np.divmod(key[cut], self.alphabet)
        count = np.add.reduceat(self.mine[first[rows]], cut)
        found = block, symbol, np.minimum.reduceat(t.back[rows], cut), other[block] + cut - offset[block], np.diff(np.append(cut, len(key))), count
        words = symbol > 0
        return tuple(x[words] for x in found)

    def left(self, p: Intervals) -> Intervals:
        """All phrases with one more word in front."""
        block, word, start, end, size, count = self.step(self.forward, p.start, p.end, p.size, self.forward.order - 1)
        return Intervals([word] + [w[block] for w in p.words], start, end, size, count)

    def right(self, p: Intervals) -> Intervals:
        """All phrases with one more word behind."""
        t, k = self.reverse, len(p.words)
        block, word, end, start, size, count = self.step(t, p.end, p.start, p.size, len(self.ids) - t.order - k)
        return Intervals([w[block] for w in p.words] + [word], start, end, size, count)


class Shard:
    """The alphabet and the index of a row of SHARDS."""

    def __init__(self, row: dict):
        blob = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["words"]) + b"\n", np.uint8)
        ends = np.flatnonzero(blob == 10)
        starts = np.concatenate([[0], ends[:-1] + 1])
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(starts - np.arange(len(ends)), len(blob) - len(ends))), pa.py_buffer(blob[blob != 10])])
        self.words = text.cast(pa.large_string())
        self.langs = pa.array(row["langs"], pa.string())
        self.lang_of = unpacked(row["lang_of"])
        salt = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in row["langs"]], U64)
        self.hashes = mix64(span_hashes(blob, starts, ends) ^ salt[self.lang_of])
        self.index = BidirectionalIndex(unpacked(row["ids"]).astype(np.int64), row["own"])

    def pair_hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64(self.hashes[a - 1] * U64(GRAM_MULT) + self.hashes[b - 1]).view(np.int64)

    def table(self, p: Intervals) -> pa.RecordBatch:
        """lang, size, phrase, n of the phrases that start here."""
        p = p.where(p.count > 0)
        words = [self.words.take(pa.array(w - 1)) for w in p.words]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())).cast(pa.string()) if len(words) > 1 else words[0].cast(pa.string())
        size = pa.array(np.full(len(p.count), len(words), np.int32))
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang_of[p.words[0] - 1])), size, phrase, pa.array(p.count)], names=["lang", "size", "phrase", "n"])


def rows_of(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() if name != "frequent" else batch.column(j)[i] for j, name in enumerate(batch.schema.names)}


def pair_pass(batches):
    """Shards -> shard, pair (hash), n of its pairs."""
    for row in rows_of(batches):
        s = Shard(row)
        # pairs that start in the overlap only count 0, but a longer phrase may hold them
        p = s.index.left(s.index.singles())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p.count), row["shard"], np.int64)), pa.array(s.pair_hashes(*p.words)), pa.array(p.count)], names=["shard", "pair", "n"])


def phrase_pass(batches):
    """Shards with their frequent pairs -> lang, size, phrase, n of words, and of longer phrases of frequent pairs."""
    for row in rows_of(batches):
        s = Shard(row)
        frequent = np.sort(row["frequent"].values.to_numpy()) if row["frequent"].is_valid else np.zeros(0, np.int64)

        def known(a, b):
            h = s.pair_hashes(a, b)
            return frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h if len(frequent) else np.zeros(len(h), bool)

        singles = s.index.singles()
        yield s.table(singles)
        pairs = s.index.left(singles)
        pairs = pairs.where(known(*pairs.words))
        yield s.table(pairs)
        triples = s.index.left(pairs)
        triples = triples.where(known(*triples.words[:2]))
        yield s.table(triples)
        quads = s.index.right(triples)
        yield s.table(quads.where(known(*quads.words[2:])))


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_bytes: int = SHARD_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """lang, size, phrase, n: all words, and the phrases of 2 to DEPTH words that occur ``least`` times in their language."""
    texts = unclash(docs, ["lang", "text"]).select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), "text")
    shards = materialize(texts.mapInArrow(shard_pass(shard_bytes, shard_symbols), SHARDS), "shards")
    pairs = shards.mapInArrow(pair_pass, "shard long, pair long, n long")
    frequent = pairs.withColumn("total", F.sum("n").over(Window.partitionBy("pair"))).where(F.col("total") >= least)
    # a shard's own pairs: bounded by its symbols
    frequent = frequent.groupBy("shard").agg(F.collect_list("pair").alias("frequent"))
    found = shards.join(frequent, "shard", "left").mapInArrow(phrase_pass, "lang string, size int, phrase string, n long")
    return found.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n")).where((F.col("size") == 1) | (F.col("n") >= least))


def collocations(counts: DataFrame, least: int = LEAST, inside: int = INSIDE) -> DataFrame:
    """lang, phrase, a, l, r, cut, score, left_n, right_n of all phrases of two words or more.

    The cut has the least score, then the fewest words before it. left_n and right_n are the counts of the
    most frequent phrase with one more word in front and behind (null: none is frequent); ``held`` says that one of
    them reaches ``inside`` per cent of a. A phrase two words longer needs no look: the one between is as frequent.
    """
    often = counts.where(F.col("n") >= least)
    phrases = often.where("size > 1").select("lang", "size", "phrase", F.col("n").alias("a"))
    cuts = phrases.withColumn("cut", F.explode(F.expr("sequence(1, size - 1)")))
    cuts = cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - size)").alias("rest"))
    part = lambda name, n: often.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    # products and sums may pass 64 bits
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(19, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("x")).select("lang", "phrase", "x.*")
    longer = phrases.where("size > 2").select("lang", "a", F.inline(F.expr(
        "array(struct(substring_index(phrase, ' ', size - 1) as phrase, false as front), struct(substring_index(phrase, ' ', 1 - size) as phrase, true as front))")))
    side = lambda front, name: F.max(F.when(F.col("front") == F.lit(front), F.col("a"))).alias(name)
    extended = longer.groupBy("lang", "phrase").agg(side(True, "left_n"), side(False, "right_n"))
    wide = lambda c, k: F.col(c).cast("decimal(19, 0)") * F.lit(k).cast("decimal(3, 0)")
    rows = best.join(extended, ["lang", "phrase"], "left")
    most = F.coalesce(F.greatest("left_n", "right_n"), F.lit(0).cast("long"))
    return rows.withColumn("most", most).withColumn("held", wide("most", 100) >= wide("a", inside)).drop("most")


def op12_phrases(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, top: int = TOP, **bounds) -> DataFrame:
    """The query's digest: each language's first phrases by score, count and phrase."""
    counts = materialize(phrase_counts(docs, least, **bounds), "phrases")
    totals = counts.where("size = 1").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc())
    ranked = collocations(counts, least, inside).where("not held").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, F.col("lang") == F.col("of")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
s AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\f\r]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM s),
g AS (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
o AS (SELECT * FROM f WHERE n >= 30),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM o WHERE k > 1),
u AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.lang, u.phrase, u.a, cut, p.n AS l, q.n AS r, (2000000::HUGEINT * a) // (p.n::HUGEINT + q.n) AS score FROM u
      JOIN o p ON p.lang = u.lang AND p.phrase = array_to_string(w[1:cut], ' ') JOIN o q ON q.lang = u.lang AND q.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS i FROM x),
e AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(w[1:k - 1], ' ') AS phrase FROM c WHERE k > 2
      UNION ALL SELECT lang, a, array_to_string(w[2:], ' ') FROM c WHERE k > 2) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
      FROM b LEFT JOIN e USING (lang, phrase) WHERE i = 1 AND 100::HUGEINT * coalesce(most, 0) < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, t.n, score::BIGINT AS score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""
