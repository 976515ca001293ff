"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A text is cut at the vocabulary's split pattern, each piece is written in the byte-to-
character alphabet of byte-level BPE and merged by the library's BPE model. Pieces repeat,
so each worker keeps a bounded table from the hash of a piece to its ids; pieces that it
doesn't hold go through the library. Texts of ASCII and Latin letters are cut for a whole
batch at once from byte classes; any other text is cut by the pattern itself. Engines
differ on code points that Unicode 15.1 leaves unassigned (17,480 here); a text that holds one
is cut by the library's own pattern splitter.

Decoding reverses the byte table: an id stands for bytes, and only the joined bytes of a
document are text, so characters that a merge or a byte fallback splits over two ids are
whole again. Offsets are given in bytes and in characters; an id that holds a part of a
character spans that whole character.

Defined results: a null text counts as empty and has no ids; texts are encoded whole, row by
row, so repeated rows, ties and extra columns change nothing. Bytes that are not valid UTF-8
survive ``decode_bytes`` and become U+FFFD in ``decode_text``. An id outside the vocabulary
raises an error.
"""

from __future__ import annotations

import base64
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import U64, list_column, slices, span_hashes, unclash

#: Entries of a worker's piece table; it is emptied when its ids reach POOL_IDS.
TABLE_BITS = 21
POOL_IDS = 1 << 23

SPACE, BLANK, LETTER, DIGIT, OTHER = 0, 1, 2, 3, 4
#: Class of each byte in texts of ASCII and two-byte Latin letters; SPACE and BLANK are white space.
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13]] = SPACE
CLASS[32] = BLANK
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER
#: Bytes of ASCII and of the lead bytes C3-C8 (U+00C0 to U+023F); U+00D7 and U+00F7 are no letters.
SIMPLE = np.zeros(256, bool)
SIMPLE[:0xC0] = SIMPLE[0xC3:0xC9] = True
#: Ends of contractions after an apostrophe, from the split pattern.
SHORT_ENDS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def byte_alphabet() -> dict[int, str]:
    """Byte to character: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


ALPHABET = byte_alphabet()
TO_CHARS = str.maketrans({chr(b): c for b, c in ALPHABET.items()})
CHAR_OF = np.array([ord(ALPHABET[b]) for b in range(256)], "<u2")


def ranks_from_file(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines ``<base64> <rank>``."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


def merges_from_ranks(ranks: dict[bytes, int]) -> list[tuple[str, str]]:
    """The pair that makes each token of more than a byte, in the order of ranks.

    Merging a token's own bytes by all lower ranks must leave two parts; they are its pair.
    """
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) < 2:
            continue
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)))
            if best[0] >= rank:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append(tuple(p.decode("latin-1").translate(TO_CHARS) for p in parts))
    return out


class Vocabulary:
    """A byte-level BPE model as plain data: it travels to the workers and builds its model there."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], whole_pieces: bool, pattern: str, key: str):
        self.vocab, self.merges, self.whole_pieces, self.pattern, self.key = vocab, merges, whole_pieces, pattern, key

    @classmethod
    def from_ranks(cls, lines: bytes, pattern: str) -> Vocabulary:
        ranks = ranks_from_file(lines)
        vocab = {t.decode("latin-1").translate(TO_CHARS): r for t, r in ranks.items()}
        # whole_pieces: a piece that is a token is that token, whatever the merges say
        return cls(vocab, merges_from_ranks(ranks), True, pattern, hashlib.sha256(lines + pattern.encode()).hexdigest())

    @classmethod
    def from_json(cls, text: str, pattern: str) -> Vocabulary:
        """From a tokenizer file, if it is plain byte-level BPE: else ValueError."""
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = {"dropout": None, "continuing_subword_prefix": (None, ""), "end_of_word_suffix": (None, ""), "byte_fallback": (False, None)}
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
                or any(model.get(k) not in (v if isinstance(v, tuple) else (v,)) for k, v in plain.items()):
            raise ValueError("not a plain byte-level BPE tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        return cls(model["vocab"], merges, bool(model.get("ignore_merges")), pattern, hashlib.sha256(text.encode()).hexdigest())

    def token_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of all ids."""
        back = {c: b for b, c in ALPHABET.items()}
        by_id = {i: bytes(back[c] for c in t) for t, i in self.vocab.items()}
        top = max(by_id, default=-1) + 1
        sizes = np.array([len(by_id.get(i, b"")) for i in range(top)], np.int64)
        flat = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(top)), np.uint8)
        return flat, np.concatenate([[0], np.cumsum(sizes)])


class Codec:
    """One worker's model with its table of pieces."""

    def __init__(self, v: Vocabulary):
        import regex
        from tokenizers import Regex, models, pre_tokenizers

        self.model = models.BPE(vocab=v.vocab, merges=v.merges, ignore_merges=v.whole_pieces, cache_capacity=0)
        self.split = regex.compile(v.pattern)
        self.splitter = pre_tokenizers.Split(Regex(v.pattern), "isolated")
        self.flat, self.offs = v.token_bytes()
        self.known = {i for i in v.vocab.values()}
        self.clear()

    def clear(self) -> None:
        n = 1 << TABLE_BITS
        self.slot_hash, self.slot_at, self.slot_len = np.zeros(n, U64), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used = np.zeros(POOL_IDS, np.int32), 0

    def ids_of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece)."""
        h = span_hashes(data, starts, ends) | U64(1)
        slot = (h >> U64(64 - TABLE_BITS)).astype(np.int64)
        at, n = self.slot_at[slot], self.slot_len[slot]
        miss = np.flatnonzero(self.slot_hash[slot] != h)
        extra = np.zeros(0, np.int32)
        if len(miss):
            kinds, index, back = np.unique(h[miss], return_index=True, return_inverse=True)
            chars, where = CHAR_OF[data].tobytes().decode("utf-16-le"), miss[index]  # one character per byte
            merge = self.model.tokenize
            found = [[t.id for t in merge(chars[s:e])] for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            sizes = np.array([len(f) for f in found], np.int32)
            extra = np.array([i for f in found for i in f], np.int32)
            if self.used + len(extra) > len(self.pool):  # what is in the table is needed below, so only then emptied
                hit = np.ones(len(h), bool)
                hit[miss] = False
                kept, old_at, old_n = self.pool, at, n
                self.clear()
                out_at, out_n = old_at.astype(np.int64), old_n.copy()
                base = len(kept)
                pool = np.concatenate([kept, extra])
                out_at[miss], out_n[miss] = base + (np.cumsum(sizes, dtype=np.int64) - sizes)[back], sizes[back]
                if len(extra) <= len(self.pool):
                    self.store(kinds, sizes, extra)
                return ragged(pool, out_at, out_n), out_n
            begin = self.store(kinds, sizes, extra)
            at[miss], n[miss] = begin[back], sizes[back]
        return ragged(self.pool, at, n), n

    def store(self, kinds: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        begin = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        slot = (kinds >> U64(64 - TABLE_BITS)).astype(np.int64)
        self.slot_hash[slot], self.slot_at[slot], self.slot_len[slot] = kinds, begin, sizes
        order = self.slot_hash[slot] == kinds  # of two kinds in one slot, all three columns must be of the same
        self.slot_at[slot[order]], self.slot_len[slot[order]] = begin[order], sizes[order]
        return begin

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts in ``data``."""
        starts, ends, first = self.pieces(data, offs)
        ids, n = self.ids_of(data, starts, ends)
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return ids, total[first]

    def pieces(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): spans of the pattern's matches; row i has first[i] .. first[i + 1]."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
        begin = piece_starts(data, offs)
        odd = ~SIMPLE[data]
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        if odd.any():
            rows = np.unique(np.searchsorted(offs, np.flatnonzero(odd), "right") - 1)
            for r in rows.tolist():
                a, b = int(offs[r]), int(offs[r + 1])
                begin[a:b] = False
                text = data[a:b].tobytes().decode("utf-8", "surrogateescape")
                sizes = np.fromiter((len(m.encode("utf-8", "surrogateescape")) for m in self.cuts(text)), np.int64)
                if sizes.sum() != b - a:
                    raise ValueError("the split pattern doesn't cover the whole text")
                begin[a + np.cumsum(sizes) - sizes] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offs)

    def cuts(self, text: str) -> list[str]:
        """The pattern's matches in a row; the library's splitter takes seven times as long, so it cuts only what the engines may differ on."""
        kinds = {unicodedata.category(c) for c in set(text)}
        if "Cn" in kinds and "Cs" not in kinds:  # the library takes valid UTF-8 only
            return [m for m, _ in self.splitter.pre_tokenize_str(text)]
        return self.split.findall(text)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the documents whose ids are given."""
        if len(ids) and not (0 <= int(ids.min()) and int(ids.max()) < len(self.offs) - 1):
            raise ValueError("an id is outside the vocabulary")
        sizes = (self.offs[1:] - self.offs[:-1])[ids]
        if len(ids) and not sizes.all() and not self.known.issuperset(ids[sizes == 0].tolist()):
            raise ValueError("an id is outside the vocabulary")
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ragged(self.flat, self.offs[:-1][ids], sizes), total[offs]


def ragged(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """pool[at[0]:at[0] + n[0]], pool[at[1]:at[1] + n[1]], ... in a row."""
    end = np.cumsum(n, dtype=np.int64)
    if not len(end) or not end[-1]:
        return pool[:0]
    return pool[np.arange(end[-1]) + np.repeat(at - (end - n), n)]


def piece_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the split pattern's matches begin, for rows of SIMPLE bytes.

    A match is a run of letters, digits or other characters with one blank before it if there
    is one; the last white space before such a run stands alone unless it is that blank; the
    white space before that, or at a text's end, is one match. An apostrophe that begins a match
    and is followed by a short ending is a match with it.
    """
    cls = CLASS[data]
    group = cls.copy()
    group[cls == BLANK] = SPACE
    heads = offs[:-1][offs[:-1] < offs[1:]]
    head = np.zeros(len(data) + 3, bool)
    head[heads] = True
    head[len(data):] = True
    begin = np.empty(len(data), bool)
    begin[0] = True
    begin[1:] = group[1:] != group[:-1]
    after = np.flatnonzero(begin & (group != SPACE) & ~head[:len(data)])
    after = after[group[after - 1] == SPACE]  # a run that follows white space of its own text
    begin[after - 1] = True
    begin[after[data[after - 1] == 32]] = False
    begin[heads] = True
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        for end in SHORT_ENDS:
            hit = quote
            for j, c in enumerate(end):
                hit = hit[(padded[hit + 1 + j] == c) & ~head[hit + 1 + j]]
            begin[hit + 1] = False
            stop = hit + 1 + len(end)
            begin[stop[stop < len(data)]] = True
    return begin


_CODECS: dict[str, Codec] = {}


def codec(v: Vocabulary) -> Codec:
    """The worker's codec of this vocabulary (kept between tasks)."""
    if v.key not in _CODECS:
        _CODECS.clear()
        _CODECS[v.key] = Codec(v)
    return _CODECS[v.key]


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """From a rank file (``*.tiktoken``) or a tokenizer file (``*.json``)."""
    if path.endswith(".json"):
        return Vocabulary.from_json(Path(path).read_text(encoding="utf-8"), pattern)
    return Vocabulary.from_ranks(Path(path).read_bytes(), pattern)


def encode(docs: DataFrame, vocabulary: Vocabulary, offsets: bool = False) -> DataFrame:
    """doc_id, ids array<int>; with ``offsets`` also byte_start, byte_end, char_start, char_end of each id."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a few MB, of the vocabulary's fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                ids, at = c.encode(data, offs)
                cols, names = [piece.column(0), list_column(ids, at)], ["doc_id", "ids"]
                if offsets:
                    for name, x in id_offsets(c, data, offs, ids, at).items():
                        cols.append(list_column(x.astype(np.int64), at))
                        names.append(name)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    spans = "".join(f", {n} array<bigint>" for n in ("byte_start", "byte_end", "char_start", "char_end")) if offsets else ""
    rows = unclash(docs, ["doc_id", "text"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>{spans}")


def id_offsets(c: Codec, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Offsets of each id in its own text, in bytes and in characters (end exclusive)."""
    sizes = (c.offs[1:] - c.offs[:-1])[ids]
    end = np.cumsum(sizes)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    is_head = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(is_head)])  # characters that begin before a byte
    base = chars[offs[:-1]][row]
    start = end - sizes
    # the character that holds the first byte began before it if that byte is a later part
    char_start = chars[np.minimum(start + 1, len(data))] - 1
    return {"byte_start": start - offs[:-1][row], "byte_end": end - offs[:-1][row], "char_start": char_start - base, "char_end": chars[end] - base}


def decode_bytes(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids -> doc_id, bytes binary."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            col = batch.column(1)
            col = col.fill_null([]) if col.null_count else col
            at = col.offsets.to_numpy().astype(np.int64)
            ids = col.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]]
            data, offs = c.decode(ids, at - at[0])
            raw = data.tobytes()
            out = [raw[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, bytes binary")


def decode_text(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ids -> doc_id, text; bytes that are not UTF-8 (cut characters) become U+FFFD."""
    from pyspark.sql import functions as F

    return decode_bytes(rows, vocabulary).select("doc_id", F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"))


def digests(docs: DataFrame, vocabulary: Vocabulary, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids): encodes and decodes in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for piece, data, offs in slices(batch, "text"):
                ids, at = c.encode(data, offs)
                back, cut = c.decode(ids, at)
                flat, raw = memoryview(ids.astype("<u4").tobytes()), memoryview(back.tobytes())
                sha = lambda x, o, w: [hashlib.sha256(x[a * w:b * w]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(np.diff(at)), pa.array(sha(flat, at, 4)), pa.array(sha(raw, cut, 1)), *[list_column(ids, at)] * with_ids],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    rows = unclash(docs, ["doc_id", "text"])
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def op6_bpe(docs: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """The query's digest, by the ranks of the public 50k vocabulary."""
    return digests(docs, vocabulary or default_vocabulary(docs.sparkSession))


def default_vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    import public_tokenizers

    return read_vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN)
