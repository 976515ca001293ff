"""The training-data operators against brute force, on fixtures with nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pkgsift.llm import passages
from pkgsift.llm import op1_ordinal, op2_oddsketch, op3_warczst, op4_bwt, op5_tokenfile, op6_bpe, op7_rules, op8_poisson, op9_automaton, op10_maxscore
from pkgsift.session import ship_package

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, component int, gram int"


def corpus(seed=1, n=60):
    """Random texts with exact and near copies, shared passages, junk, nulls and repeated rows."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "naïve", "漢字", "it's", "$$$", "a\x1fb"]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(60)
    out = [text(r.randint(1, 150)) for _ in range(n)]
    out += [text(30) + " " + passage + "\n" + text(25) for _ in range(6)] + [out[3]] * 3
    for base in (text(200), text(120)):  # near copies of every degree
        for k in range(12):
            w = base.split(" ")
            for i in r.sample(range(len(w)), k):
                w[i] = f"x{r.random()}"
            out.append(" ".join(w))
    out += ["", " \t\n", "spam " * 300, "One two three", "one TWO three", text(4000)]
    rows = [(i, t) for i, t in enumerate(out)]
    rows += [(len(rows), None), rows[0], rows[3], (None, text(40))]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rows = [(d, t, f"s{(d or 0) % 3}", "en", len(t or ""), 7, 8) for d, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows):
    return {r.doc_id: tuple(r)[1:] for r in rows}


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components_of(rows):
    sets = {d: shingles(t) for d, t in rows if d is not None}
    comp = {d: d for d in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            changed |= comp[a] != m or comp[b] != m
            comp[a] = comp[b] = m
    return sets, comp


def test_op2_matches_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, comp = components_of(rows)
    assert len(set(comp.values())) < len(comp) - 10
    got = op2_oddsketch.op2_oddsketch(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert op2_oddsketch.op2_oddsketch(empty).count() == 0


def test_op2_second_look_finds_links_that_the_pivot_misses(spark):
    """A chain of near copies: neighbours are linked, the ends are far from the least member."""
    ship_package(spark)
    w = [f"c{i}" for i in range(300)]
    rows = []
    for k in range(30):
        rows.append((k, " ".join(w)))
        for i in range(8 * k, 8 * k + 8):
            w[i] = f"n{i}"
    got = op2_oddsketch.op2_oddsketch(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    _, comp = components_of(rows)
    assert {r.doc_id: r.component_id for r in got} == comp


def test_op2_open_pairs_skip_the_tested_ones_without_lists(spark, monkeypatch):
    """A bucket over many blocks: equal sketches in components of their own, half of the pivot's and some other pairs tested."""
    ship_package(spark)
    monkeypatch.setattr(op2_oddsketch, "BLOCK", 4)
    ids = list(range(20))
    members = spark.createDataFrame([("k", i, 0, 20) for i in ids], "key string, doc_id long, pivot long, n long")
    sketches = spark.createDataFrame([(i, (50, [0] * 4, [0] * 4)) for i in ids], "doc_id long, s struct<n:int,odd:array<long>,whole:array<long>>")
    done = {(0, i) for i in range(1, 11)} | {(3, 7), (5, 19)}
    tested = spark.createDataFrame([(*p, False) for p in done], "a long, b long, linked boolean")
    where = spark.createDataFrame([], "node long, component long")
    got = op2_oddsketch.unresolved(members, sketches, where, tested, 99)
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in ids for b in ids if a < b} - done
    assert "collect_set" not in got._jdf.queryExecution().toString()


@pytest.fixture(params=["shards", "hot"])
def hot(request, monkeypatch):
    """The normal way, and every repeated anchor taken for a hot one, dealt to many shards."""
    if request.param == "hot":
        monkeypatch.setattr(passages, "HOT", 1)
        monkeypatch.setattr(op4_bwt, "HOT", 1)
        monkeypatch.setattr(op4_bwt, "PER_SHARD", 20)
        monkeypatch.setattr(op9_automaton, "PER_SHARD", 20)


def test_op4_matches_brute_force(docs, empty, hot):
    rows = {r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id is not None}
    count = Counter(b[i:i + 200] for b in rows.values() for i in range(len(b) - 199))
    got = by_id(r for r in op4_bwt.op4_bwt(docs).collect() if r.doc_id is not None)
    assert got.keys() == rows.keys()
    for d, b in rows.items():
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i + 1:i + 201] = True
        kept = np.frombuffer(b, np.uint8)[~gone[1:len(b) + 1]].tobytes()
        assert got[d] == (len(b), len(b) - len(kept), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert sum(g[1] for g in got.values()) > 2000 and op4_bwt.op4_bwt(empty).count() == 0


def test_op4_large_shards_are_dealt_by_windows(docs, monkeypatch):
    """With a bound of 500 bytes nearly every shard is dealt anew; the result stays."""
    want = by_id(r for r in op4_bwt.op4_bwt(docs).collect() if r.doc_id is not None)
    monkeypatch.setattr(op4_bwt, "SHARD_BYTES", 500)
    assert by_id(r for r in op4_bwt.op4_bwt(docs).collect() if r.doc_id is not None) == want


@pytest.mark.parametrize("sharers, hot, shard_bytes", [(1200, 100, 1 << 15), (6000, None, None), (19_000, None, None)])
def test_op4_no_shard_outgrows_its_bound(spark, monkeypatch, sharers, hot, shard_bytes):
    """One passage in many different texts: the cut-outs at its edges differ in every text, yet no shard gets more than its bytes."""
    ship_package(spark)
    if hot:
        monkeypatch.setattr(op4_bwt, "HOT", hot)
        monkeypatch.setattr(op4_bwt, "SHARD_BYTES", shard_bytes)
    passage = " ".join(f"p{i}" for i in range(100))
    tail = "substr(repeat(sha2(cast({} as string), 256), 4), 1, 250)"
    df = spark.range(sharers, numPartitions=6).selectExpr("id as doc_id", f"concat({tail.format('id')}, '{passage}', {tail.format('-id - 1')}) as text")
    *_, segments = op4_bwt.shard_segments(df, 200)
    bodies = segments.where("body is not null").select("shard", "body").distinct()
    most = bodies.groupBy("shard").agg(F.sum(F.length("body")).alias("bytes")).agg(F.max("bytes")).first()[0]
    assert most <= 1.5 * op4_bwt.SHARD_BYTES
    if hot:
        rows = {r.doc_id: r.text for r in df.collect()}
        count = Counter(hash(t[i:i + 200]) for t in rows.values() for i in range(len(t) - 199))
        got = {r.doc_id: (r.n_removed, r.n_spans) for r in op4_bwt.op4_bwt(df).collect()}
        for d, t in rows.items():
            at = [i for i in range(len(t) - 199) if count[hash(t[i:i + 200])] > 1]
            assert got[d] == (at[-1] + 200 - at[0], 1) and len(at) == at[-1] - at[0] + 1


def test_op4_near_copies_give_no_row_per_window(spark, monkeypatch):
    """Near copies in shards beyond the bound are dealt by anchors: few rows for each text, the result of brute force."""
    ship_package(spark)
    monkeypatch.setattr(op4_bwt, "SHARD_BYTES", 1 << 15)
    r, rows = random.Random(5), {}
    base = [f"w{i * 7919 % 1000}" for i in range(300)]
    for d in range(150):
        text = list(base)
        for i in r.sample(range(len(text)), 3):
            text[i] = f"x{r.random()}"
        rows[d] = " ".join(text)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(6)
    *_, segments = op4_bwt.shard_segments(df, 200)
    spans = passages.dealt(segments).mapInArrow(op4_bwt.match_pass(200), "doc_id long, start long, end long")
    assert segments.count() <= 100 * len(rows) and spans.count() <= 30 * len(rows)
    assert segments.where("body is not null").select("shard", "body").distinct().groupBy("shard").agg(F.sum(F.length("body")).alias("b")).agg(F.max("b")).first()[0] <= 2 << 15
    count = Counter(t[i:i + 200] for t in rows.values() for i in range(len(t) - 199))
    got = {r.doc_id: r.n_removed for r in op4_bwt.op4_bwt(df).collect()}
    for d, t in rows.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            gone[i:i + 200] |= count[t[i:i + 200]] > 1
        assert got[d] == gone.sum()


def test_op4_merges_spans_by_document():
    got = op4_bwt.merged_spans(np.array([2, 1, 1, 1, 2]), np.array([5, 10, 0, 4, 300]), np.array([9, 12, 4, 6, 301])).to_pydict()
    assert list(zip(*got.values())) == [(1, 0, 6), (1, 10, 12), (2, 5, 9), (2, 300, 301)]
    assert op4_bwt.merged_spans(*[np.zeros(0, np.int64)] * 3).num_rows == 0


def test_op9_matches_brute_force(docs, empty, hot):
    rows = sorted({(r.doc_id, r.text or "") for r in docs.collect() if r.doc_id is not None})
    seen, want = set(), {}
    for d, t in rows:
        w = WORD.findall(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 19):
            gone[i:i + 20] |= tuple(w[i:i + 20]) in seen
            seen.add(tuple(w[i:i + 20]))
        want[d] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    got = by_id(r for r in op9_automaton.op9_automaton(docs).collect() if r.doc_id is not None)
    assert got == want and sum(v[1] for v in want.values()) > 500
    left = {r.doc_id: r for r in op9_automaton.remove_repeats(docs).collect() if r.doc_id is not None}
    assert all(hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest() == want[d][2] for d, r in left.items())
    assert all(want[d][0] == want[d][1] for d in want.keys() - left.keys())
    assert op9_automaton.op9_automaton(empty).count() == 0


def test_op6_round_trip_as_the_rank_library(spark, docs, empty):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = op6_bpe.default_vocabulary(spark)
    r = random.Random(2)
    parts = ["a", " ", "  ", "\n", "'s", "'re", "'x", "1", "é", "×", "\xa0", "漢", "🙂", ".", "\t", " 's", "ñ", "\x85", "<|endoftext|>"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    for x in op6_bpe.encode(df, v, offsets=True).join(df, "doc_id").where("doc_id < 400 and doc_id > 200").collect():
        if x.doc_id < 400 and dict(rows)[x.doc_id] == x.text:
            if enc.encode_ordinary(x.text) == x.ids:
                raw = x.text.encode()
                assert b"".join(raw[a:b] for a, b in zip(x.byte_start, x.byte_end)) == raw
                assert all(c < e <= len(x.text) for c, e in zip(x.char_start, x.char_end))
    for x in op6_bpe.digests(df, v, with_ids=True).join(df, "doc_id").where("doc_id > 200").collect():
        ids = enc.encode_ordinary(dict(rows)[x.doc_id]) if x.doc_id in dict(rows) else None
        assert x.n_tokens == len(x.ids) and x.ids_sha256 == hashlib.sha256(np.array(x.ids, "<u4").tobytes()).hexdigest()
        assert ids is None or x.ids == ids
    back = {x.doc_id: x.text for x in op6_bpe.decode_text(op6_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), v), v).collect()}
    assert back == dict(rows)
    assert op6_bpe.op6_bpe(empty).count() == 0


def test_cuts_agree_with_the_libraries_on_every_code_point(spark):
    """Assigned or not: before a contraction, after a blank and after a digit; also a text of 3 MB that takes each path."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    by_rank = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_file = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}'s {c} 1{c}\n" for c in points[i:i + 2000]) for i in range(0, len(points), 2000)]
    plain = "We don't know  what's 12 é; "
    texts += [plain * 110_000, (plain + "漢字 ") * 90_000, plain * 110_000 + chr(0x558) + "'s"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = by_rank.encode_ordinary_batch(texts, num_threads=4)
    assert want == [e.ids for e in by_file.encode_batch(texts, add_special_tokens=False)]
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json"):
        c = op6_bpe.Codec(op6_bpe.default_vocabulary(spark, name))
        for k in range(len(texts)):
            ids, at = c.encode(data[offs[k]:offs[k + 1]], np.array([0, offs[k + 1] - offs[k]]))
            assert ids.tolist() == want[k] and at.tolist() == [0, len(ids)]


def test_op5_files_hold_every_document(spark, docs, empty, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    path = f"file://{tmp_path}/out"
    got = op5_tokenfile.op5_tokenfile(docs, path).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert len(got) == docs.count() and order[1:] == sorted(order[1:]) and order[0] is None
    some = op5_tokenfile.read(spark, path, wanted=[5, 9]).collect()
    assert {r.doc_id: r.ids for r in some} == {d: t.encode(texts[d], add_special_tokens=False).ids + [2] for d in (5, 9)}
    assert op5_tokenfile.op5_tokenfile(empty).count() == 0


def test_op5_shards_come_in_the_order_of_their_numbers(spark):
    names = [f"file:/x/part-9/shards/part-{i:05d}-abc-c000.txt" for i in (0, 9, 10001, 99999, 100000, 100001, 1000000)]
    rows = spark.createDataFrame([(n,) for n in reversed(names)], "file string")
    assert [r.file for r in rows.orderBy(op5_tokenfile.shard_number(F.col("file"))).collect()] == names


def test_op3_round_trip(spark, tmp_path):
    ship_package(spark)
    pages = [(i, f"http://x/{i}" if i % 4 else None, ["", "<p>same</p>" * 40, f"<p>é {i}</p>", None][i % 4 if i < 40 else 1]) for i in range(60)]
    pages += [pages[7], (None, "u", "<p>same</p>" * 40)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int").repartition(3)
    got = op3_warczst.op3_warczst(df, f"file://{tmp_path}/warc").collect()
    first = {}
    for p, _, h in sorted(pages, key=lambda x: (x[0] is None, x[0])):
        first.setdefault(h or "", p)
    want = Counter((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                    "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""]) for p, _, h in pages)
    assert Counter(map(tuple, got)) == want
    assert op3_warczst.op3_warczst(df.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("spoil", [lambda b: b.replace(b"Content-Length: 1", b"Content-Length: 2", 1), lambda b: b[:-2],
                                   lambda b: b.replace(b"WARC/1.1", b"WARC/9.9"), lambda b: b.replace(b"WARC-Date", b"WARC-Dote"), lambda b: b.replace(b"<p>", b"<q>")])
def test_op3_refuses_broken_records(spoil):
    payload = b"<p>" + b"x" * 100
    good = op3_warczst.build_record(1, "http://x", payload, len(payload), op3_warczst.base32_sha1(payload), None, False, "2024-01-01T00:00:00Z")
    assert op3_warczst.page_row(good)[3] == len(payload)
    with pytest.raises((ValueError, KeyError)):
        op3_warczst.page_row(spoil(good))


def test_op7_ledger_policies_and_ablations(docs, empty):
    rows = op7_rules.ledger(docs)
    for r in rows.join(docs.select("doc_id", "text").distinct(), "doc_id").collect():
        w = WORD.findall(r.text or "")
        c = Counter(zip(w, w[1:], w[2:]))
        hit = {j for i, x in enumerate(zip(w, w[1:], w[2:])) if c[x] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit))
    got = {r.rule: r for r in op7_rules.ablations(rows, op7_rules.STRICT).collect()}
    bits = [r.failures for r in rows.collect()]
    for rule, bit in op7_rules.BIT.items():
        assert got[rule].failing == sum(b & bit > 0 for b in bits) and got[rule].failing_alone == sum(b == bit for b in bits)
    assert op7_rules.op7_rules(empty).count() == 0


def test_op8_counts_follow_the_rates(spark, docs, empty):
    n = 20_000
    big = spark.range(n).selectExpr("id as doc_id", "'0123456789' as text", "if(id % 3 = 0, null, concat('s', id % 3)) as source", "1 as replica")
    got = {r.source: r["count"] for r in op8_poisson.mix(big, {"s1": 3.0, "s2": 1.0}).groupBy("source").count().collect()}
    assert None not in got and abs(got["s1"] - 0.75 * n) < 600 and abs(got["s2"] - 0.25 * n) < 400
    a, b = (sorted((r.doc_id or -1, r.replica) for r in op8_poisson.mix(docs.repartition(k)).collect()) for k in (2, 7))
    assert a == b and op8_poisson.mix(empty).count() == 0


def test_op8_draws_large_rates_whole(spark):
    """Sources of rates 3000 (null) and 60000 next to one of rate 0.33: every draw replayed, replicas without a gap."""
    ship_package(spark)
    rows = [(i, "x" * 1000, "big") for i in range(1800)] + [(5000 + i, "y" * 10, None) for i in range(20)] + [(9000, "z" * 10, "tiny"), (None, "", "none")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = op8_poisson.mix(df).groupBy("doc_id", "source").agg({"replica": "max", "*": "count"}).collect()
    got = {(r.doc_id, r.source): (r["count(1)"], r["max(replica)"]) for r in got}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t)
    n = sum(v > 0 for v in size.values())
    want = {}
    for d, _, s in rows:
        if not size[s]:
            continue
        rate = sum(size.values()) / (n * size[s])
        parts = 1 if rate <= 700 else int(np.ceil(rate / 500))
        p = c = np.exp(-rate / parts)
        cdf = [c]
        for k in range(1, int(rate / parts + 12 * np.sqrt(rate / parts) + 40) + 1):
            p *= rate / parts / k
            c += p
            cdf.append(c)
        u = [int(hashlib.md5(f"20:{d}{f':{k}' if parts > 1 else ''}".encode()).hexdigest()[:13], 16) / 2**52 for k in range(parts)]
        total = int(sum(np.searchsorted(cdf, x, "right") for x in u))
        if total:
            want[d, s] = (total, total - 1)
    assert got == want
    small = [v[0] for (_, s), v in got.items() if s is None]
    assert len(small) == 20 and abs(np.mean(small) / (size["big"] / 600 + 1 / 3 + 1 / 60) - 1) < 0.01 and np.std(small) > 20
    assert abs(got[9000, "tiny"][0] - 60000) < 1500


def test_op10_matches_brute_force(spark):
    ship_package(spark)
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [float("nan")] * 6), (204, [None] * 6), (250, [1.0, 2.0]), (None, [1.0] * 6), rows[50]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows if i is not None and e and all(x is not None and np.isfinite(x) for x in e)}
    want = []
    for q in (i for i in v if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    old = op10_maxscore.SHARD_ROWS, op10_maxscore.QUERY_ROWS
    try:
        for op10_maxscore.SHARD_ROWS, op10_maxscore.QUERY_ROWS in (old, (30, 2)):
            assert sorted(map(tuple, op10_maxscore.op10_maxscore(df).collect())) == sorted(want)
    finally:
        op10_maxscore.SHARD_ROWS, op10_maxscore.QUERY_ROWS = old
    assert op10_maxscore.op10_maxscore(df.limit(0)).count() == 0


def test_op10_keeps_large_components(spark):
    ship_package(spark)
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) * 10 ** r.choice([0, 3, 6]) for _ in range(4)]) for i in range(120)]
    rows += [(150, [9e6, 1.0, 0.0, 0.0]), (151, [1.0, -8.9e6, 0.0, 0.0]), (152, [1e7, 2.0, 0.0, 0.0])]
    v = {i: [int(np.floor(256 * x)) for x in e] for i, e in rows}
    want = []
    for q in (0, 50, 100, 150):
        best = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    make = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, op10_maxscore.op10_maxscore(make(rows)).collect())) == want
    assert any(abs(s) > 1 << 62 for _, _, _, s in want)
    for bad in ([(0, [1e12]), (1, [1e12])], [(0, [1e17]), (1, [1.0])]):
        with pytest.raises(Exception, match="beyond a long"):
            op10_maxscore.op10_maxscore(make(bad)).collect()


def test_op1_held_out_accuracy_and_edges(spark, docs, empty):
    ship_package(spark)
    r = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows, grade = [], {}
    for i in range(1200):
        g = r.choice([0, 1, 2, 2])
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        w = w + ["vile", "nasty"] if g == 0 else [x + "$$$" for x in w] if g == 1 else w
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        grade[i] = g
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g != 1), int(g == 0)) for i, g in grade.items() if i < 900] + [(None, 1, 0), (5, None, 0), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = [x for x in op1_ordinal.op1_ordinal(df, labels).collect() if x.doc_id >= 900]
    assert np.mean([x.kept == (grade[x.doc_id] == 2) for x in got]) > 0.97
    assert all(0 <= x.p_ge_2 <= x.p_ge_1 <= 1 and abs(x.expected_grade - x.p_ge_1 - x.p_ge_2) < 1e-9 for x in got)
    none = op1_ordinal.op1_ordinal(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and all(x.kept for x in none) and op1_ordinal.op1_ordinal(empty, labels).count() == 0


def plain_features(text):
    """The hashed features of one text, word by word and sign by sign."""
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text)]
    hashed = lambda w: int(op1_ordinal.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0])
    keyed = lambda kind, v: int(op1_ordinal.mix64(np.array([(v * op1_ordinal.GRAM_MULT + kind) % 2**64], np.uint64))[0])
    n = max(1, len(words))
    keys = [hashed(w) for w in words]
    signs = Counter(c for c in "".join(words) if "!" <= c <= "~" and not c.isdigit() and not "a" <= c <= "z")
    keys += [keyed(1, ord(c) * 64 + int(np.log2(1 + 64 * k / n))) for c, k in signs.items()]
    keys.append(keyed(2, 10 * sum(a == b for a, b in zip(words, words[1:])) // n))
    keys.append(keyed(3, 10 * len(set(words)) // n))
    return {k >> (64 - op1_ordinal.BITS) for k in keys}


def plain_tails(model, text):
    s = sum(float(model.weights[f]) for f in plain_features(text or ""))
    return [1 / (1 + np.exp(min(700, t - s))) for t in model.thresholds]


def test_op1_gradient_is_that_of_the_loss():
    r = np.random.default_rng(5)
    n, dims = 40, 12
    row, col, grade = np.repeat(np.arange(n), 4), r.integers(0, dims, 4 * n), r.integers(0, 3, n)
    theta = r.normal(0, 0.5, dims + 2)
    value, g = op1_ordinal.loss(theta, row, col, grade, dims, 3)
    cuts = [-np.inf, theta[dims], theta[dims] + np.exp(theta[dims + 1]), np.inf]
    sig = lambda x: 1 / (1 + np.exp(-x))
    plain = 0.5 * op1_ordinal.PENALTY * sum(theta[:dims] ** 2)
    for i in range(n):
        s = sum(theta[c] for c in col[row == i])
        plain -= np.log(sig(cuts[grade[i] + 1] - s) - sig(cuts[grade[i]] - s))
    assert abs(value - plain) < 1e-8
    for k in range(dims + 2):
        step = np.zeros(dims + 2)
        step[k] = 1e-6
        up, down = (op1_ordinal.loss(theta + d, row, col, grade, dims, 3)[0] for d in (step, -step))
        assert abs((up - down) / 2e-6 - g[k]) < 1e-4


def test_op1_scores_match_a_plain_computation(spark, docs):
    ship_package(spark)
    graded = spark.createDataFrame([(i, i % 3) for i in range(80)], "doc_id long, grade int")
    model = op1_ordinal.fit(docs, graded)
    assert np.any(model.weights) and model.thresholds[0] < model.thresholds[1]
    text = {r.doc_id: r.text for r in docs.collect()}
    for x in op1_ordinal.score(docs, model).collect():
        tails = plain_tails(model, text[x.doc_id])
        assert np.allclose([x.p_ge_1, x.p_ge_2], tails, atol=1e-6) and abs(x.expected_grade - sum(tails)) < 1e-5
        assert x.kept == (x.p_ge_2 >= 0.5)


#: Columns of the names that the stages use for themselves.
CLASHING = ["gone_id", "cut_id", "cut_text", "replica", "mix_source", "cdf", "parts", "mix_copies", "mix_key", "component", "key", "digest"]


def plain_pipeline(rows, model, enc):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each copy, stage by stage; rows: (doc_id, text, source), ids not null."""
    rows = [x for x in rows if plain_tails(model, x[1])[1] >= 0.5]
    _, comp = components_of([x[:2] for x in rows])
    rows = sorted((x for x in rows if comp[x[0]] == x[0]), key=lambda x: x[0])
    seen, cut, done = set(), [], {}
    for d, t, s in rows:
        if d in done:  # a repeated row is its document again
            cut.append((d, done[d], s))
            continue
        spans = [m.span() for m in WORD.finditer(t or "")]
        words = [t[a:b] for a, b in spans]
        gone = np.zeros(len(words) + 1, bool)
        for i in range(len(words) - 19):
            gone[i:i + 20] |= tuple(words[i:i + 20]) in seen
            seen.add(tuple(words[i:i + 20]))
        if gone.any():
            out, at = "", 0
            for i, (a, b) in enumerate(spans):
                if gone[i] and not gone[i - 1]:
                    out += t[at:a]
                if gone[i]:
                    at = spans[i + 1][0] if i + 1 < len(spans) else len(t)
            t = out + t[at:]
        done[d] = t
        cut.append((d, t, s))
    cut = [x for x in cut if x[1] is None or WORD.search(x[1]) or dict((a, b) for a, b, _ in rows)[x[0]] == x[1]]
    size = Counter()
    for _, t, s in cut:
        size[s] += len((t or "").encode())
    size = {s: n for s, n in size.items() if n}
    out = Counter()
    for d, t, s in cut:
        if s not in size:
            continue
        rate = size[s] ** 0.5 / sum(n ** 0.5 for n in size.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"20:{d}".encode()).hexdigest()[:13], 16) / 2**52
        k, p = 0, np.exp(-rate)
        c = p
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        ids = enc.encode_ordinary(t or "")
        out[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += k
    return +out


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Every stage recomputed plainly, on documents whose other columns have the stages' own names."""
    import corpus_pipeline as C
    import public_tokenizers as P
    import tiktoken

    r = random.Random(9)
    rows = [x for x in corpus(3, 40) if x[0] is not None]
    rows = [(d, t, r.choice(["web", "web", "web", "books", None])) for d, t in dict(rows).items()]
    bad = [(1000 + i, " ".join([r.choice(["vile", "nasty"]) + r.choice(["", "!"]) for _ in range(40)] + [f"v{r.random()}"]), "web") for i in range(60)]
    rows += bad + [rows[0], rows[5], (2000, "", "empty source")]
    r.shuffle(rows)
    fields = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
    docs = spark.createDataFrame([(d, t, s, "en", len(t or ""), *range(len(CLASHING))) for d, t, s in rows], fields).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d, 1, int(d >= 1000)) for d in {x[0] for x in rows} if d % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ship_package(spark)
    model = op1_ordinal.fit(docs, op1_ordinal.grades_of(spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = plain_pipeline(rows, model, enc)
    got = Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in C.run(spark, str(tmp_path)).collect())
    assert got == want
    ids = {k[0] for k in want}
    assert len(ids) > 20 and not ids & {b[0] for b in bad} and max(want.values()) > 1
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        first = out.where("doc_id is not null").select(*CLASHING).distinct().collect()
        assert [tuple(x) for x in first] == [tuple(range(len(CLASHING)))]


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as C

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_chain(spark, tmp_path):
    import corpus_pipeline as C

    rows = [r for r in corpus(3, 20) if r[0] is not None]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 2}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    _, comp = components_of(rows)
    kept = [(d, t) for d, t in sorted(set(rows), key=lambda x: x[0]) if comp[d] == d]
    near = C.near_duplicates(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {d for d, _ in kept}
    out = C.run(spark, str(tmp_path)).collect()
    assert out and {r.doc_id for r in out} <= {d for d, _ in kept} and all(r.n_tokens == len(r.ids) for r in out)
