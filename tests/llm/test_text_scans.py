"""License scan, phrase collocations and fill-in-middle against brute force: nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pkgsift.llm import op11_licenses as L
from pkgsift.llm import op12_phrases as P
from pkgsift.llm import op13_fim as M
from pkgsift.session import ship_package

SCHEMA = "doc_id long, text string, lang string, template int, form string, n int, phrase string, w string, row int"


def frame(spark, rows):
    """(doc_id, text, lang) with extra columns that have the names of the operators' own."""
    ship_package(spark)
    return spark.createDataFrame([(d, t, g, 1, "x", 2, "y", "z", 3) for d, t, g in rows], SCHEMA).repartition(3)


def texts(seed=5):
    r = random.Random(seed)
    vocab = ["cc", "by", "CC", "general", "Public", "license", "all", "rights", "reserved", "the", "of", "naïve", "漢字", "x1", "Straße", "released", "under", "MIT"]
    vocab += [f"v{i}" for i in range(20)]
    marks = [" ", " ", " ", "\n", ", ", ". ", "\t", "--", "<P", " ", "\x0b", " \x1f"]
    text = lambda k: "".join(r.choice(vocab) + r.choice(marks) for _ in range(k))
    out = [(i, text(r.randint(0, 60)), r.choice(["en", "de", None, "und"])) for i in range(60)]
    out += [(60, None, "en"), (61, "", "de"), (62, " \n\t", None), (None, text(40), "en"), (None, None, None), out[3], out[4], (4, text(9), "en")]
    out += [(63, "CC BY. All rights\nreserved General Public License", "en"), (64, "cc by cc by cc", "en"), (65, "all rights all rights reserved", "de"),
            (66, "Released, under the MIT License " * 3, "en"), (67, "a<P>b", "en"), (68, "a<S>b", "en"), (69, "é", "fr"), (70, "\x00cc\x00by\x00", "en"),
            (71, text(90_000) + "spread word " * 40, "en"), (72, "spread word " * 20_000, "en")]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def digest(b):
    return hashlib.sha256(b).hexdigest()


# --- license scan


def base_places(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    found = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return (len(w), len(found), min(at) if at else None, max(at) if at else None, ",".join(sorted({x for _, x in found})))


def test_op11_base_places(docs, rows, empty):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.op11_licenses(docs).collect())
    assert got == Counter((d, *base_places(t)) for d, t, _ in rows)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and (r.score == 1.0 if r.base_labels else 0 <= r.score <= 1) for r in L.op11_licenses(docs).collect())
    assert L.op11_licenses(empty).count() == 0


@pytest.mark.parametrize("text, labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
    ("foo licensed under the new Apache License, Version 2.0 bar", "apache-2.0"),  # a word put in: two diagonals
    ("licensed under Apache License Version 2.0", "apache-2.0"),  # a word left out
    ("licensed under the best license version 2 0", ""),  # the key word is missing
    ("under the terms of the agreement", ""),
    ("Permission is hereby granted, free of charge, to any person who gets a copy of this software and associated documentation files", "mit"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
    ("released under the the the the MIT License", "mit"),
    ("licensed x licensed under y the apache z license version q 2 0", "apache-2.0"),  # three words put in
    ("licensed x under y the z apache q license", ""),  # no two words in a row
])
def test_op11_own_labels(spark, text, labels):
    got = L.op11_licenses(frame(spark, [(1, "w " * 30 + text, "en")])).first()
    assert got.labels == labels and (got.score >= 0.75) == bool(labels)


def test_op11_long_templates_and_spans(spark):
    """A template of more words than a mask has goes in parts; spans are given in words."""
    words = [f"t{i}" for i in range(130)]
    long = L.Template("long", " ".join(words))
    df = frame(spark, [(1, "a b " + " ".join(words), "en"), (2, " ".join(words[:40]), "en")])
    got = {(r.doc_id, r.start, r.end, r.coverage) for r in L.spans(df, (long,)).collect()}
    assert len(long.parts()) == 3 and {x[1:] for x in got if x[0] == 1} == {(2, 45, 1.0), (45, 88, 1.0), (88, 132, 1.0)}
    assert {x[0] for x in got if x[0] == 2} == {2}
    with pytest.raises(ValueError):
        L.template_rows((L.Template("one", "word"),))


def test_op11_native_plan(docs):
    plan = L.op11_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# --- phrases


def phrase_oracle(rows, least, inside, top):
    f, out = {}, []
    for _, text, lang in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            c.update(tuple(w[i:i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        often = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, x[2].decode(), -x[1], x[3], x[4], n, -x[0]) for i, x in enumerate(sorted(found)[:top], 1)]
    return Counter(out)


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("least, inside, top, bounds", [
    (30, 80, 2000, {}),
    (3, 50, 40, {"shard_bytes": 2000, "shard_symbols": 64}),  # many shards, sequences cut into overlapping parts
    (2, 80, 10_000, {"shard_bytes": 300, "shard_symbols": 7}),
])
def test_op12_matches_brute_force(spark, rows, empty, least, inside, top, bounds):
    some = list(rows) if least == 30 else [x for x in rows if x[0] not in (71, 72)] + [(73, "q r s t " * 60, "en")]
    r = random.Random(least)
    some += [(100 + i, "".join(r.choice("pqrs") + r.choice([" ", " ", " ", "\t", ", "]) for _ in range(30)), r.choice(["en", "de", None])) for i in range(20)]
    got = P.op12_phrases(frame(spark, some), least, inside, top, **bounds).select(*NAMES).collect()
    want = phrase_oracle(some, least, inside, top)
    assert len(want) > (4 if least == 30 else 30) and Counter(map(tuple, got)) == want
    assert P.op12_phrases(empty).count() == 0


def test_op12_score_is_exact_beyond_64_bits(spark):
    big = 10 ** 14
    counts = spark.createDataFrame([("en", 1, "a", 3 * big), ("en", 1, "b", big), ("en", 2, "a b", big), ("en", 1, "c", 7), ("en", 3, "a b c", 7), ("en", 2, "b c", 7)],
                                   "lang string, size int, phrase string, n long")
    got = {r.phrase: (r.a, r.l, r.r, r.cut, r.score, r.left_n, r.right_n, r.held) for r in P.collocations(counts, 2).collect()}
    assert got["a b"] == (big, 3 * big, big, 1, 500_000, None, 7, False)
    assert got["a b c"] == (7, 3 * big, 7, 1, 0, None, None, False)
    assert got["b c"] == (7, big, 7, 1, 0, 7, None, True)


def test_op12_index_steps():
    """Blocks of both transforms stay in step: every phrase found by any order of steps has its count."""
    r = np.random.default_rng(1)
    ids = np.concatenate([r.integers(0, 6, 400), [0]])
    index = P.BidirectionalIndex(ids, len(ids))
    want = Counter(tuple(ids[i:i + k].tolist()) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if (ids[i:i + k] > 0).all())
    one = index.singles()
    for steps in ("l", "r", "ll", "lr", "rl", "rr", "lrl", "lll", "rrr", "llr"):
        p = one
        for s in steps:
            p = index.left(p) if s == "l" else index.right(p)
        got = dict(zip(zip(*(w.tolist() for w in p.words)), p.count.tolist()))
        assert got == {k: v for k, v in want.items() if len(k) == len(steps) + 1}, steps


# --- fill in the middle


def fim_oracle(doc, text, cut=90, spm=20):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = digest(f"1:{'' if doc is None else doc}".encode())
    h = [int(h[i:i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= cut:
        return (doc, len(units), "plain", None, None, digest(text.encode()), digest(text.encode()))
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"
    return (doc, len(units), form, len(pre), len(mid), digest(out.encode()), digest(text.encode()))


@pytest.mark.parametrize("percents", [(90, 20), (100, 50)])
def test_op13_matches_brute_force(docs, rows, empty, percents):
    got = Counter(map(tuple, M.op13_fim(docs, *percents).collect()))
    assert got == Counter(fim_oracle(d, t, *percents) for d, t, _ in rows)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    assert M.op13_fim(empty).count() == 0 and M.transform(empty).count() == 0


def test_op13_transform_keeps_columns_and_is_undone(docs, rows):
    got = M.transform(docs)
    assert got.columns == [c for c in docs.columns if c != "form"] + ["n_units", "form", "prefix_chars", "middle_chars"]
    back = Counter((r.doc_id, M.restored(r.form, r.text.encode()).decode(), r.lang, r.template, r.row) for r in got.collect())
    assert back == Counter((d, t or "", g, 1, 3) for d, t, g in rows)


@pytest.mark.parametrize("kind, positions", [
    (M.ArrayContainer, np.arange(0, 60_000, 40)), (M.RunContainer, np.concatenate([np.arange(5, 30_000), np.arange(40_000, 65_536)])),
    (M.BitmapContainer, np.flatnonzero(np.random.default_rng(2).random(65_536) < 0.5))])
def test_op13_containers_select(kind, positions):
    assert type(M.container(positions)) is kind
    wide = np.concatenate([positions, positions + (3 << 16), [9 << 16]])
    chosen = M.BoundarySet(wide)
    assert len(chosen) == len(wide) and np.array_equal(chosen.select(np.arange(len(wide))), wide)
    assert np.array_equal(chosen.select(np.array([len(wide) - 1, 0, len(positions)])), wide[[-1, 0, len(positions)]])
