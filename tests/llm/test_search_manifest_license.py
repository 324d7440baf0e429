"""Lexical search, Merkle manifest and licence scan against brute force, with nulls, empty, long and repeated texts, ties,
empty tables and clashing column names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import lexical, license_scan, merkle
from shelfwise.llm.textvec import chunks
from shelfwise.session import ship_package

UP = {c: c + 32 for c in range(65, 91)}
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, places string, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(80)] + ["Éa", "ünd", "THE", "the", "Mit", "license", "under", "Apache", "Version", "2", "cc", "by", "NC"]
    text = lambda n: " ".join(vocab[i] for i in rng.integers(0, len(vocab), n))
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "GNU General Public License, version 3",
             "under the MIT license under the mit license", "cc by nc cc-by-nc", "Permission is hereby granted, free of charge, to nobody"]
    texts = [None, "", " \n ", "!!!", "one", "the " * 300, *lines, text(3000) + " " + lines[2] + " " + text(3000), text(40), text(40), text(40) + " " + lines[0]]
    texts += [text(int(n)) for n in rng.integers(1, 90, 60)]
    rows = [(i, t, [None, "en", "de", "Zz", "é"][i % 5 if i % 3 else 1], None if i % 4 else "s", None if i % 5 == 0 else i, "clash", "clash", "clash", 9)
            for i, t in enumerate(texts)]
    rows += [rows[7], rows[15], (None, texts[15], None, None, None, None, None, None, None), (5, "another w1 w2 text", "only", None, 7, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return docs.collect()


def terms(t):
    return TERM.findall((t or "").translate(UP)) if t else []


def best(rows, items, k):
    docs = [(r.doc_id, collections.Counter(terms(r.text))) for r in rows]
    n = sum(1 for _, c in docs if c)
    total = sum(sum(c.values()) for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            if not c:
                continue
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ITEMS = [("a", "w1 w2 W3 w4 w4"), ("b", "the Éa ünd"), ("c", "absent words only"), ("d", None), ("e", ""), ("f", "?!"), (None, "w7 mit w9"),
         ("g", " ".join(f"w{i}" for i in range(70))), ("g", "w5")]


@pytest.mark.parametrize("k,block", [(10, None), (3, 20)])
def test_lexical_search(spark, docs, rows, monkeypatch, k, block):
    if block:
        monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
        monkeypatch.setattr(lexical, "MAX_WIDTH", 64)  # crowded sketches: loose bounds, the same rows
    items = spark.createDataFrame([(*x, 1) for x in [*ITEMS, ITEMS[0]]], "item_id string, text string, doc_id int")
    got = sorted([tuple(r) for r in lexical.search(docs, items, k).select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert got == best(rows, ITEMS, k)


def test_lexical_bounds_hold():
    """A sketch's bound is never below the exact score, however crowded."""
    texts = ["a b c d e f g h", "a a a b", "x " * 50 + "a", " ".join(f"t{i}" for i in range(2000)) + " a b"]
    (_, _, raw, offs), = chunks(pa.array(texts))
    w = lexical.terms_of(raw, offs)
    doc, h, tf = lexical.document_terms(w)
    assert np.bincount(doc).tolist() == [len(set(terms(t))) for t in texts]
    assert tf.sum() == sum(len(terms(t)) for t in texts)
    exact = lexical.impacts(tf, np.full(len(tf), 100))
    for width in (4, 64, 1024):
        sketch = np.zeros((len(texts), width), np.int64)
        cell = (h & np.uint64(width - 1)).astype(np.int64)
        np.maximum.at(sketch, (doc, cell), exact)
        assert (sketch[doc, cell] >= exact).all()
    queries = lexical.query_terms(["a b x", "t5 t6 zz"])
    assert queries.count == 2 and len(queries.hash) == 6
    word, at = lexical.matches(w, queries)
    spelled = [bytes(w.raw[w.start[i]:w.end[i]]) for i in word]
    assert spelled == [bytes(queries.raw[queries.start[i]:queries.end[i]]) for i in at]
    assert collections.Counter(spelled) == {b"a": 6, b"b": 3, b"x": 50, b"t5": 1, b"t6": 1}
    assert lexical.query_terms([]).count == 0 and lexical.query_terms([None, ""]).count == 2


def test_lexical_empty(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert lexical.search(docs, items.limit(0)).count() == 0


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def tree(leaves, fanout):
    """(root, proof of each leaf as joined sibling texts by level)."""
    proofs, level, own = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, at in enumerate(own):
            s = at - at % fanout
            proofs[i].append(("".join(level[s:at]), "".join(level[at + 1:s + fanout])))
        level = [sha("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
        own = [x // fanout for x in own]
    return level[0], proofs


@pytest.mark.parametrize("fanout,block", [(2, 1024), (2, 2), (3, 3)])
def test_manifest(docs, rows, fanout, block):
    hashed = docs.withColumn("h", merkle.digest(merkle.field_text(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.col("text"))))
    got = merkle.manifest(hashed, "h", "lang", ["doc_id"], fanout, block)
    assert got.columns == [c for c in hashed.columns if c != "root"] + ["subroot", "root", "proof"]
    got = got.collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r.lang].append(((r.doc_id is not None, r.doc_id or 0), leaf_of(r)))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subtrees = {n: tree([h for _, h in sorted(groups[n])], fanout) for n in names}
    root, tops = tree([subtrees[n][0] for n in names], fanout)
    want = collections.Counter()
    for n, top in zip(names, tops):
        for (key, h), proof in zip(sorted(groups[n]), subtrees[n][1]):
            want[h, subtrees[n][0], root, tuple(proof + top)] += 1
    assert collections.Counter((r.h, r.subroot, r.root, tuple((s["left"], s["right"]) for s in r.proof)) for r in got) == want
    assert {r.leaf for r in got} == {"clash", None}  # input columns are carried along


def test_manifest_rounds_and_tampering(spark, monkeypatch):
    """More rounds than one plan takes; a changed leaf fails, the others verify."""
    monkeypatch.setattr(merkle, "ROUNDS_A_PLAN", 3)
    rows = spark.range(0, 37, numPartitions=4).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), merkle.digest(F.col("id").cast("string")).alias("leaf"))
    known = merkle.manifest(rows, "leaf", "lang", ["doc_id"], 2, 1)
    now = F.when(held(F.col("doc_id")), merkle.digest(F.lit("other"))).otherwise(F.col("leaf"))
    got = known.select("doc_id", (merkle.fold(now, F.col("proof")) == F.col("root")).alias("ok"), merkle.siblings_digest(F.col("proof")).alias("s"), "root", "subroot").collect()
    root, proofs = tree([sha(str(i)) for i in range(37)], 2)
    assert len(got) == 37 and {r.root for r in got} == {root} == {r.subroot for r in got}  # a lone subroot is the root
    for r in got:
        assert r.ok == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)
        assert r.s == sha("".join(a + b for a, b in proofs[r.doc_id]))


def held(doc_id):
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 0


def test_manifest_edges(docs, spark):
    hashed = docs.withColumn("h", F.sha2("text", 256))
    assert merkle.manifest(hashed.limit(0), "h", "lang", ["doc_id"]).count() == 0
    one = spark.createDataFrame([(1, None, sha("x"))], "doc_id long, lang string, h string")
    got = merkle.manifest(one, "h", "lang", ["doc_id"]).first()
    assert got.subroot == got.root == sha("x") and got.proof == []
    many = spark.createDataFrame([(3, "a", sha("x"))] * 9, "doc_id long, lang string, h string")
    assert {r.root for r in merkle.manifest(many, "h", "lang", ["doc_id"], 2, 2).collect()} == {tree([sha("x")] * 9, 2)[0]}
    with pytest.raises(ValueError):
        merkle.manifest(hashed, "h", "lang", ["doc_id"], 2, 6)


def licence(text, weight):
    w = WORD.findall((text or "").translate(UP))
    at = lambda p: [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    places = []
    for t in license_scan.TEMPLATES:
        notice = t.words.split()
        phrases = [p.split() for p in t.phrases]
        if t.base:
            places += [(t.label, True, i, 1.0) for i in at(phrases[0])]
            continue
        offset = [next(i for i in range(len(notice)) if notice[i:i + len(p)] == p) for p in phrases]
        for i in at(phrases[0]):
            origin = i - offset[0]
            if all(origin + o in at(p) for p, o in zip(phrases, offset)):
                got = sum(weight[x] for j, x in enumerate(notice) if 0 <= origin + j < len(w) and w[origin + j] == x) / sum(weight[x] for x in notice)
                if got >= license_scan.NOTICE_SHARE:
                    places.append((t.label, False, i, round(min(got, 1.0), 9)))
    return len(w), sorted(places)


def test_license_scan(docs, rows):
    count, df = license_scan.document_frequencies(docs)
    want_df = collections.Counter(x for r in rows for x in set(WORD.findall((r.text or "").translate(UP))))
    assert count == len(rows) and all(df.get(w, 0) == want_df[w] for t in license_scan.TEMPLATES for w in t.words.split())
    weight = license_scan.weights(count, df)
    got = license_scan.scan(docs)
    assert got.columns == [c for c in docs.columns if c != "places"] + ["n_words", "places"]
    found = collections.Counter((r.doc_id, r.text, r.n_words, tuple(sorted((p.label, p.base, p.start, round(p.score, 9)) for p in r.places))) for r in got.collect())
    want = collections.Counter((r.doc_id, r.text, licence(r.text, weight)[0], tuple(licence(r.text, weight)[1])) for r in rows)
    assert found == want
    assert any(not p[1] for k in want for p in k[3]) and any(p[1] for k in want for p in k[3])


def test_license_report(spark, docs, rows):
    weight = license_scan.weights(*license_scan.document_frequencies(docs))
    want = collections.Counter()
    for r in rows:
        n, places = licence(r.text, weight)
        starts = [p[2] for p in places if p[1]]
        want[r.doc_id, n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({p[0] for p in places if p[1]})),
             ",".join(sorted({p[0] for p in places})), max([p[3] for p in places], default=0.0)] += 1
    got = license_scan.report(docs)
    assert collections.Counter((*r[:7], round(r[7], 9)) for r in got.collect()) == want
    assert license_scan.report(docs.limit(0)).count() == 0
    stored = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = license_scan.report(stored)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Exchange" not in plan


def test_license_notice_needs_its_phrases(spark):
    full = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    texts = {"whole": full, "cut": full[:120], "shifted": full.replace("obtaining", "who gets"), "plain": "plain words " * 9}
    got = {r.doc_id: r.labels for r in license_scan.report(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect()}
    assert got == {"whole": "mit", "cut": "", "shifted": "", "plain": ""}
