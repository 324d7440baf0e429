"""Quality classifier: features and site posteriors against brute force, held-out accuracy, defined edge cases."""

import collections
import math
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from shelfwise.llm import quality
from shelfwise.llm.queries import op4_quality
from shelfwise.llm.textvec import as_array, chunks
from shelfwise.session import ship_package

DOCS = "doc_id long, text string, source string, host string, keep int, n_rows string, y_quality int"


@pytest.fixture(scope="module")
def tables(spark):
    ship_package(spark)
    rng = np.random.default_rng(8)
    vocab = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(1200):
        bad, toxic = rng.random() < (0.8 if i % 3 == 0 else 0.1), rng.random() < 0.2
        words = [vocab[j] for j in rng.integers(0, 80, int(rng.integers(20, 90)))]
        if bad:
            words = [w for w in words[:8] for _ in range(6)]
        if toxic:
            words[3] = "Vile,"
        rows.append((i, " ".join(words), f"http://Site{i % 3 if i % 3 else 0}.example/{'a' if i % 2 else 'b'}/x?y", "clash", 1, "clash", 1))
        if i % 5:
            labels.append((i, int(not bad), int(toxic), "clash"))
    rows += [(5000, None, "x", None, None, None, None), (5001, "", "x", None, None, None, None), (5002, " \n .. ", None, None, None, None, None),
             (None, "some plain words here", None, None, None, None, None), rows[4], rows[4], (5003, "long " * 30000, "HTTPS://h/p", None, None, None, None)]
    labels += [labels[0], (labels[1][0], None, None, None), (None, 1, 1, None), (99999, 1, 0, None)]
    return (spark.createDataFrame(rows, DOCS).repartition(3).cache(),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").cache())


def test_features():
    text = ["Aa bb, bb\nbb bb\nAa bb, bb", "", "É1 - x"]
    (_, _, raw, offs), = chunks(as_array(pa.array(text)))
    shape, words = quality.features(raw, offs)
    assert words.counts().tolist() == [8, 0, 2]
    n, lines = 8, 3
    want = [math.log1p(n), 2, 0, 2 / n, (36 + 4) / n ** 2, 4 / n, n / lines, 2 / lines, 5 / lines ** 2, 0, math.log1p(lines)]
    size = len(text[0])
    want += [2 / size, 0, 0, 5 / size, 2 / size, 2 / size, 0]
    assert np.allclose(shape[0], want, atol=1e-6)
    assert shape[1, 0] == 0 and np.isfinite(shape).all()
    assert np.allclose(shape[2, -7:], [0, 1 / 7, 2 / 7, 2 / 7, 0, 0, 1 / 7])


def moments(groups, parent_rate, dof, variance):
    """groups: (n, k, parent) -> beta strength, as the operator's docstring says."""
    spread = sum(n * (k / n - parent_rate(g)) ** 2 for n, k, g in groups if n)
    total, square = collections.Counter(), collections.Counter()
    for n, _, g in groups:
        total[g] += n
        square[g] += n * n
    size = sum(total[g] - square[g] / total[g] for g in total if total[g]) - dof
    if size <= 0 or variance <= 0:
        return quality.MOST_STRENGTH
    rho = (spread / variance - dof) / size
    return min(max(1 / rho - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH) if rho > 0 else quality.MOST_STRENGTH


def test_posteriors_equal_brute_force(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    out = quality.judge(docs, labels, model).collect()
    assert sorted((r.doc_id is None, r.doc_id) for r in out) == sorted((r.doc_id is None, r.doc_id) for r in docs.select("doc_id").collect())
    given = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in labels.collect():
        for t in quality.TARGETS:
            if r.doc_id is not None and r[t] is not None:
                given[t][r.doc_id].append(r[t])
    for t, clean in quality.TARGETS.items():
        own = []
        for r in out:
            y = given[t].get(r.doc_id)
            n = 0 if not r.n_words else 1.0 if y else quality.SOFT_WEIGHT
            own.append((n, n * (float(np.mean(y) >= 0.5) if y else r[f"doc_{t}"])))
        hosts, paths = collections.defaultdict(lambda: [0.0, 0.0]), collections.defaultdict(lambda: [0.0, 0.0])
        for r, (n, k) in zip(out, own):
            for d, g in ((hosts, r.host), (paths, (r.host, r.path))):
                d[g][0] += n
                d[g][1] += k
        big_n, big_k = sum(n for n, _ in own), sum(k for _, k in own)
        rate = (big_k + clean) / (big_n + 1)
        sh = moments([(n, k, 0) for n, k in hosts.values()], lambda _: rate, sum(n > 0 for n, _ in hosts.values()) - 1, rate * (1 - rate))
        dof = sum(max(sum(n > 0 for (g, _), (n, _) in paths.items() if g == h) - 1, 0) for h in hosts)
        var = sum(n * (k / n) * (1 - k / n) for n, k in hosts.values() if n) / big_n
        sp = moments([(n, k, g) for (g, _), (n, k) in paths.items()], lambda g: hosts[g][1] / hosts[g][0], dof, var)
        for r, (n, k) in zip(out, own):
            at = (sh * rate + hosts[r.host][1] - k) / (sh + hosts[r.host][0] - n)
            at = (sp * at + paths[r.host, r.path][1] - k) / (sp + paths[r.host, r.path][0] - n)
            assert r[f"site_{t}"] == pytest.approx(at, abs=2e-4)
            if r.n_words:
                z = math.log(at / (1 - at)) + math.log(r[f"doc_{t}"] / (1 - r[f"doc_{t}"])) - model.targets[t].prior
                assert r[f"{t}_score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3)
    by = {(r.host, r.path): r for r in out}
    assert set(by) == {(f"site{i}.example", p) for i in range(3) for p in ("/a", "/b")} | {("x", ""), ("", ""), ("h", "/p")}
    assert by["site0.example", "/a"].site_quality < by["site1.example", "/a"].site_quality
    for r in out:
        if r.doc_id in (5000, 5001, 5002):
            assert (r.n_words, r.quality_score, r.toxic_score, r.keep) == (0, 0.0, 0.0, False)
    again = [tuple(r) for r in out if r.doc_id == 4]
    assert len(again) == 3 and len(set(again)) == 1
    got = quality.kept(docs, quality.judge(docs, labels, model))
    assert got.dtypes == docs.dtypes and got.count() == sum(r.keep for r in out)


def test_held_out_accuracy(tables):
    docs, labels = tables
    train = quality.training_labels(labels)
    out = {r.doc_id: r for r in quality.judge(docs, train, quality.fit(docs, train)).collect()}
    asked = [r for r in labels.where("doc_id < 1200 and quality is not null").distinct().collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(asked) > 100
    assert np.mean([(out[r.doc_id].quality_score >= 0.5) == r.quality for r in asked]) >= 0.97
    assert np.mean([(out[r.doc_id].toxic_score >= 0.5) == r.toxic for r in asked]) >= 0.97


def test_empty_tables(spark, tables):
    docs, labels = tables
    none = labels.limit(0)
    out = quality.judge(docs, none, quality.fit(docs, none)).collect()
    assert len(out) == docs.count() and all(r.keep == (r.n_words > 0) for r in out)
    assert quality.judge(docs.limit(0), labels, quality.fit(docs.limit(0), labels)).count() == 0
    few = labels.where("doc_id < 9")  # a target without both labels on both sides has no classifier
    assert quality.judge(docs.drop("source"), few, quality.fit(docs, few)).count() == docs.count()


def test_cold_groups_are_joined(spark):
    rows = spark.range(300).select("id", (F.col("id") % 100).alias("g"))
    groups = rows.groupBy("g").agg(F.count("*").alias("n_rows"), F.sum("id").alias("s"))
    got = quality._with_groups(rows, groups, ["g"], 300).collect()
    assert sorted((r.id, r.s) for r in got) == [(i, 3 * (i % 100) + 300) for i in range(300)]


def test_query(spark):
    out = op4_quality(spark, "/root/testdata/sf0.001")
    assert out.columns[:2] == ["doc_id", "held_out"]
    assert out.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
