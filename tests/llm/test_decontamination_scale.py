"""Decontamination where one text or one common start holds most of the work."""

import time

from pyspark.sql import functions as F

from shelfwise.llm import decontamination


def test_one_long_text_and_many_windows_of_one_start(spark):
    """A text of 200,000 words, and 20,000 test windows that all begin with the same three words."""
    rnd = spark.range(200_000).select(F.concat(F.lit("w"), F.pmod(F.xxhash64("id"), F.lit(5000))).alias("w"), "id")
    long = rnd.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "w"))), lambda x: x["w"]), " one of the ")).first()[0]
    item = lambda i: "one of the " + " ".join(f"u{i}v{j}" for j in range(7))
    bench = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat(F.lit("One of the "), F.array_join(
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda j: F.concat(F.lit("u"), "id", F.lit("v"), j)), " ")).alias("text"))
    docs = spark.createDataFrame([(1, long + " " + item(17_003)), (2, "one of the " * 500), (3, item(5) + " " + item(6)), (4, None), (5, "one of the u5v0")],
                                 "doc_id long, text string")
    t = time.time()
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontamination.document_report(docs, bench).collect()}
    assert got == {1: (10, 1), 2: (0, 0), 3: (20, 2), 4: (0, 0), 5: (0, 0)}
    assert time.time() - t < 60
    kept = decontamination.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    spans = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    assert spans[3] == "" and spans[5] == "one of the u5v0" and spans[1].split() == long.split()


def test_crowded_bitmap_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{(i * j) % 23}" for j in range(60))) for i in range(40)], "doc_id long, text string")
    bench = docs.where("doc_id % 9 = 1").select(F.concat(F.lit("b"), "doc_id").alias("item_id"), F.substring("text", 9, 60).alias("text"))
    want = sorted(tuple(r) for r in decontamination.document_report(docs, bench).collect())
    monkeypatch.setattr(decontamination, "MAX_BITS", 1)     # every position passes
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(tuple(r) for r in decontamination.document_report(docs, bench).collect()) == want
    assert any(r[2] for r in want)
    none = bench.limit(0)
    assert {r.n_hit for r in decontamination.document_report(docs, none).collect()} == {0}
    assert decontamination.decontaminate(docs, none).count() == 40
