"""Ranked lexical search by hashed max-sketches.

A document's impact of a term is what the term adds to a score per unit of its weight. All impacts of a document fold into
a sketch: every term is hashed to one of ``width`` coordinates, and a coordinate holds the largest impact hashed to it.
A query, folded the same way (the weights of its terms summed by coordinate), times the sketch is an upper bound of its
score; a batch of queries against a batch of sketches is one matrix product. Each task rescores its documents exactly in
the order of descending bounds until the next bound is below the k-th best exact score; the tasks' best are merged.

Texts are never shuffled: one scan counts documents, terms and document frequencies of the queries' terms, a second one
builds the sketches and searches. Queries come in blocks of bounded size, each against all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, StructField, StructType

from shelfwise.llm.common import bounded_batches
from shelfwise.llm.textvec import Words, chunks, ranges

IMPACT_UNIT, LENGTH_SHARE = 1_000_000_000, 90
LOAD = 4                            # coordinates of a sketch per distinct term, rounded up to a power of two
MIN_WIDTH, MAX_WIDTH = 64, 4096     # a document of more terms gets looser bounds, not other results
BLOCK_BYTES = 1 << 17               # of query texts in one block: bounds the folded queries, which are held dense
_FIRST = 16                         # documents rescored before the threshold is looked at again; doubles
_SALTS = 64                         # parts of the merge of one query's best

TERM = np.zeros(256, bool)
TERM[0x30:0x3A] = TERM[0x41:0x5B] = TERM[0x61:0x7B] = TERM[0x80:] = True


def terms_of(raw: np.ndarray, offs: np.ndarray) -> Words:
    """A chunk's terms: runs of letters, digits and bytes from 0x80 on, only A-Z lower-cased."""
    return Words(raw, offs, lower=True, table=TERM)


@dataclass
class Queries:
    """Distinct terms of a block of queries, sorted by hash, with their bytes; and the (query, term) pairs by query."""

    hash: np.ndarray        # uint64, ascending
    start: np.ndarray       # of a term's bytes
    end: np.ndarray
    raw: np.ndarray
    first: np.ndarray       # of a query's pairs
    term: np.ndarray        # of a pair

    @property
    def count(self) -> int:
        return len(self.first) - 1


def query_terms(texts: list[str | None]) -> Queries:
    """The distinct terms of each text. Different terms of one hash stay apart by their bytes or are refused."""
    q, t, spelled = [], [], {}
    for a, _, raw, offs in chunks(pa.array(texts, pa.large_string()), 1 << 62):
        w = terms_of(raw, offs)
        for i in range(len(w)):
            spelled.setdefault(bytes(w.raw[w.start[i]:w.end[i]]), int(w.hash[i]))
            q.append(a + int(w.doc[i]))
            t.append(int(w.hash[i]))
    by_hash = sorted((h, s) for s, h in spelled.items())
    if len({h for h, _ in by_hash}) < len(by_hash):
        raise ValueError("two query terms share a hash")
    known = np.array([h for h, _ in by_hash], np.uint64)
    ends = np.cumsum([len(s) for _, s in by_hash], dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if by_hash else ends
    body = np.frombuffer(b"".join(s for _, s in by_hash), np.uint8)
    pairs = np.unique(np.stack([np.array(q, np.int64), np.searchsorted(known, np.array(t, np.uint64))], 1), axis=0) if q else np.zeros((0, 2), np.int64)
    first = np.searchsorted(pairs[:, 0], np.arange(len(texts) + 1))
    return Queries(known, starts, ends, body, first, pairs[:, 1])


def matches(w: Words, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
    """(word, query term) of the chunk's words that are query terms, byte for byte."""
    if not len(queries.hash) or not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(queries.hash, w.hash), len(queries.hash) - 1)
    word = np.flatnonzero((queries.hash[at] == w.hash) & (queries.end[at] - queries.start[at] == w.end - w.start))
    at = at[word]
    size = (w.end - w.start)[word]
    differs = w.raw[ranges(w.start[word], size)] != queries.raw[ranges(queries.start[at], size)]
    if differs.any():
        bad = np.unique(np.repeat(np.arange(len(word)), size)[differs])
        word, at = np.delete(word, bad), np.delete(at, bad)
    return word, at


def document_terms(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term hash, occurrences) of a chunk's distinct terms, by document and hash."""
    order = np.lexsort((w.hash, w.doc))
    doc, h = w.doc[order], w.hash[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))


def impacts(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds to a score per unit of weight; ``length`` is the document's m."""
    return (IMPACT_UNIT * tf.astype(np.int64)) // (1000 * tf + 8 * length)


def _count(queries: Queries):
    """Documents with a term, all terms, and per query term the documents that hold it, summed over the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = total = 0
        df = np.zeros(len(queries.hash), np.int64)
        for b in batches:
            for _, _, raw, offs in chunks(b.column("text")):
                w = terms_of(raw, offs)
                n = w.counts()
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                word, term = matches(w, queries)
                held = np.unique(w.doc[word] * len(df) + term) % max(1, len(df))
                df += np.bincount(held, minlength=len(df))
        seen = np.flatnonzero(df)
        yield pa.record_batch({"term": pa.array(np.concatenate([[-2, -1], seen]).astype(np.int64)),
                               "k": pa.array(np.concatenate([[docs, total], df[seen]]).astype(np.int64))})
    return run


def _search(queries: Queries, weight: np.ndarray, docs: int, total: int, k: int):
    """A task's k best documents of each query, exact."""
    pair_query = np.repeat(np.arange(queries.count), np.diff(queries.first))
    pair_weight = weight[queries.term]
    folded: dict[int, np.ndarray] = {}

    def fold(width: int) -> np.ndarray:
        """(coordinate, query): the summed weights of the query's terms; whole numbers in doubles, exact far below 2^53."""
        if width not in folded:
            m = np.zeros((width, queries.count))
            np.add.at(m, ((queries.hash[queries.term] & np.uint64(width - 1)).astype(np.int64), pair_query), pair_weight)
            folded[width] = m
        return folded[width]

    def bounds(w: Words, m: np.ndarray) -> np.ndarray:
        doc, h, tf = document_terms(w)
        impact = impacts(tf, m[doc])
        distinct = np.bincount(doc, minlength=len(m))
        need = np.clip(LOAD * np.maximum(distinct, 1), MIN_WIDTH, MAX_WIDTH)
        width = np.int64(1) << np.ceil(np.log2(need)).astype(np.int64)
        out = np.zeros((len(m), queries.count))
        for x in np.unique(width[distinct > 0]):
            rows = np.flatnonzero((width == x) & (distinct > 0))
            place = np.full(len(m), -1)
            place[rows] = np.arange(len(rows))
            mine = place[doc] >= 0
            sketch = np.zeros((len(rows), int(x)))
            np.maximum.at(sketch, (place[doc[mine]], (h[mine] & np.uint64(x - 1)).astype(np.int64)), impact[mine])
            out[rows] = sketch @ fold(int(x))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(queries.count)]
        floor = np.zeros(queries.count)     # k-th best score so far
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for a, _, raw, offs in chunks(b.column("text")):
                w = terms_of(raw, offs)
                n = w.counts()
                m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * docs) // max(1, total)
                word, term = matches(w, queries)
                if not len(word):
                    continue
                cell, tf = np.unique(w.doc[word] * len(weight) + term, return_counts=True)
                value = impacts(tf, m[cell // len(weight)]) * weight[cell % len(weight)]
                upper = bounds(w, m)
                for q in np.flatnonzero((upper >= np.maximum(floor, 1)).any(axis=0)):
                    near = np.flatnonzero(upper[:, q] >= max(floor[q], 1))
                    near = near[np.argsort(-upper[near, q], kind="stable")]
                    mine, at, step = queries.term[queries.first[q]:queries.first[q + 1]], 0, _FIRST
                    while at < len(near) and upper[near[at], q] >= max(floor[q], 1):
                        part = near[at:at + step]
                        at, step = at + step, 2 * step
                        asked = part[:, None] * len(weight) + mine[None, :]
                        found = np.minimum(np.searchsorted(cell, asked), len(cell) - 1)
                        score = np.where(cell[found] == asked, value[found], 0).sum(axis=1)
                        hit = np.flatnonzero(score > 0)
                        new = [(-int(score[i]), ids[a + part[i]] is None, ids[a + part[i]] or 0) for i in hit]
                        best[q] = sorted(best[q] + new)[:k]
                        if len(best[q]) == k:
                            floor[q] = -best[q][-1][0]
        rows = [(q, None if none else i, -s) for q, found in enumerate(best) for s, none, i in found]
        yield pa.record_batch({"query": pa.array([r[0] for r in rows], pa.int32()), "doc_id": pa.array([r[1] for r in rows], pa.int64()),
                               "score": pa.array([r[2] for r in rows], pa.int64())})
    return run


def _search_block(docs: DataFrame, items: list, item_type: DataType, k: int) -> DataFrame:
    spark = docs.sparkSession
    queries = query_terms([r["text"] for r in items])
    counted = {r["term"]: r["k"] for r in docs.select("text").mapInArrow(_count(queries), "term long, k long")
               .groupBy("term").agg(F.sum("k").alias("k")).collect()}  # at most the block's distinct terms and two
    n, total = counted.get(-2, 0), counted.get(-1, 0)
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(queries.hash))], np.int64)
    local = docs.select("doc_id", "text").mapInArrow(_search(queries, weight, n, total, k), "query int, doc_id long, score long")
    # every task sends k rows a query at most; they are merged in parts, then the parts
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))
    few = local.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("r") <= k)
    top = few.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(items)],
                                  StructType([StructField("of", IntegerType()), StructField("item_id", item_type)]))
    return top.join(F.broadcast(names), F.col("query") == F.col("of")).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10) -> DataFrame:
    """docs(doc_id long, text, ...) x benchmark(item_id, text, ...) -> (item_id, rank, doc_id, score): each item's k documents
    of the highest score above 0, ties by ascending doc_id (null last).

    A null or blank text holds no term: as a document it is not counted, as an item it finds nothing. A document row
    counts and ranks for itself, also one without an id or one that repeats another; equal rows of the benchmark are
    one item, rows of one id with different texts are an item each. Empty tables give no rows. Extra columns are ignored."""
    bounded_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text").where(F.octet_length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    found = None
    for b in range(blocks):  # each block of queries against all documents
        rows = dealt.where(F.col("block") == b).select("item_id", "text").collect()
        one = _search_block(docs, rows, items.schema["item_id"].dataType, k)
        found = one if found is None else found.unionByName(one)
    return found
