"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte trigrams of its letters. Document frequencies
cover all training rows; several centroids per language are clustered (spherical k-means) on a bounded sample
of them. The nearest centroid by cosine gives the language; a text farther from it than its
length class allows is rejected. What it allows is calibrated on rows held back from the clustering: how near they
are to the centroids of all languages, and how near when their own language's are left out.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from shelfwise.llm.common import bounded_batches
from shelfwise.llm.textvec import SMALL_BYTES, as_array, chunks

DIMS = 4096                 # hashed trigrams
CENTROIDS = 3               # per language
SAMPLE_ROWS = 2048          # bound of the clustering sample, over all languages
SAMPLE_PER_LANGUAGE = 512   # and of each
HELD_BACK = 4               # one in so many sample rows calibrates the rejection
KNOWN_QUANTILE, LEFT_OUT_QUANTILE = 0.005, 0.9
MARGIN = 0.25               # of the way from left-out to known similarities: rather keep than reject
LEAST_ROWS, ALONE_SLACK = 20, 0.5
UNKNOWN = "und"
_SLICE_DOCS = 64            # dense vectors held at once

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def trigram_counts(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Hashed trigram counts (documents x DIMS) of lower-cased UTF-8 texts; all that is no
    letter counts as one space."""
    n = len(offs) - 1
    letter = _LETTER[raw]
    b = np.where(letter, raw, 32)
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    keep = letter | np.concatenate([[False], letter[:-1]]) | edge[:-1]  # a run of others is one space
    b, at = b[keep].astype(np.uint32), np.flatnonzero(keep)
    if len(b) < 3:
        return np.zeros((n, DIMS), np.float32)
    doc = np.searchsorted(offs, at, "right") - 1
    same = doc[2:] == doc[:-2]
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[same] * np.uint32(0x9E3779B1)
    cell = (code >> np.uint32(20)).astype(np.int64) + doc[2:][same] * DIMS
    return np.bincount(cell, minlength=n * DIMS).reshape(n, DIMS).astype(np.float32)


def slices(column):
    """(first row, has letters, trigram counts) of the batch, a bounded number of rows each."""
    lowered = pc.utf8_lower(as_array(column))
    for a, _, raw, offs in chunks(lowered, SMALL_BYTES):
        for x in range(0, len(offs) - 1, _SLICE_DOCS):
            o = offs[x:x + _SLICE_DOCS + 1]
            part = raw[o[0]:o[-1]]
            o = o - o[0]
            data = part.tobytes()
            has = np.array([any(c.isalpha() for c in data[i:j].decode("utf-8")) for i, j in zip(o[:-1], o[1:])], bool)
            yield a + x, has, trigram_counts(part, o)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(counts) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(counts.sum(axis=1) + 1).astype(np.int64), 15)


@dataclass
class Model:
    languages: list[str]        # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floors: np.ndarray          # least similarity by length class
    known_rejected: float = 0.0     # share of held-back rows that the floors reject,
    left_out_rejected: float = 0.0  # and when their own language's centroids are left out

    def predict(self, has: np.ndarray, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(has), np.zeros(len(has)), np.ones(len(has), bool)
        sim = vectors(counts, self.idf) @ self.centroids.T
        best = sim.argmax(axis=1)
        score = np.clip(sim[np.arange(len(best)), best].astype(np.float64), 0.0, 1.0)
        names = [self.languages[i] if h else UNKNOWN for i, h in zip(best.tolist(), has)]
        rejected = ~has | (score < self.floors[length_class(counts)])
        return names, np.where(has, score, 0.0), rejected


def _document_frequency(batches):
    total = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for _, has, counts in slices(batch.column("text")):
            total[:DIMS] += (counts > 0).sum(axis=0)
            total[DIMS] += has.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1, dtype=np.int32)), pa.array(total)], names=["cell", "k"])


def _sample(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for a, has, counts in slices(batch.column("text")):
            rows = np.flatnonzero(has)
            at = [np.flatnonzero(counts[i]) for i in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([langs[a + i] for i in rows], pa.string()),
                 pa.array([x.astype(np.uint16).tobytes() for x in at], pa.binary()),
                 pa.array([counts[i, x].astype(np.float32).tobytes() for i, x in zip(rows, at)], pa.binary())],
                names=["lang", "at", "n"])


def cluster(v: np.ndarray, k: int, steps: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start."""
    c = [v.mean(axis=0)]
    c[0] /= max(np.linalg.norm(c[0]), 1e-12)
    while len(c) < min(k, len(v)):
        c.append(v[np.argmin((v @ np.array(c).T).max(axis=1))])
    c = np.array(c)
    for _ in range(steps):
        own = (v @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit(training: DataFrame, centroids: int = CENTROIDS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """training(doc_id, text, lang): rows with a null text or lang are left out. The clustering sample takes rows by a hash of id and
    text, at most about ``sample_rows`` in all and SAMPLE_PER_LANGUAGE of a language."""
    spark = training.sparkSession
    bounded_batches(spark)
    rows = training.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not sizes:
        return Model([], np.zeros((0, DIMS)), np.ones(DIMS), np.zeros(16))
    df = np.zeros(DIMS + 1, np.int64)
    counted = rows.select("text").mapInArrow(_document_frequency, "cell int, k long").groupBy("cell").agg(F.sum("k").alias("k"))
    for r in counted.collect():  # DIMS + 1 rows
        df[r.cell] = r.k
    idf = np.log((1.0 + df[DIMS]) / (1.0 + df[:DIMS])) + 1.0

    per = max(16, min(SAMPLE_PER_LANGUAGE, sample_rows // len(sizes)))
    every = spark.createDataFrame([(k, -(-v // per)) for k, v in sizes.items()], "lang string, every long")
    picked = (rows.join(F.broadcast(every), "lang").where(F.pmod(F.xxhash64("doc_id", F.length("text")), "every") == 0)
              .select("lang", "text").mapInArrow(_sample, "lang string, at binary, n binary"))
    by: dict[str, list[np.ndarray]] = {}
    for r in picked.collect():  # about sample_rows sparse vectors
        v = np.zeros(DIMS, np.float32)
        v[np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.n, np.float32)
        by.setdefault(r.lang, []).append(v)
    names, found, asked, own, classes = [], [], [], [], []
    for lang in sorted(by):
        counts = np.array(sorted(by[lang], key=lambda v: v.tobytes()))  # any partition order gives one model
        v = vectors(counts, idf)
        back = np.array([zlib.crc32(x.tobytes()) % HELD_BACK == 0 for x in counts])  # equal rows on one side
        c = cluster(v if back.all() else v[~back], centroids)
        names += [lang] * len(c)
        found.append(c)
        asked.append(v[back]), own.append(np.full(back.sum(), len(found) - 1)), classes.append(length_class(counts[back]))
    if not names:
        return Model([], np.zeros((0, DIMS)), idf, np.zeros(16))
    model = Model(names, np.concatenate(found).astype(np.float32), idf, np.zeros(16))
    sim = np.stack([(np.concatenate(asked) @ c.T).max(axis=1, initial=0.0) for c in found], axis=1)
    return calibrate(model, sim, np.concatenate(own), np.concatenate(classes))


def calibrate(model: Model, sim: np.ndarray, own: np.ndarray, classes: np.ndarray) -> Model:
    """Floors from held-back rows: their similarity to each language, their own language and length class. A class pools its
    neighbours. Where known rows are nearer than left-out ones the floor lies between the two quantiles; where they are not, or nothing
    can be left out, it is ALONE_SLACK times that of the known rows. A class of few rows takes the one below."""
    known = sim.max(axis=1, initial=0.0)
    others = sim.copy()
    others[np.arange(len(own)), own] = 0.0
    left_out = others.max(axis=1, initial=0.0)
    floors = np.zeros(16)
    for k in range(16):
        near = np.abs(classes - k) <= 1
        if near.sum() < LEAST_ROWS:
            floors[k] = floors[k - 1] if k else 0.0
            continue
        low, high = np.quantile(left_out[near], LEFT_OUT_QUANTILE), np.quantile(known[near], KNOWN_QUANTILE)
        apart = sim.shape[1] > 1 and high > low
        floors[k] = low + MARGIN * (high - low) if apart else ALONE_SLACK * high
    model.floors = np.maximum.accumulate(floors)  # longer texts are closer to their centroid
    if len(own):
        model.known_rejected = float((known < model.floors[classes]).mean())
        model.left_out_rejected = float((left_out < model.floors[classes]).mean()) if sim.shape[1] > 1 else 0.0
    return model


def _predictions(model, batch):
    langs, scores, rejected = [], [], []
    for _, has, counts in slices(batch.column("text")):
        a, b, c = model.predict(has, counts)
        langs += a
        scores.append(b), rejected.append(c)
    return langs, np.concatenate([np.zeros(0), *scores]), np.concatenate([np.zeros(0, bool), *rejected])


def _predict(model, names: list[str]):
    def run(batches):
        for batch in batches:
            langs, scores, rejected = _predictions(model.value, batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(langs, pa.string()), pa.array(scores), pa.array(rejected)],
                names=[*names, "lang_pred", "lang_score", "rejected"])
    return run


def _accept(model):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(~_predictions(model.value, batch)[2]))
    return run


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, unchanged, whose text is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accept(shared), docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred, lang_score (cosine to the nearest centroid, 0 to 1) and
    rejected. Only the column ``text`` is read. A null text or one without a letter is ``und``, with score 0 and
    rejected; ties go to the first centroid in language order; without training rows everything is ``und``. Input columns of these three names are replaced."""
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "rejected")]
    schema = StructType([docs.schema[c] for c in names])
    for name, kind in (("lang_pred", StringType()), ("lang_score", DoubleType()), ("rejected", BooleanType())):
        schema = schema.add(name, kind)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # centroids x DIMS floats
    return docs.mapInArrow(_predict(shared, names), schema)
