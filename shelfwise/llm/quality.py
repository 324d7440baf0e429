"""Document quality by hierarchical empirical Bayes.

A logistic classifier on text shape and selected words gives each document's evidence (a log
likelihood ratio) for two targets, ``quality`` and ``toxic``. Grouped sums over all documents give every host
and every first path segment below it a beta posterior: paths shrink toward their host, hosts
toward the global rate, by strengths estimated from the spread between the groups. A document's posterior odds are the odds of
its site, without its own share, times its evidence.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

from shelfwise.llm.common import held_out, materialise, row_key
from shelfwise.llm.textvec import Words, chunks

SAMPLE_ROWS = 16_384     # bound of the labelled rows that the classifier is fitted on
WORD_FEATURES = 512      # most selected words of a target
LEAST_GAIN = 24.0        # likelihood-ratio statistic of a selected word
SOFT_WEIGHT = 0.25       # share of an unlabelled document in its site's counts
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e6
HOT_SHARE = 64           # a group with over 1/64 of all rows is hot; there are at most 64 of them
TARGETS = {"quality": 1.0, "toxic": 0.0}  # name -> value of a clean document
BINS = 8
_CELL_SHIFT = np.uint64(40)  # 24-bit word cells
_SLICE_DOCS = 4096
_MICRO = 1_000_000       # counts are whole millionths, so sums do not depend on their order

_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = _ALNUM[128:] = True
_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[10] = False
_CLASSES = np.zeros((7, 256), bool)
_CLASSES[0, 65:91] = True                                   # capitals
_CLASSES[1, 48:58] = True                                   # digits
_CLASSES[2, 128:] = True                                    # beyond ASCII
_CLASSES[3, [9, 11, 12, 13, 32]] = True                     # blanks
_CLASSES[4, 10] = True                                      # line ends
_CLASSES[5, [ord(c) for c in ".,;:!?'\""]] = True           # sentence marks
_CLASSES[6] = ~(_ALNUM | _CLASSES[3] | _CLASSES[4] | _CLASSES[5])  # symbols
SHAPES = 18


def _repetition(words: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document: distinct entries, sum of their squared counts, entries equal to the one before."""
    adjacent = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    repeats = np.bincount(words.doc[1:][adjacent], minlength=n)
    order = np.lexsort((words.hash, words.doc))
    h, d = words.hash[order], words.doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(h))).astype(np.float64)
    return (np.bincount(d[at], minlength=n), np.bincount(d[at], weights=times * times, minlength=n), repeats)


def features(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, Words]:
    """Shape features (documents x SHAPES) of one chunk of texts, and its lower-cased words."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(np.float64)
    w = Words(raw, offs, lower=True, table=_ALNUM)
    count = w.counts()
    some = np.maximum(count, 1).astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(w.doc, weights=length, minlength=n) / some
    spread = np.sqrt(np.maximum(np.bincount(w.doc, weights=length * length, minlength=n) / some - mean * mean, 0))
    distinct, squares, repeats = _repetition(w, n)
    lines = Words(raw, offs, table=_NOT_NEWLINE)
    n_lines = np.maximum(lines.counts(), 1).astype(np.float64)
    own_lines, line_squares, line_repeats = _repetition(lines, n)
    columns = [np.log1p(count), mean, spread, distinct / some, squares / some ** 2, repeats / some, some / n_lines,
               own_lines / n_lines, line_squares / n_lines ** 2, line_repeats / n_lines, np.log1p(n_lines)]
    for row in _CLASSES:
        run = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(row[raw], out=run[1:])
        columns.append((run[offs[1:]] - run[offs[:-1]]) / size)
    return np.column_stack(columns).astype(np.float32), w


@dataclass
class Classifier:
    """A fitted target; without labels of both kinds the cells are empty and the evidence is 0."""
    cells: np.ndarray     # sorted word cells
    weights: np.ndarray   # intercept, scaled shapes, shape bins, word cells
    slope: float
    offset: float
    prior: float          # log odds of the label in the fitted sample

    def evidence(self, shape: np.ndarray, scale: Scale, doc: np.ndarray, cell: np.ndarray) -> np.ndarray:
        n = len(shape)
        if not len(self.weights):
            return np.zeros(n)
        k = scale.width
        z = np.concatenate([scale.design(shape[a:a + _SLICE_DOCS]) @ self.weights[:k] for a in range(0, n, _SLICE_DOCS)])
        if len(self.cells):
            at = np.minimum(np.searchsorted(self.cells, cell), len(self.cells) - 1)
            hit = self.cells[at] == cell
            pair = np.unique(doc[hit] * len(self.cells) + at[hit])
            z = z + np.bincount(pair // len(self.cells), weights=self.weights[k + pair % len(self.cells)], minlength=n)
        return np.clip(self.slope * z + self.offset, -30, 30) - self.prior


@dataclass
class Scale:
    """Centre, spread and bin edges of the shape features over the sample."""
    centre: np.ndarray
    spread: np.ndarray
    edges: np.ndarray
    width: int = 1 + SHAPES * (1 + BINS)

    @staticmethod
    def of(shape: np.ndarray) -> Scale:
        edges = np.quantile(shape, np.arange(1, BINS) / BINS, axis=0)
        return Scale(shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6), edges.astype(np.float32))

    def design(self, shape: np.ndarray) -> np.ndarray:
        n = len(shape)
        out = np.zeros((n, self.width), np.float32)
        out[:, 0] = 1
        out[:, 1:1 + SHAPES] = np.clip((shape - self.centre) / self.spread, -4, 4)
        rows = np.arange(n)
        for j in range(SHAPES):
            out[rows, 1 + SHAPES + j * BINS + np.searchsorted(self.edges[:, j], shape[:, j])] = 1
        return out


@dataclass
class Model:
    scale: Scale
    targets: dict[str, Classifier]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps (the first column is barely penalised)."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        s = (p * (1 - p) + 1e-6).astype(x.dtype)
        step = np.linalg.solve((x.T @ (x * s[:, None])).astype(np.float64) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 10 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-5:
            break
    return w


def select_words(doc: np.ndarray, cell: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cells whose presence tells most about y (likelihood-ratio statistic), at most WORD_FEATURES, sorted."""
    ids, place = np.unique(cell, return_inverse=True)
    inside = np.stack([np.bincount(place, weights=(y[doc] == v), minlength=len(ids)) for v in (0, 1)])
    total = np.array([[(y == 0).sum()], [(y == 1).sum()]], np.float64)
    with_it = inside.sum(axis=0)
    gain = np.zeros(len(ids))
    for seen, share in ((inside, with_it / len(y)), (total - inside, 1 - with_it / len(y))):
        gain += 2 * (seen * np.log(np.maximum(seen, 1e-12) / np.maximum(total * share, 1e-12))).sum(axis=0)
    good = np.flatnonzero((gain >= LEAST_GAIN) & (with_it >= 8))
    return np.sort(ids[good[np.lexsort((ids[good], -gain[good]))][:WORD_FEATURES]])


def fit_target(scale: Scale, shape: np.ndarray, doc: np.ndarray, cell: np.ndarray, y: np.ndarray) -> Classifier:
    """y: 0, 1 or nan (not labelled). Three quarters of the labelled rows fit the weights, the others calibrate them."""
    held = np.arange(len(y)) % 4 == 3
    use, ask = (~np.isnan(y)) & ~held, (~np.isnan(y)) & held
    if any(np.nansum(y[rows] == v) < 2 for rows in (use, ask) for v in (0, 1)):
        return Classifier(np.zeros(0, np.uint32), np.zeros(0), 1.0, 0.0, 0.0)
    number = np.cumsum(use) - 1
    inside = use[doc]
    cells = select_words(number[doc[inside]], cell[inside], y[use])

    x = scale.design(shape)
    if len(cells):
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        hit = cells[at] == cell
        present = np.zeros((len(shape), len(cells)), np.float32)
        present[doc[hit], at[hit]] = 1
        x = np.concatenate([x, present], axis=1)
    w = logistic(x[use], y[use], penalty=1.0)
    z = x[ask] @ w
    offset, slope = logistic(np.column_stack([np.ones(len(z)), z]), y[ask], penalty=1e-2)
    rate = (y[use].sum() + 0.5) / (use.sum() + 1)
    return Classifier(cells, w, max(float(slope), 0.0), float(offset), math.log(rate / (1 - rate)))


def _labels(labels: DataFrame) -> DataFrame:
    """One row per non-null doc_id: 0 or 1 of each target (the mean of repeated labels, a half counts as 1), null if never given."""
    means = [(F.avg(F.col(t).cast("double")) >= 0.5).cast("int").alias(f"y_{t}") for t in TARGETS]
    return labels.where("doc_id is not null").groupBy("doc_id").agg(*means)


def _sample(batches):
    for batch in batches:
        got = []
        for a, _, raw, offs in chunks(batch.column("text")):
            shape, w = features(raw, offs)
            cell = (w.hash >> _CELL_SHIFT).astype(np.uint32)
            for i in range(len(shape)):
                if w.first[i + 1] > w.first[i]:
                    words = np.unique(cell[w.first[i]:w.first[i + 1]])
                    got.append((a + i, shape[i].tobytes(), words.tobytes()))
        part = batch.select([f"y_{t}" for t in TARGETS]).take(pa.array([g[0] for g in got], pa.int64()))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.binary())],
                                         names=[*part.schema.names, "shape", "cells"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Classifiers from docs(doc_id, text) and labels(doc_id, quality, toxic): at most ``sample_rows`` labelled documents, chosen by a
    hash. Texts without a word are left out."""
    known = _labels(labels)
    h = F.xxhash64("doc_id")
    every = max(1, -(-known.count() // sample_rows))
    picked = known.where(F.pmod(h, F.lit(every)) == 0).orderBy(h, "doc_id").limit(sample_rows)  # bounds the broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", *[f"y_{t}" for t in TARGETS])
    got = (found.mapInArrow(_sample, ", ".join(f"y_{t} int" for t in TARGETS) + ", shape binary, cells binary")
           .orderBy(F.xxhash64("shape", "cells"), "shape", "cells", *[f"y_{t}" for t in TARGETS]).limit(sample_rows).collect())
    if not got:
        none = np.zeros(SHAPES, np.float32)
        empty = Classifier(np.zeros(0, np.uint32), np.zeros(0), 1.0, 0.0, 0.0)
        return Model(Scale(none, none + 1, np.zeros((BINS - 1, SHAPES), np.float32)), {t: empty for t in TARGETS})
    shape = np.frombuffer(b"".join(r.shape for r in got), np.float32).reshape(-1, SHAPES)
    cell = np.frombuffer(b"".join(r.cells for r in got), np.uint32)
    doc = np.repeat(np.arange(len(got)), [len(r.cells) // 4 for r in got])
    often, times = np.unique(cell, return_counts=True)
    keep = np.isin(cell, often[times >= 8])
    doc, cell = doc[keep], cell[keep]
    scale = Scale.of(shape)
    return Model(scale, {t: fit_target(scale, shape, doc, cell, np.array([np.nan if r[f"y_{t}"] is None else r[f"y_{t}"] for r in got], float))
                         for t in TARGETS})


def _evidence(shared, names: list[str]):
    def run(batches):
        model = shared.value
        for batch in batches:
            counts, found = [np.zeros(0, np.int64)], {t: [np.zeros(0)] for t in TARGETS}
            for _, _, raw, offs in chunks(batch.column("text")):
                shape, w = features(raw, offs)
                cell = (w.hash >> _CELL_SHIFT).astype(np.uint32)
                counts.append(w.counts().astype(np.int64))
                for t in TARGETS:
                    e = model.targets[t].evidence(shape, model.scale, w.doc, cell)
                    found[t].append(np.where(counts[-1] > 0, np.round(e, 9), 0.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names] + [pa.array(np.concatenate(counts))] + [pa.array(np.concatenate(found[t])) for t in TARGETS],
                names=[*names, "n_words", *[f"e_{t}" for t in TARGETS]])
    return run


def site_parts(site: F.Column) -> tuple[F.Column, F.Column]:
    """Host (lower case) and first path segment of a URL or of a plain source name; both empty for null."""
    whole = F.coalesce(site.cast("string"), F.lit(""))
    rest = F.regexp_replace(whole, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    return F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*(/[^/?#]*)", 1)


def _logit(p: F.Column) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _odds_to_p(z: F.Column) -> F.Column:
    return 1 / (1 + F.exp(-z))


def _with_groups(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """rows with the columns of their group. Groups with over 1/HOT_SHARE of ``total`` rows, at most HOT_SHARE of them, are
    broadcast; the others are joined by a shuffle in which no key is hot."""
    hot = groups.where(F.col("n_rows") * HOT_SHARE > total).drop("n_rows")
    cold = groups.where(F.col("n_rows") * HOT_SHARE <= total).drop("n_rows")
    rest = rows.join(F.broadcast(hot.select(*key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def _strength(spread: float | None, cells: float | None, size: float | None, variance: float | None) -> float:
    """Pseudo-count of a beta prior from the spread between its groups. spread: sum of n (rate - parent rate)^2; cells: degrees of freedom;
    size: their weight N - sum n^2 / N less the degrees of freedom. No spread beyond chance gives the greatest strength."""
    if not size or size <= 0 or not variance or variance <= 0:
        return MOST_STRENGTH
    rho = (spread / variance - cells) / size
    return round(min(max(1 / rho - 1, LEAST_STRENGTH), MOST_STRENGTH), 3) if rho > 0 else MOST_STRENGTH


def judge(docs: DataFrame, labels: DataFrame, model: Model, site: F.Column | None = None) -> DataFrame:
    """One row per row of docs(doc_id, text, source, ...): doc_id, row_id (``row_key`` of doc_id and text), host, path, n_words, and for
    quality and toxic the classifier's probability (doc_*), the site's posterior without the document's own share (site_*) and the
    document's posterior (*_score); keep is quality_score >= 0.5 and toxic_score < 0.5. ``labels`` are the labels that sites may learn
    from. ``site`` defaults to the column source, and to one common site without it.

    A text that is null, empty or without a word has scores 0 and is not kept, and does not count for its site. A null
    site is a site of its own. Repeated rows get equal results, one each. Other columns of docs and labels are not read. Without labels the
    rates are those of one clean document, so every text with a word is kept; an empty table gives no rows."""
    spark = docs.sparkSession
    if site is None:
        site = F.col("source") if "source" in docs.columns else F.lit(None)
    host, path = site_parts(site)
    id_type = docs.schema["doc_id"]
    names = ["doc_id", "row_id", "host", "path"]
    schema = (StructType([id_type]).add("row_id", LongType()).add("host", StringType()).add("path", StringType())
              .add("n_words", LongType()))
    for t in TARGETS:
        schema = schema.add(f"e_{t}", DoubleType())
    asked = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_id"), host.alias("host"), path.alias("path"), "text")
    shared = spark.sparkContext.broadcast(model)  # about 2 * (shapes + WORD_FEATURES) numbers
    scored = asked.mapInArrow(_evidence(shared, names), schema)

    rows = scored.join(_labels(labels), "doc_id", "left")
    for t in TARGETS:
        p = _odds_to_p(F.col(f"e_{t}") + model.targets[t].prior) if len(model.targets[t].weights) else F.lit(None).cast("double")
        weight = F.when(F.col("n_words") == 0, 0).when(F.col(f"y_{t}").isNotNull(), _MICRO).when(p.isNotNull(), int(SOFT_WEIGHT * _MICRO)).otherwise(0)
        rows = (rows.withColumn(f"doc_{t}", F.when(F.col("n_words") == 0, 0.0).otherwise(p)).withColumn(f"n_{t}", weight.cast("long"))
                .withColumn(f"k_{t}", F.round(F.col(f"n_{t}") * F.coalesce(F.col(f"y_{t}").cast("double"), p, F.lit(0.0))).cast("long")))
    rows = materialise(rows.drop(*[f"y_{t}" for t in TARGETS]), "quality-rows")

    sums = [F.sum(f"{x}_{t}").alias(f"{x}_{t}") for t in TARGETS for x in "nk"]
    paths = materialise(rows.groupBy("host", "path").agg(*sums, F.count("*").alias("n_rows")), "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(f"{x}_{t}").alias(f"h{x}_{t}") for t in TARGETS for x in "nk"],
                                      *[F.sum(F.pow(F.col(f"n_{t}") / _MICRO, 2)).alias(f"sq_{t}") for t in TARGETS],
                                      *[F.sum((F.col(f"n_{t}") > 0).cast("long")).alias(f"paths_{t}") for t in TARGETS],
                                      F.count("*").alias("n_rows"))
    hosts = materialise(hosts, "quality-hosts")
    total = hosts.agg(F.sum("n_rows").alias("paths"), *[F.sum(f"h{x}_{t}").alias(f"{x}_{t}") for t in TARGETS for x in "nk"]).first()
    tree = _with_groups(paths, hosts, ["host"], total["paths"] or 0)

    rate, over_hosts, over_paths = {}, [], []
    for t, clean in TARGETS.items():
        rate[t] = ((total[f"k_{t}"] or 0) / _MICRO + clean) / ((total[f"n_{t}"] or 0) / _MICRO + 1)
        hn, hp = F.col(f"hn_{t}") / _MICRO, F.try_divide(f"hk_{t}", f"hn_{t}")
        n, p = F.col(f"n_{t}") / _MICRO, F.try_divide(f"k_{t}", f"n_{t}")
        dof = F.greatest(F.col(f"paths_{t}") - 1, F.lit(0))
        over_hosts += [F.sum(hn * F.pow(hp - rate[t], 2)).alias(f"s_{t}"), F.sum((hn > 0).cast("long")).alias(f"c_{t}"), F.sum(hn * hn).alias(f"q_{t}"),
                       F.sum(dof).alias(f"pc_{t}"), F.sum(hn - F.try_divide(F.col(f"sq_{t}"), hn) - dof).alias(f"pz_{t}"), F.sum(hn * hp * (1 - hp)).alias(f"pv_{t}")]
        over_paths += [F.sum(n * F.pow(p - hp, 2)).alias(f"ps_{t}")]
    a, b = hosts.agg(*over_hosts).first(), tree.agg(*over_paths).first()  # one row each

    out = _with_groups(rows, tree.select("host", "path", "n_rows", *[F.col(f"{x}_{t}").alias(f"p{x}_{t}") for t in TARGETS for x in "nk"],
                                         *[f"h{x}_{t}" for t in TARGETS for x in "nk"]), ["host", "path"], rows.count())
    for t in TARGETS:
        size = (total[f"n_{t}"] or 0) / _MICRO
        cells = (a[f"c_{t}"] or 1) - 1
        sh = _strength(a[f"s_{t}"], cells, size - (a[f"q_{t}"] or 0) / size - cells if size else 0, rate[t] * (1 - rate[t]))
        sp = _strength(b[f"ps_{t}"], a[f"pc_{t}"], a[f"pz_{t}"], (a[f"pv_{t}"] or 0) / size if size else 0)
        own_n, own_k = F.col(f"n_{t}"), F.col(f"k_{t}")
        at_host = (sh * rate[t] + (F.col(f"hk_{t}") - own_k) / _MICRO) / (sh + (F.col(f"hn_{t}") - own_n) / _MICRO)
        at_path = (sp * at_host + (F.col(f"pk_{t}") - own_k) / _MICRO) / (sp + (F.col(f"pn_{t}") - own_n) / _MICRO)
        out = (out.withColumn(f"site_{t}", at_path)
               .withColumn(f"{t}_score", F.when(F.col("n_words") == 0, 0.0).otherwise(_odds_to_p(_logit(F.col(f"site_{t}")) + F.col(f"e_{t}")))))
    keep = (F.col("n_words") > 0) & (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)
    return out.select(*names, "n_words", *[c for t in TARGETS for c in (f"doc_{t}", f"site_{t}", f"{t}_score")], keep.alias("keep"))


def kept(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, that ``judged`` (of the same docs) keeps."""
    good = judged.where("keep").select(F.col("row_id").alias("__row_id")).distinct()
    return docs.withColumn("__row_id", row_key(F.col("doc_id"), F.col("text"))).join(good, "__row_id", "left_semi").select(*docs.columns)


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels outside the held-out quarter of the ids."""
    return labels.where(~held_out(F.col("doc_id"), 4, 2))
