"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts are gathered over all training texts. The filter holds, for an n-gram with
count c, the items (n-gram, 1) .. (n-gram, 1 + floor(log2 c)); a count is read back by probing levels
until one is missing. It grows with the counted items, half full at most, up to the bound of a
broadcast. Beyond that bound the n-grams under a count level stay outside, and the tokens that
need one of them get its level by a shuffle join on the n-gram's hash: every count is
used at any size. Probabilities interpolate the pair's with the
word's, add-one smoothed. The exact unigram score is kept beside it: frequent words come
from a bounded broadcast table, the others from a join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_batches, materialise, shuffle_partitions
from shelfwise.llm.textvec import Words, chunks, mix

SEGMENT_BITS = 1 << 21   # of a part of the filter, built apart
LEAST_SEGMENTS = 64      # 16 MB
MOST_SEGMENTS = 256      # 64 MB, the bound of the broadcast
PROBES = 3
SEGMENT_ITEMS = int(SEGMENT_BITS * np.log(2) / PROBES)  # half the bits
LEVELS = 48
OPEN = -1                # level of an n-gram that is looked up by a join
HEAD_WORDS = 1 << 19     # bound of the broadcast table of frequent words
BUCKET_NGRAMS = 1 << 20  # training bytes / 4 of one counting bucket, about
COUNT_BYTES = 8 << 20    # text counted together in a task
PAIR_WEIGHT = 0.7

_U = np.uint64
END = mix(np.array([0xE0D], np.uint64))[0]
START = mix(np.array([0x57A27], np.uint64))[0]


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with one END per document, hash of what precedes each, document index)."""
    w = Words(raw, offs, lower=True)
    n = len(offs) - 1
    doc = np.concatenate([w.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    h, doc = np.concatenate([w.hash, np.full(n, END)])[order], doc[order]
    before = np.concatenate([[START], h[:-1]])
    before[np.concatenate([[True], doc[1:] != doc[:-1]])[:len(h)]] = START
    return h, before[:len(h)], doc


def pair(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9FB21C651E98DF25) + h)


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return zstandard.compress(keys.tobytes() + counts.astype(np.int64).tobytes(), 1)


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.decompress(data), np.uint64)
    return x[:len(x) // 2], x[len(x) // 2:].astype(np.int64)


def _tally(parts: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate(parts)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[cut], np.diff(np.concatenate([cut, [len(keys)]]))
    n = np.concatenate(counts)[order]
    return keys[cut], np.add.reduceat(n, cut) if len(cut) else n


def _count(buckets: int):
    """Per COUNT_BYTES of text and bucket: distinct words (order 1) and pairs (order 2) with their counts."""
    def flushed(tallies):
        out = ([], [], [])
        for order, parts in zip((1, 2), tallies):
            keys, n = _tally([p[0] for p in parts], [p[1] for p in parts])
            parts.clear()
            home = (mix(keys) % _U(buckets)).astype(np.int32)
            at = np.argsort(home, kind="stable")
            keys, n, home = keys[at], n[at], home[at]
            cut = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])).tolist() + [len(home)]
            for a, b in zip(cut[:-1], cut[1:]):
                for col, v in zip(out, (int(home[a]), order, _blob(keys[a:b], n[a:b]))):
                    col.append(v)
        return pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())],
            names=["bucket", "ngram", "blob"])

    def run(batches):
        tallies, size = ([], []), 0
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column("text")):
                h, before, _ = tokens(raw, offs)
                tallies[0].append(_tally([h])), tallies[1].append(_tally([pair(before, h)]))
                size += len(raw)
                if size >= COUNT_BYTES:
                    yield flushed(tallies)
                    tallies, size = ([], []), 0
        if tallies[0]:
            yield flushed(tallies)
    return run


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Exact counts of a bucket, with how many n-grams reach each filter level."""
    rows = []
    for order in (1, 2):
        blobs = [b for o, b in zip(table.column("ngram").to_pylist(), table.column("blob").to_pylist()) if o == order]
        if blobs:
            parts = [_unblob(b) for b in blobs]
            keys, n = _tally([p[0] for p in parts], [p[1] for p in parts])
            levels = np.bincount(level(n), minlength=LEVELS)
            rows.append((order, len(keys), int(n.sum()), levels.tolist(), _blob(keys, n)))
    cols = list(zip(*rows))
    return pa.table({"ngram": pa.array(cols[0], pa.int32()), "distinct": pa.array(cols[1], pa.int64()),
                     "total": pa.array(cols[2], pa.int64()), "levels": pa.array(cols[3], pa.list_(pa.int64())),
                     "blob": pa.array(cols[4], pa.binary())})


_COUNTED = "ngram int, distinct long, total long, levels array<long>, blob binary"


def level(counts: np.ndarray) -> np.ndarray:
    """Quantised log count: 1 + floor(log2 c); 0 for 0."""
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS - 1) * (counts > 0)


def expected(levels: np.ndarray) -> np.ndarray:
    """Middle of the counts 2**(q-1) .. 2**q - 1 that share a level; 0 for level 0."""
    return np.where(levels > 0, (np.exp2(levels - 1.0) + np.exp2(levels) - 1) / 2, 0.0)


def _places(keys: np.ndarray, lev) -> list[np.ndarray]:
    """Bit positions inside the key's segment of the item (key, level)."""
    h = mix(keys + np.asarray(lev, np.uint64) * _U(0xA0761D6478BD642F))
    a, b = h & _U(0xFFFFFFFF), (h >> _U(32)) | _U(1)
    return [((a + _U(i) * b) % _U(SEGMENT_BITS)).astype(np.int64) for i in range(PROBES)]


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((mix(keys ^ _U(0x5E6)) >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)


def _admit(least: dict[int, int], segments: int):
    """Entries whose level reaches the threshold of their order, by filter segment."""
    def run(batches):
        for batch in batches:
            for order, data in zip(batch.column("ngram").to_pylist(), batch.column("blob").to_pylist()):
                keys, n = _unblob(data)
                q = level(n)
                keys, q = keys[q >= least[order]], q[q >= least[order]]
                home = _segment(keys, segments)
                for s in np.unique(home):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(s)], pa.int32()), pa.array([_blob(keys[home == s], q[home == s])], pa.binary())],
                        names=["segment", "blob"])
    return run


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    bits = np.zeros(SEGMENT_BITS, bool)
    for b in table.column("blob").to_pylist():
        keys, q = _unblob(b)
        for lev in range(1, int(q.max(initial=0)) + 1):
            for at in _places(keys[q >= lev], lev):
                bits[at] = True
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                     "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


class Filter:
    """The log-frequency Bloom filter: quantised counts by repeated membership probes."""

    def __init__(self, parts: pa.Table, segments: int):
        width = SEGMENT_BITS // 8
        self.bits, self.segments = np.zeros(segments * width, np.uint8), segments
        for i, b in zip(parts.column("segment").to_pylist(), parts.column("bits")):
            self.bits[i * width:(i + 1) * width] = np.frombuffer(b.as_buffer(), np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        base = _segment(keys, self.segments) * SEGMENT_BITS
        live = np.arange(len(keys))
        for lev in range(1, LEVELS):
            there = np.ones(len(live), bool)
            for at in _places(keys[live], lev):
                at = at + base[live]
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[there]
            if not len(live):
                break
            out[live] = lev
        return out


class Model:
    def __init__(self, bloom: Filter, least: dict[int, int], total: int, distinct: int, head: tuple[np.ndarray, np.ndarray]):
        self.filter, self.least = bloom, least
        self.total, self.distinct = total, distinct
        self.keys, self.counts = head

    def levels(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Level of each n-gram, or OPEN where it may be one that was not admitted."""
        some, at = np.unique(keys, return_inverse=True)
        q = self.filter.levels(some)
        if self.least[order] > 1:
            q = np.where(q < self.least[order], OPEN, q)  # an admitted one reaches that level
            if order == 1:
                q = np.maximum(q, np.where((c := self.head_counts(some)) > 0, level(c), OPEN))
        return q[at]

    def log10(self, h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Smoothed log10 probability of each token after its predecessor, 0 where a count is open, and what such tokens
        wait for: their places ``at``, keys and levels."""
        prev = np.where(before == START, END, before)  # a document starts as often as one ends
        both = pair(before, h)
        q = self.levels(np.concatenate([h, prev]), 1)
        own, given = q[:len(h)], q[len(h):]
        pairs = np.where(given == 0, 0, self.levels(both, 2))  # no pair after an unseen word
        late = (own == OPEN) | (given == OPEN) | (pairs == OPEN)
        c = expected(own), expected(given), expected(pairs)
        p = (c[0] + 1) / (self.total + self.distinct + 1)
        seen = given > 0
        ratio = np.minimum(c[2] / np.where(seen, c[1], 1.0), 1.0)
        p = np.where(seen, PAIR_WEIGHT * ratio + (1 - PAIR_WEIGHT) * p, p)
        at = np.flatnonzero(late)
        wait = {"at": at, "own": own[at], "given": given[at], "pairs": pairs[at],
                "h": np.where(own[at] == OPEN, h[at], 0), "prev": np.where(given[at] == OPEN, prev[at], 0),
                "both": np.where(pairs[at] == OPEN, both[at], 0)}
        return np.where(late, 0.0, np.log10(np.minimum(p, 1.0))), wait

    def head_counts(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of frequent words; 0 for the others."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.counts[at], 0)


_LATE = {"h": "long", "prev": "long", "both": "long", "own": "tinyint", "given": "tinyint", "pairs": "tinyint"}
_SCORED = ("uid long, doc_id long, n_tokens long, known long, base double, score double, rare array<long>, "
           f"late array<struct<{', '.join(f'{k}: {v}' for k, v in _LATE.items())}>>")


def _score(model):
    def run(batches):
        m = model.value
        uid = TaskContext.get().partitionId() << 34
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text")):
                h, before, doc = tokens(raw, offs)
                n = b - a
                c = m.head_counts(h)
                logs, wait = m.log10(h, before)
                score = np.bincount(doc, logs, n)
                late = pa.StructArray.from_arrays(
                    [pa.array(wait[k].astype(np.uint64).view(np.int64) if v == "long" else wait[k].astype(np.int8)) for k, v in _LATE.items()],
                    names=list(_LATE))
                late_cut = np.concatenate([[0], np.cumsum(np.bincount(doc[wait["at"]], minlength=n))])
                base = np.bincount(doc, np.log10(c + 1.0), n)
                rare = c == 0
                cut = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), batch.column("doc_id").slice(a, n),
                     pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
                     pa.array(np.bincount(doc[~rare], minlength=n).astype(np.int64)), pa.array(base), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[rare].view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(late_cut, pa.int32()), late)],
                    names=["uid", "doc_id", "n_tokens", "known", "base", "score", "rare", "late"])
                uid += n
    return run


def _ngrams(least: int, below: bool):
    """(h, c) rows of the buckets' n-grams with counts under, or from, ``least``."""
    def run(batches):
        for batch in batches:
            for b in batch.column("blob").to_pylist():
                keys, n = _unblob(b)
                pick = n < least if below else n >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[pick].view(np.int64)), pa.array(n[pick])], names=["h", "c"])
    return run


def _threshold(levels: np.ndarray, room: int) -> int:
    """Smallest level whose entries, all their levels counted, fit in ``room`` items."""
    items = np.cumsum((levels * np.arange(LEVELS))[::-1])[::-1]
    fits = np.flatnonzero(items <= room)
    return max(1, int(fits[0])) if len(fits) else LEVELS


def _looked_up(late: DataFrame, key: str, lev: str, counted: DataFrame, least: int) -> DataFrame:
    """late with its open levels ``lev`` filled in from the counts under level ``least``; 0 for n-grams without one."""
    counts = counted.mapInArrow(_ngrams(1 << (least - 1), True), "h long, c long").select(
        F.col("h").alias("k"), F.length(F.bin("c")).cast("tinyint").alias("q"), F.lit(True).alias("open"))
    is_open = F.col(lev) == OPEN
    # rows with a level already meet nothing, spread by their document
    rows = late.withColumn("k", F.when(is_open, F.col(key)).otherwise(F.col("uid"))).withColumn("open", is_open).drop(key)
    return rows.join(counts, ["k", "open"], "left").withColumn(
        lev, F.when(F.col("open"), F.coalesce("q", F.lit(0).cast("tinyint"))).otherwise(F.col(lev))).drop("k", "open", "q")


def _late_scores(scored: DataFrame, counted: DataFrame, least: dict[int, int], size: int) -> DataFrame:
    """(uid, late_score): the log probabilities of the tokens that wait for n-grams outside the filter."""
    keys = [*(["h", "prev"] if least[1] > 1 else []), *(["both"] if least[2] > 1 else [])]
    late = scored.select("uid", F.explode("late").alias("t")).select("uid", "t.own", "t.given", "t.pairs", *[f"t.{k}" for k in keys])
    for key in keys:
        order = 2 if key == "both" else 1
        lev = {"h": "own", "prev": "given", "both": "pairs"}[key]
        late = _looked_up(late, key, lev, counted.where(F.col("ngram") == order).select("blob"), least[order])

    def count(lev: str) -> F.Column:
        return F.when(F.col(lev) > 0, (F.pow(F.lit(2.0), F.col(lev) - 1) + F.pow(F.lit(2.0), F.col(lev)) - 1) / 2).otherwise(0.0)

    own = (count("own") + 1) / F.lit(float(size))
    ratio = F.least(count("pairs") / count("given"), F.lit(1.0))
    p = F.when(F.col("given") > 0, PAIR_WEIGHT * ratio + (1 - PAIR_WEIGHT) * own).otherwise(own)
    return late.groupBy("uid").agg(F.sum(F.log10(F.least(p, F.lit(1.0)))).alias("late_score"))


def score_documents(docs: DataFrame, training: DataFrame, room: int = MOST_SEGMENTS * SEGMENT_ITEMS) -> DataFrame:
    """docs(doc_id long, text) scored by a model of training(text) -> doc_id, n_tokens, n_known,
    train_tokens, base_score, score; one row per input row.

    Tokens are the words (A-Z lower-cased) and one end; a null or empty text is the end
    alone. base_score is the exact add-one unigram log10 probability, score the model's; ``room`` bounds the items of the
    broadcast filter, the other n-grams are joined. With no
    training rows every word is unknown. Repeated rows and shared ids are scored each by itself. Extra columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    size = training.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    buckets = max(shuffle_partitions(spark), size // (4 * BUCKET_NGRAMS))
    counted = materialise(
        training.select("text").mapInArrow(_count(buckets), "bucket int, ngram int, blob binary")
        .groupBy("bucket").applyInArrow(_merge, _COUNTED), "ngrams")
    stats = {o: (0, 0, np.zeros(LEVELS, np.int64)) for o in (1, 2)}
    sums = counted.groupBy("ngram").agg(
        F.sum("distinct"), F.sum("total"), *[F.sum(F.get("levels", F.lit(i))) for i in range(LEVELS)])
    for r in sums.collect():  # two rows
        stats[r[0]] = (r[1], r[2], np.array(r[3:], np.int64))
    distinct, total, levels = stats[1]

    # words first, pairs in what is left
    least = {1: _threshold(levels, room // 2)}
    used = int((levels * np.arange(LEVELS))[least[1]:].sum())
    least[2] = _threshold(stats[2][2], room - used)
    used += int((stats[2][2] * np.arange(LEVELS))[least[2]:].sum())
    segments = max(LEAST_SEGMENTS, -(-used // SEGMENT_ITEMS))
    parts = (counted.select("ngram", "blob").mapInArrow(_admit(least, segments), "segment int, blob binary")
             .groupBy("segment").applyInArrow(_build, "segment int, bits binary"))
    bloom = Filter(parts.toArrow(), segments)  # MOST_SEGMENTS rows at most

    uni = counted.where("ngram = 1").select("blob")
    from_top = np.cumsum(levels[::-1])[::-1]
    frequent = 1 << max(0, int(np.flatnonzero(from_top <= HEAD_WORDS)[0]) - 1)  # least count of a head word
    rows = uni.mapInArrow(_ngrams(frequent, False), "h long, c long").toArrow()  # at most HEAD_WORDS rows
    keys = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    head = keys[order], rows.column("c").to_numpy()[order]
    model = spark.sparkContext.broadcast(Model(bloom, least, total, distinct, head))

    scored = materialise(docs.select("doc_id", "text").mapInArrow(_score(model), _SCORED), "scored")
    rare = scored.select("uid", F.explode("rare").alias("h"))
    counts = uni.mapInArrow(_ngrams(frequent, True), "h long, c long")
    more = rare.join(counts, "h").groupBy("uid").agg(
        F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("rest"))
    norm = float(np.log10(total + distinct + 1))
    score = F.col("score")
    out = scored.drop("rare", "late").join(more, "uid", "left")
    if max(least.values()) > 1:
        out = out.join(_late_scores(scored, counted, least, total + distinct + 1), "uid", "left")
        score = score + F.coalesce("late_score", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"), score.alias("score"))
