"""Exact substring deduplication by super-k-mer partitioning.

A window is ``size`` consecutive words. Each window is keyed by its minimiser, the
smallest-hashed run of ``MINI`` words in it; consecutive windows sharing one minimiser travel
as one packed string (a super-k-mer) to the bucket of that minimiser, where equal windows
always meet and a sort of the window hashes, with a check of the words, counts them exactly.

Skew: inside a batch equal super-k-mers collapse into the smallest document that has them (the others are
settled there, since a smaller document is known), so a passage found everywhere sends
one string per batch; what is settled goes by its row, not by the bucket of the passage, so the rows that hold a frequent
one spread over all buckets; windows of minimisers that are frequent, by a fixed-size count table, are
dealt one by one by the hash of the whole window instead of by the minimiser.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise, row_key, shuffle_partitions
from shelfwise.llm.textvec import Words, chunks, grams, mix, ranges

MINI = 2                # words of a minimiser
CELL_BITS = 16          # count table of minimisers
HOT_FACTOR, HOT_LEAST = 16, 4096
BUCKET_WINDOWS = 128_000  # windows of the input per bucket

_U = np.uint64


def _runs(w: Words, size: int, hot: np.ndarray | None):
    """Super-k-mers of a chunk: (first word, number of windows, minimiser hash, window hash).

    Windows of a frequent minimiser come out singly, and are keyed by their own hash."""
    n = len(w)
    first = np.flatnonzero(w.doc[:max(0, n - size + 1)] == w.doc[size - 1:]) if n >= size else np.zeros(0, np.int64)
    if not len(first):
        return first, first, np.zeros(0, np.uint64)
    g = grams(w.hash, MINI)
    span = size - MINI + 1
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    at = np.empty(len(view), np.int64)
    for a in range(0, len(view), 1 << 16):
        at[a:a + (1 << 16)] = view[a:a + (1 << 16)].argmin(axis=1)
    at = at[first] + first          # word position of each window's minimiser
    key = g[at]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != first[:-1] + 1)])
    if hot is not None:
        common = hot[(key >> _U(64 - CELL_BITS)).astype(np.int64)]
        new |= common
        if common.any():
            key = np.where(common, grams(w.hash, size)[first], key)
    s = np.flatnonzero(new)
    return first[s], np.diff(np.concatenate([s, [len(first)]])), key[s]


def _count(size: int):
    """Per batch: the minimisers' counts by cell, and the number of windows."""
    def run(batches):
        total = np.zeros((1 << CELL_BITS) + 1, np.int64)
        for batch in batches:
            for _, _, raw, offs in chunks(batch.column("text")):
                _, k, key = _runs(Words(raw, offs), size, None)
                total[:-1] += np.bincount((key >> _U(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
                total[-1] += k.sum()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "k"])
    return run


def _frame(parts: list[bytes]) -> bytes:
    return zstandard.compress(b"".join(len(p).to_bytes(8, "little") + p for p in parts), 3)


def _unframe(blob: bytes) -> list[bytes]:
    data, out, at = zstandard.decompress(blob), [], 0
    while at < len(data):
        n = int.from_bytes(data[at:at + 8], "little")
        out.append(data[at + 8:at + 8 + n])
        at += 8 + n
    return out


SLAB_BYTES = 4 << 20    # text among which equal super-k-mers collapse


def _slabs(column):
    """Chunks of a batch in runs of about SLAB_BYTES."""
    slab, size = [], 0
    for chunk in chunks(column):
        slab.append(chunk)
        size += len(chunk[2])
        if size >= SLAB_BYTES:
            yield slab
            slab, size = [], 0
    if slab:
        yield slab


def _by_bucket(home: np.ndarray, pick: np.ndarray):
    """(bucket, rows) for the picked rows."""
    pick = pick[np.argsort(home[pick], kind="stable")]
    cut = np.flatnonzero(np.concatenate([[True], home[pick][1:] != home[pick][:-1]])).tolist() + [len(pick)]
    for x, y in zip(cut[:-1], cut[1:]):
        if y > x:
            yield int(home[pick[x]]), pick[x:y]


def _deal(size: int, buckets: int, hot_flags):
    def run(batches):
        hot = np.unpackbits(np.frombuffer(hot_flags.value, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            for slab in _slabs(batch.column("text")):
                best: dict[bytes, int] = {}     # packed string -> smallest document of the slab
                strings, docs, rows, starts, lens, homes = [], [], [], [], [], []
                for a, _, raw, offs in slab:
                    w = Words(raw, offs)
                    s, k, key = _runs(w, size, hot)
                    if not len(s):
                        continue
                    # words joined by one space, then one slice per super-k-mer
                    width = w.end - w.start
                    to = np.concatenate([[0], np.cumsum(width + 1)])
                    text = np.full(int(to[-1]), 32, np.uint8)
                    text[ranges(to[:-1], width)] = w.raw[ranges(w.start, width)]
                    text = text.tobytes()
                    lo, hi = to[s], to[s + k + size - 1] - 1
                    strings += [text[x:y] for x, y in zip(lo.tolist(), hi.tolist())]
                    row = w.doc[s] + a
                    docs.append(ids[row]), rows.append(keys[row])
                    starts.append(s - w.first[w.doc[s]]), lens.append(k)
                    homes.append((mix(key ^ _U(0x77)) % _U(buckets)).astype(np.int64))
                if not strings:
                    continue
                doc, row = np.concatenate(docs), np.concatenate(rows)
                start, num, home = np.concatenate(starts), np.concatenate(lens), np.concatenate(homes)
                for x, d in zip(strings, doc.tolist()):
                    if best.setdefault(x, d) > d:
                        best[x] = d
                done = doc > np.fromiter((best[x] for x in strings), np.int64, len(strings))
                out = ([], [], [])
                for bucket, at in _by_bucket(home, np.flatnonzero(~done)):
                    parts = [doc[at].tobytes(), row[at].tobytes(), start[at].astype(np.int32).tobytes(),
                             b"\n".join([strings[i] for i in at])]
                    out[0].append(bucket), out[1].append(False), out[2].append(_frame(parts))
                # a smaller document of the slab has every window of these: they need no meeting
                last = start + num + size - 1
                by_row = (mix(row.view(np.uint64)) % _U(buckets)).astype(np.int64)
                for bucket, at in _by_bucket(by_row, np.flatnonzero(done)):
                    parts = [row[at].tobytes(), start[at].astype(np.int32).tobytes(), last[at].astype(np.int32).tobytes()]
                    out[0].append(bucket), out[1].append(True), out[2].append(_frame(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int32()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.binary())],
                    names=["bucket", "settled", "blob"])
    return run


def _merged(row: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Table:
    """Ranges of each row key, joined where they touch."""
    order = np.lexsort((first, row))
    row, first, last = row[order], first[order], last[order]
    if not len(row):
        return pa.table({"row_key": pa.array(row, pa.int64()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})
    new = np.concatenate([[True], row[1:] != row[:-1]])
    # running maximum of the range ends inside each row key
    group = np.cumsum(new)
    span = np.int64(last.max()) + 1
    reach = np.maximum.accumulate(group * span + last) - group * span
    new |= np.concatenate([[True], first[1:] > reach[:-1]])
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(row)]]) - 1
    return pa.table({"row_key": pa.array(row[new], pa.int64()), "first": pa.array(first[new].astype(np.int32)),
                     "last": pa.array(reach[ends].astype(np.int32))})


def _repeats(size: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Word ranges of the windows that a smaller document starts too."""
        doc, row, start, text = [], [], [], []
        ranges_ = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for settled, blob in zip(table.column("settled").to_pylist(), table.column("blob").to_pylist()):
            parts = _unframe(blob)
            if settled:
                for col, p, kind in zip(ranges_, parts, (np.int64, np.int32, np.int32)):
                    col.append(np.frombuffer(p, kind).astype(np.int64))
                continue
            for col, p, kind in zip((doc, row, start), parts, (np.int64, np.int64, np.int32)):
                col.append(np.frombuffer(p, kind).astype(np.int64))
            text.append(parts[3])
        if text:
            doc, row, start = np.concatenate(doc), np.concatenate(row), np.concatenate(start)
            raw = np.frombuffer(b"\n".join(text), np.uint8)
            ends = np.concatenate([np.flatnonzero(raw == 10) + 1, [len(raw)]])
            w = Words(raw, np.concatenate([[0], ends]))
            first = np.flatnonzero(w.doc[:len(w) - size + 1] == w.doc[size - 1:])  # every string has a window
            h = grams(w.hash, size)[first]
            order = np.argsort(h, kind="stable")
            h, first = h[order], first[order]
            same = h[1:] == h[:-1]
            first = first[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            owner = doc[w.doc[first]]
            data, least = raw.tobytes(), {}
            # the words themselves decide, not the hash
            windows = [data[x:y] for x, y in zip(w.start[first].tolist(), w.end[first + size - 1].tolist())]
            for x, d in zip(windows, owner.tolist()):
                if least.setdefault(x, d) > d:
                    least[x] = d
            hit = first[owner > np.fromiter((least[x] for x in windows), np.int64, len(windows))]
            string = w.doc[hit]
            at = start[string] + hit - w.first[string]
            for col, v in zip(ranges_, (row[string], at, at + size)):
                col.append(v)
        return _merged(*(np.concatenate(c) for c in ranges_))
    return run


def _kept(batches):
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        spans = batch.column("spans").to_pylist()
        for a, _, raw, offs in chunks(batch.column("text")):
            w = Words(raw, offs, hashes=False)
            data = raw.tobytes()
            for i, (x, y) in enumerate(zip(w.first[:-1], w.first[1:])):
                gone = np.zeros(y - x + 1, np.int64)
                for s in spans[a + i] or ():
                    gone[s["first"]] += 1
                    gone[s["last"]] -= 1
                stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + x
                n_words.append(int(y - x)), n_removed.append(int(y - x - len(stay)))
                kept.append(b" ".join([data[p:q] for p, q in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array([k.decode("utf-8") for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeated_windows(docs: DataFrame, size: int = 13) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, n_words, n_removed, kept_text), one row per input row.

    Words are runs of non-space characters, unchanged. A word goes when a window of ``size`` words covers it
    whose words also start in a document with a smaller doc_id; windows are judged on the input. ``kept_text`` has the words left,
    joined by one space. Null and blank texts have no words; texts of fewer words than a
    window keep all. Rows with a null doc_id are kept whole and make no other row lose words; rows that
    share a doc_id are judged each by its own text, against smaller ids. Extra columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    known = docs.where("doc_id is not null")
    counts = known.select("text").mapInArrow(_count(size), "cell int, k long").groupBy("cell").agg(F.sum("k").alias("k"))
    cells = np.zeros((1 << CELL_BITS) + 1, np.int64)
    for r in counts.collect():  # at most 2**CELL_BITS + 1 rows
        cells[r.cell] = r.k
    windows, cells = int(cells[-1]), cells[:-1]
    hot = cells > max(HOT_LEAST, HOT_FACTOR * cells.mean())
    buckets = max(shuffle_partitions(spark), windows // BUCKET_WINDOWS)
    flags = spark.sparkContext.broadcast(np.packbits(hot).tobytes())  # 2**CELL_BITS bits

    found = (known.mapInArrow(_deal(size, buckets, flags), "bucket int, settled boolean, blob binary")
             .groupBy("bucket").applyInArrow(_repeats(size), "row_key long, first int, last int"))
    # written first: the super-k-mers' shuffle is over before the texts' begins
    spans = materialise(found.distinct().groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("spans")),
                        "spans")
    return (docs.join(spans, "row_key", "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string"))


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))

