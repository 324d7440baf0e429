"""Token sequences by dominance reduction and best fit.

Packing works on the histogram of piece lengths (at most ``capacity`` numbers), so it costs the same
for any number of documents: sets that provably dominate every alternative (Martello and
Toth) are fixed for good, best fit decreasing packs what remains, and the outcome is a short table of runs
"ranks a.. of length n go to sequences b.. at offset o". Pieces then look their place up by
their rank among equal lengths.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise
from shelfwise.llm.textvec import chunks

CACHE_WORDS = 1_000_000  # distinct words kept per worker (about 0.2 GB); then the cache starts anew
MARK = b"|"              # stands between words that are encoded in one call
RANK_ROWS = 1 << 14    # rows of one rank group
MAX_SPLITS = 4096

_cache: dict[bytes, bytes] = {}
_tokenizer = {}


def _load(path: str):
    if path not in _tokenizer:
        from tokenizers import Tokenizer
        _tokenizer.clear()
        _cache.clear()
        _tokenizer[path] = Tokenizer.from_file(path)
    return _tokenizer[path]


def token_bytes(texts: list[bytes], path: str) -> list[bytes]:
    """Token ids of UTF-8 texts as little-endian uint32 bytes. The tokenizer drops white space and never joins
    across it, so words (split at ASCII white space) are encoded once each and looked up."""
    tok = _load(path)
    words = [t.split() for t in texts]
    if len(_cache) > CACHE_WORDS:
        _cache.clear()
    missing = list(set().union(*words).difference(_cache)) if words else []
    plain = [w for w in missing if MARK not in w]
    mark = tok.encode(MARK.decode(), add_special_tokens=False).ids
    for a in range(0, len(plain), 1 << 12):
        some = plain[a:a + (1 << 12)]
        text = (b" " + MARK + b" ").join(some).decode("utf-8")
        ids = np.asarray(tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cut = np.flatnonzero(ids == mark[0])
        data = ids.tobytes()
        for w, x, y in zip(some, [0, *(4 * cut + 4).tolist()], [*(4 * cut).tolist(), len(data)]):
            _cache[w] = data[x:y]
    marked = [w for w in missing if MARK in w]
    for w, e in zip(marked, tok.encode_batch_fast([w.decode("utf-8") for w in marked], add_special_tokens=False)):
        _cache[w] = np.asarray(e.ids, "<u4").tobytes()
    return [b"".join(map(_cache.__getitem__, w)) for w in words]


def _pieces(path: str, capacity: int, end_id: int, release: bool):
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text")):
                data = raw.tobytes()
                out = [[], [], [], [], []]
                ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                texts = [data[x:y] for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
                for doc, tokens in zip(ids, token_bytes(texts, path)):
                    tokens += end
                    for k, at in enumerate(range(0, len(tokens), 4 * capacity)):
                        part = tokens[at:at + 4 * capacity]
                        for col, v in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if release:
            _cache.clear()
    return run


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, release: bool = False) -> DataFrame:
    """One row per piece: each document's ids and then ``end_id``, cut only beyond ``capacity``. With ``release`` a
    task gives its cache of encoded words back at its end, for jobs whose workers go on to other stages."""
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer, capacity, end_id, release), "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Runs of equal lengths: copies of length ``size`` with ranks from ``rank`` on fill sequences
    from ``sequence`` on, ``per`` copies in each, from ``offset`` on."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: c for s, c in histogram.items() if c}
        self.rank = dict.fromkeys(self.left, 0)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.reduce()
        self.fixed = self.sequences
        self.best_fit()

    def _take(self, size: int, sequence: int, offset: int, bins: int, per: int) -> None:
        self.runs.append((size, self.rank[size], sequence, offset, per))
        self.rank[size] += bins * per
        self.left[size] -= bins * per
        if not self.left[size]:
            del self.left[size]

    def _fix(self, a: int, b: int | None, bins: int) -> None:
        self._take(a, self.sequences, 0, bins, 2 if a == b else 1)
        if b is not None and b != a:
            self._take(b, self.sequences, a, bins, 1)
        self.sequences += bins

    def reduce(self) -> None:
        """Fix sets that dominate all others holding the same piece. {a, b} does if they fill
        a sequence exactly (what else goes with a fits into b's place), or if no two pieces
        fit beside a and b is the longest that does; {a} does if nothing fits beside it."""
        for a in sorted(self.left, reverse=True):
            b = self.capacity - a
            if a in self.left and b in self.left and a >= b:
                bins = self.left[a] // 2 if a == b else min(self.left[a], self.left[b])
                if bins:
                    self._fix(a, b, bins)
        sizes = sorted(self.left)
        while sizes:
            a = sizes[-1]
            # the two shortest beside one copy of a
            short = [s for s in sizes[:3] for _ in range(min(2, self.left[s] - (s == a)))][:2]
            if len(short) == 2 and a + sum(short) <= self.capacity:
                break
            others = [s for s in (a, *reversed(sizes[:bisect.bisect_right(sizes, self.capacity - a)]))
                      if a + s <= self.capacity and self.left[s] - (s == a) > 0][:1]
            if not others:
                self._fix(a, None, self.left[a] if not short or a + short[0] > self.capacity else 1)
            else:
                b = others[0]
                self._fix(a, b, max(1, self.left[a] // 2 if a == b else min(self.left[a], self.left[b])))
            sizes = [s for s in sizes if s in self.left]

    def best_fit(self) -> None:
        """Best fit decreasing, all copies of a length at once: open sequences are runs
        (first sequence, count) by the room left."""
        rooms: list[int] = []
        runs: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, run: tuple[int, int]) -> None:
            if room and run[1]:
                if room not in runs:
                    bisect.insort(rooms, room)
                runs.setdefault(room, []).append(run)

        for size in sorted(self.left, reverse=True):
            while size in self.left:
                i = bisect.bisect_left(rooms, size)
                if i < len(rooms):
                    room = rooms[i]
                    first, bins = runs[room].pop()
                    if not runs[room]:
                        del runs[room], rooms[i]
                else:
                    room, first = self.capacity, self.sequences
                    bins = -(-self.left[size] // (room // size))
                    self.sequences += bins
                per = room // size
                full = min(bins, self.left[size] // per)
                if full:
                    self._take(size, first, self.capacity - room, full, per)
                    put(room - per * size, (first, full))
                rest = self.left.get(size, 0)
                if bins > full and rest:  # fewer copies than one sequence takes
                    self._take(size, first + full, self.capacity - room, 1, rest)
                    put(room - rest * size, (first + full, 1))
                    full += 1
                put(room, (first + full, bins - full))

    def table(self) -> np.ndarray:
        return np.array(sorted(self.runs), np.int64).reshape(-1, 5)


def _place(runs):
    def run(batches):
        size, rank, sequence, offset, per = np.frombuffer(runs.value, np.int64).reshape(-1, 5).T
        for batch in batches:
            n = batch.column("length").to_numpy()
            r = batch.column("rank").to_numpy()
            # runs are sorted by (size, rank): one search over a joint key
            span = np.int64(max(int(rank.max(initial=0)), int(r.max(initial=0))) + 1)
            i = np.searchsorted(size * span + rank, n * span + r, "right") - 1
            d = r - rank[i]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in names]
                + [pa.array(sequence[i] + d // per[i]), pa.array(offset[i] + d % per[i] * size[i])],
                names=[*names, "sequence_id", "offset"])
    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, release: bool = False) -> DataFrame:
    """docs(doc_id long, text string, ...) -> one row per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset.

    Sequences hold at most ``capacity`` tokens; places are gapless from 0. A null or empty text
    is its end token alone. Rows are packed as they come: repeated rows and shared ids get places of their own. Extra
    columns are ignored. ``release``: see ``token_pieces``; the rows are the same."""
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, release), "pieces")
    counts = {r.length: r.k for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("k")).collect()}  # <= capacity rows
    packing = Packing(counts, capacity)
    # rank among equal lengths: frequent lengths are split, and each part starts where the last ended
    splits = int(min(MAX_SPLITS, max(16, sum(counts.values()) // RANK_ROWS)))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(splits)).cast("int"))
    first = (dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("k"))
             .select("length", "part", (F.sum("k").over(Window.partitionBy("length").orderBy("part")) - F.col("k")).alias("first")))
    at = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("at", at).join(first, ["length", "part"]).withColumn("rank", F.col("first") + F.col("at"))
    runs = spark.sparkContext.broadcast(packing.table().tobytes())  # a few runs per length
    return ranked.drop("part", "at", "first").mapInArrow(
        _place(runs), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
