"""N-gram Jaccard join by a grouped prefix join.

Two documents link when the Jaccard similarity of their word-shingle sets reaches the
threshold. A set's *prefix* (its first ``n - ceil(t n) + 1`` shingles in one global order,
common shingles last) must share a shingle with the prefix of every set that links to it.

1. One pass: shingle set size and digest per document, and a fixed-size table of shingle
   counts whose heavy cells define "common". Equal sets collapse into one class.
2. Second pass: the prefix of every class. Shingles are dealt to buckets, and those in one
   class only are dropped there; common shingles skip the buckets, so that no bucket grows
   with one hot shingle. Classes with equal prefix and size collapse into one group.
3. Star round: in every shingle's list of groups each group meets one centre; members are
   verified exactly and linked. Tight groups of near copies merge here in linear work.
4. Rest: lists that still hold more than one component are joined, every group outside the
   list's largest component against the others; pairs of groups are filtered by size and by
   parity bitmaps (a lower bound of the symmetric difference, so no link is lost), expanded
   to members of different components and verified exactly.

Shingles are compared by 64-bit hashes, sets by 128-bit digests plus size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import bounded_batches, materialise, row_key, shuffle_partitions
from shelfwise.llm.components import connected_components
from shelfwise.llm.textvec import SMALL_BYTES, Words, chunks, grams, mix, whole

CELL_BITS = 20          # count table of 2**20 cells
SEGMENTS = 64           # in which the table is added up
HOT_FACTOR, HOT_LEAST = 8, 64   # a cell is common beyond this many times the mean and this count
COUNT_AT_ONCE = 1 << 19  # shingles added to a task's count table in one go
MAP_WORDS = 8           # 64-bit words of a parity bitmap
BUCKET_ROWS = 1 << 20   # shingles of the input per bucket
SEEN_SETS = 1 << 16     # sets that a task remembers to skip repeats early; repeats it misses meet in the next shuffle
BROADCAST_IDS = 1 << 20  # at most so many ids are broadcast to pick documents; beyond: shuffle join

_U = np.uint64


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk (lower-cased A-Z)."""
    w = Words(raw, offs, lower=True)
    g = grams(w.hash, words)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= words:
            s = np.sort(g[a:b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            out.append(whole(w.hash[a:b])[None])
        else:
            out.append(g[:0])
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    with np.errstate(over="ignore"):
        a = mix(s ^ _U(0x51)).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mix(s * _U(0xC2B2AE3D27D4EB4F) + _U(7))) if len(s) else _U(0)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def parity_map(s: np.ndarray) -> np.ndarray:
    """Parity of the set's elements per bit position: two maps differ in at most as many
    bits as the sets differ in elements."""
    at = mix(s ^ _U(0xA5A5)) % _U(64 * MAP_WORDS)
    bits = (np.bincount(at.astype(np.int64), minlength=64 * MAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view(np.int64)


def needed(n: int, percent: int) -> int:
    """Smallest overlap with a set of at least equal size that can reach the threshold."""
    return -(-percent * n // 100)


def _pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _profiles(words: int):
    names = [c.split()[0] for c in _PROFILE.split(", ")]

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.int64)  # of all batches of the task
        waiting, found = [], 0
        for batch in batches:
            n, d1, d2 = [], [], []
            for _, _, raw, offs in chunks(batch.column("text"), SMALL_BYTES):
                sets = shingle_sets(raw, offs, words)
                for s in sets:
                    x, y = digest(s)
                    n.append(len(s)), d1.append(x), d2.append(y)
                waiting.append((np.concatenate(sets) >> _U(64 - CELL_BITS)).astype(np.int32))
                found += len(waiting[-1])
                if found > COUNT_AT_ONCE:
                    cells += np.bincount(np.concatenate(waiting), minlength=1 << CELL_BITS)
                    waiting, found = [], 0
            m = len(n)
            if not m:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(m, np.int32)), batch.column("row_key"), batch.column("doc_id"), pa.array(n, pa.int32()),
                 pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.nulls(m, pa.binary())], names=names)
        if waiting:
            cells += np.bincount(np.concatenate(waiting), minlength=1 << CELL_BITS)
        parts = [(i, _pack(np.minimum(p, 0xFFFFFFFF).astype(np.uint32))) for i, p in enumerate(cells.reshape(SEGMENTS, -1)) if p.any()]
        k = len(parts)
        if k:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array([i for i, _ in parts], pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                 pa.array([b for _, b in parts], pa.binary())], names=names)
    return run


_PROFILE = "kind int, row_key long, doc_id long, n int, d1 long, d2 long, blob binary"


def _add_cells(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = np.zeros((1 << CELL_BITS) // SEGMENTS, np.int64)
    for b in table.column("blob").to_pylist():
        total += np.frombuffer(zstandard.decompress(b), np.uint32)
    return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                     "cells": pa.array([total.tobytes()], pa.binary())})


def common_cells(profiles: DataFrame) -> np.ndarray:
    """One flag per cell of the fixed-size count table (2**CELL_BITS bits)."""
    cells = np.zeros((SEGMENTS, (1 << CELL_BITS) // SEGMENTS), np.int64)
    rows = (profiles.where("kind = 1").select(F.col("n").alias("segment"), "blob")
            .groupBy("segment").applyInArrow(_add_cells, "segment int, cells binary"))
    for r in rows.collect():  # SEGMENTS rows, 8 MB in all, whatever the input
        cells[r.segment] = np.frombuffer(r.cells, np.int64)
    cells = cells.ravel()
    return cells > max(HOT_LEAST, HOT_FACTOR * cells.mean())


_PREFIX = ("kind int, bucket int, blob binary, lid long, d1 long, d2 long, n int, gkey long, "
           + ", ".join(f"m{i} long" for i in range(MAP_WORDS)))


def _prefixes(words: int, percent: int, buckets: int, common):
    schema_null = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.int64()] * MAP_WORDS
    names = [c.split()[0] for c in _PREFIX.split(", ")]

    def blobs(kind, bucket, tok, lid):
        order = np.argsort(bucket, kind="stable")
        bucket, tok, lid = bucket[order], tok[order], lid[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.concatenate([cut[1:], [len(bucket)]])
        data = [_pack(tok[a:b], lid[a:b]) for a, b in zip(cut, ends)]
        k = len(data)
        cols = [pa.array(np.full(k, kind, np.int32)), pa.array(bucket[cut].astype(np.int32)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(cols + [pa.nulls(k, t) for t in schema_null[2:]], names=names)

    def run(batches):
        hot = np.unpackbits(np.frombuffer(common.value, np.uint8)).astype(bool)
        nxt = TaskContext.get().partitionId() << 34  # ids are written with the task's output, so they agree
        seen = set()
        for batch in batches:
            toks, lids, rows = [], [], []
            if len(seen) > SEEN_SETS:
                seen.clear()
            for _, _, raw, offs in chunks(batch.column("text"), SMALL_BYTES):
                for s in shingle_sets(raw, offs, words):
                    n = len(s)
                    if not n or (key := (n, *digest(s))) in seen:
                        continue
                    seen.add(key)
                    h = hot[(s >> _U(64 - CELL_BITS)).astype(np.int64)]
                    p = n - needed(n, percent) + 1
                    cold = s[~h]
                    pre = cold[:p] if len(cold) >= p else np.concatenate([cold, s[h][:p - len(cold)]])
                    toks.append(pre), lids.append(np.full(len(pre), nxt, np.int64))
                    gkey = int(mix(pre.sum(dtype=np.uint64, keepdims=True) + _U(n)).view(np.int64)[0])
                    rows.append((nxt, key[1], key[2], n, gkey, *parity_map(s).tolist()))
                    nxt += 1
            if not rows:
                continue
            k = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(k, np.int32)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
                + [pa.array(c, t) for c, t in zip(zip(*rows), schema_null[2:])], names=names)
            tok, lid = np.concatenate(toks), np.concatenate(lids)
            h = hot[(tok >> _U(64 - CELL_BITS)).astype(np.int64)]
            if not h.all():
                yield blobs(1, mix(tok[~h]) % _U(buckets), tok[~h], lid[~h])
            if h.any():  # any bucket will do: these are only unpacked
                yield blobs(2, np.zeros(int(h.sum()), np.int64), tok[h], lid[h])
    return run


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(zstandard.decompress(blob), np.int64)
    return x[:len(x) // 2], x[len(x) // 2:]


def _shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """(token, class) rows of tokens that two classes of the bucket have."""
    parts = [_unpack(b) for b in table.column("blob").to_pylist()]
    tok, lid = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(tok, kind="stable")
    tok, lid = tok[order], lid[order]
    same = tok[1:] == tok[:-1]
    keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    return pa.table({"token": tok[keep], "lid": lid[keep]})


def _unpacked(batches):
    for batch in batches:
        for b in batch.column("blob").to_pylist():
            tok, lid = _unpack(b)
            yield pa.RecordBatch.from_arrays([pa.array(tok), pa.array(lid)], names=["token", "lid"])


def _sets(words: int):
    def run(batches):
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text"), SMALL_BYTES):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(a, b - a),
                     pa.array([s.view(np.int64) for s in shingle_sets(raw, offs, words)], pa.list_(pa.int64()))],
                    names=["rep", "items"])
    return run


def _long_maps(words: int):
    def run(batches):
        """Parity maps with at least as many bits as the set has elements, a power of two."""
        for batch in batches:
            for a, b, raw, offs in chunks(batch.column("text"), SMALL_BYTES):
                n, out = [], []
                for s in shingle_sets(raw, offs, words):
                    bits = 1 << max(9, len(s).bit_length())
                    at = (mix(s ^ _U(0x3C3C)) % _U(bits)).astype(np.int64)
                    n.append(len(s))
                    out.append(np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rep").slice(a, b - a), pa.array(n, pa.int32()), pa.array(out, pa.binary())],
                    names=["rep", "n", "map"])
    return run


def _near(percent: int):
    def run(batches):
        """Pairs that their long maps do not tell apart; the longer map is folded onto the other."""
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "ma", "mb"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
                differ = int(np.bitwise_count(x ^ y).sum())
                keep.append(differ * (100 + percent) <= (100 - percent) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose shingle sets reach the threshold, verified on the texts
    of one document of each class; long parity maps sort out most of the others first."""
    pairs = materialise(pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                        .distinct(), "pairs")
    maps = materialise(_texts(pairs, classes, docs).mapInArrow(_long_maps(words), "rep long, n int, map binary")
                       .dropDuplicates(["rep"]), "maps")
    near = materialise(pairs.join(maps.toDF("a", "na", "ma"), "a").join(maps.toDF("b", "nb", "mb"), "b")
                       .mapInArrow(_near(percent), "a long, b long"), "near")
    sets = materialise(_texts(near, classes, docs).mapInArrow(_sets(words), "rep long, items array<long>")
                       .dropDuplicates(["rep"]), "sets")
    both = F.size(F.array_intersect("x", "y"))
    return materialise(
        near.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        .where(both * (100 + percent) >= percent * (F.size("x") + F.size("y"))).select("a", "b"), "verified")


def _texts(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, text) of the classes in the pairs; where several rows carry a class's text, all of them."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
    wanted = materialise(classes.join(ids, "rep").select(F.col("any_key").alias("row_key"), "rep"), "wanted")
    small = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if small else wanted, "row_key").select("rep", "text")


def _far_apart(l: str, r: str, percent: int) -> F.Column:
    """True when sizes or bitmaps prove that no member of group l links to one of group r.
    Bits on which a group's members disagree (and != or) are left out: still a lower bound."""
    differ = reduce(lambda x, y: x + y, [
        F.bit_count(F.col(f"{l}.and{i}").bitwiseXOR(F.col(f"{r}.and{i}"))
                    .bitwiseAND(F.bitwise_not(F.col(f"{l}.and{i}").bitwiseXOR(F.col(f"{l}.or{i}"))))
                    .bitwiseAND(F.bitwise_not(F.col(f"{r}.and{i}").bitwiseXOR(F.col(f"{r}.or{i}")))))
        for i in range(MAP_WORDS)])
    n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
    # |x ^ y| <= (1 - t) / (1 + t) (|x| + |y|) for every linked pair
    return ((100 * F.least(n, m) < percent * F.greatest(n, m))
            | (differ * (100 + percent) > (100 - percent) * (n + m)))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """docs(doc_id long, text string, ...) -> (doc_id, n_shingles, component_id, row_key, label), one row per
    input row; row_key is the row's own (``common.row_key`` of id and text) and label names the component.

    Words are runs of non-space characters, A-Z lower-cased. A set holds the distinct
    ``words``-word shingles; a text with fewer words has its whole sequence as the only one;
    null or blank texts have the empty set (n_shingles 0) and stay alone. Rows link when
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id reachable.
    Rows are compared by text: rows that share a doc_id keep their own result, and a null doc_id takes part in
    linking but never becomes a component's id unless nothing else is there. Extra columns are ignored."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row_key"))
    profiles = materialise(docs.mapInArrow(_profiles(words), _PROFILE), "profiles", by="kind")
    rows = profiles.where("kind = 0").select("row_key", "doc_id", "n", "d1", "d2")
    hot = common_cells(profiles)
    total = rows.agg(F.sum("n")).first()[0] or 0
    common = spark.sparkContext.broadcast(np.packbits(hot).tobytes())  # 2**CELL_BITS bits
    buckets = max(shuffle_partitions(spark), total // BUCKET_ROWS)

    prefix = materialise(docs.select("text").mapInArrow(_prefixes(words, percent, buckets, common), _PREFIX),
                         "prefix", by="kind")
    local = prefix.where("kind = 0").drop("kind", "bucket", "blob")
    reps = local.groupBy("n", "d1", "d2").agg(F.min("lid").alias("rep"))
    local = materialise(local.join(reps, ["n", "d1", "d2"]), "classes")
    shared = (prefix.where("kind = 1").select("bucket", "blob").groupBy("bucket")
              .applyInArrow(_shared, "token long, lid long")
              .union(prefix.where("kind = 2").select("blob").mapInArrow(_unpacked, "token long, lid long")))
    lists = materialise(shared.join(local.select("lid", "rep", "gkey", "n"), "lid")
                        .select("token", "gkey", "n").distinct(), "lists")

    members = local.where(F.col("lid") == F.col("rep")).select(
        "rep", "gkey", "n", "d1", "d2", *[f"m{i}" for i in range(MAP_WORDS)])
    maps = [f(f"m{i}").alias(f"{name}{i}") for i in range(MAP_WORDS)
            for f, name in ((F.bit_and, "and"), (F.bit_or, "or"))]

    # each class has its smallest id, and one row by which its text is fetched again
    first = rows.where("n > 0").groupBy("n", "d1", "d2").agg(
        F.min("doc_id").alias("least_id"), F.min("row_key").alias("any_key"))
    classes = materialise(members.join(first, ["n", "d1", "d2"])
                          .select("rep", "n", "d1", "d2", "least_id", "any_key"), "ids")

    # star round: every group against one centre of each list, every member against one of its group
    # a table of its own, so that nothing but the exchange is under its joins and the adaptive skew join can split a hot centre
    groups = materialise(members.groupBy("gkey", "n").agg(F.min("rep").alias("centre"), *maps), "groups")
    centre = (lists.groupBy("token").agg(F.min(F.struct(F.xxhash64("gkey").alias("h"), "gkey", "n")).alias("c"),
                                         F.count(F.lit(1)).alias("k")).where("k > 1")
              .select("token", F.col("c.gkey").alias("g"), F.col("c.n").alias("gn")))
    met = lists.join(centre, "token").where("gkey != g or n != gn").select("gkey", "n", "g", "gn").distinct()
    l, r = groups.alias("l"), groups.alias("r")
    met = (met.join(l, (met.gkey == F.col("l.gkey")) & (met.n == F.col("l.n")))
           .join(r, (met.g == F.col("r.gkey")) & (met.gn == F.col("r.n")))
           .where(~_far_apart("l", "r", percent))
           .select(met.gkey, met.n, F.col("r.centre").alias("b")))
    pairs = (met.join(members.select("gkey", "n", F.col("rep").alias("a")), ["gkey", "n"]).select("a", "b")
             .union(members.join(groups.select("gkey", "n", F.col("centre").alias("b")), ["gkey", "n"])
                    .select(F.col("rep").alias("a"), "b")))
    links = _verified(pairs, classes, docs, words, percent)

    # the rest: members by component, lists with more than one of them
    comp = connected_components(links)
    named = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "comp", F.coalesce("label", "rep"))
    units = materialise(named.groupBy("gkey", "n", "comp").agg(*maps), "units")
    mixed = lists.join(units.select("gkey", "n", "comp"), ["gkey", "n"])
    sizes = mixed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    major = (sizes.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("x"), F.count(F.lit(1)).alias("comps"))
             .where("comps > 1").select("token", F.col("x.comp").alias("major")))
    open_ = materialise(mixed.join(major, "token").join(units, ["gkey", "n", "comp"]), "open")
    minor = open_.where("comp != major").alias("l")
    every = open_.alias("r")
    once = (F.col("r.comp") == F.col("r.major")) | (F.col("l.comp") < F.col("r.comp"))
    # a shuffled join: a frequent shingle's list is split by the adaptive skew join
    side = lambda x: F.struct(F.col(f"{x}.gkey").alias("g"), F.col(f"{x}.n").alias("n"), F.col(f"{x}.comp").alias("c"))
    met = (minor.join(every.hint("merge"), (F.col("l.token") == F.col("r.token")) & (F.col("l.comp") != F.col("r.comp"))
                      & once & ~_far_apart("l", "r", percent))
           .select(F.least(side("l"), side("r")).alias("x"), F.greatest(side("l"), side("r")).alias("y"))
           .groupBy("x", "y").agg(F.count(F.lit(1)).alias("common")))
    # what two sets share is what their prefixes share and at most what follows one of these
    after = lambda n: F.ceil(n * percent / 100) - 1
    least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    met = (met.where(F.col("common") + F.greatest(after(F.col("x.n")), after(F.col("y.n"))) >= least)
           .select(F.col("x.g").alias("ga"), F.col("x.n").alias("na"), F.col("x.c").alias("ca"),
                   F.col("y.g").alias("gb"), F.col("y.n").alias("nb"), F.col("y.c").alias("cb")))
    bits = [f"m{i}" for i in range(MAP_WORDS)]
    who = materialise(named.select("rep", "gkey", "n", "comp", *bits), "members")
    a = who.select(F.col("rep").alias("a"), F.col("gkey").alias("ga"), F.col("n").alias("na"), F.col("comp").alias("ca"),
                   *[F.col(b).alias(f"x{b}") for b in bits])
    b = who.select(F.col("rep").alias("b"), F.col("gkey").alias("gb"), F.col("n").alias("nb"), F.col("comp").alias("cb"),
                   *[F.col(b).alias(f"y{b}") for b in bits])
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"x{m}").bitwiseXOR(F.col(f"y{m}"))) for m in bits])
    pairs = (met.join(a, ["ga", "na", "ca"]).join(b, ["gb", "nb", "cb"])
             .where(differ * (100 + percent) <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b"))
    links = links.union(_verified(pairs, classes, docs, words, percent))

    comp = connected_components(links)
    label = (classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
             .select("n", "d1", "d2", "least_id", F.coalesce("label", "rep").alias("label")))
    least = label.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = label.join(least, "label").select("n", "d1", "d2", "component_id", "label")
    return (rows.join(named, ["n", "d1", "d2"], "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                    "row_key", "label"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """docs with one row of each component, the one with the smallest doc_id (null ids last); rows without words all stay."""
    found = jaccard_components(docs, words, percent)
    first = found.where("label is not null").groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("x"))
    keep = first.select("x.row_key", F.lit(1).alias("most")).union(
        found.where("label is null").select("row_key", F.lit(None).cast("int")).distinct())
    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), F.struct(*docs.columns).alias("row"))
    rank = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))  # repeats of one row
    return (keyed.join(keep, "row_key").withColumn("rank", rank)
            .where("most is null or rank <= most").select("row.*"))
