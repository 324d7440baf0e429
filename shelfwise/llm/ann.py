"""Approximate nearest neighbours with robust-pruned directed graphs, one per shard.

Equal vectors are one node that keeps its smallest ids, so a vector repeated without bound stays one node
and loses no answer. Nodes are dealt to shards by a hash of the vector; each shard builds its graph
by greedy searches that propose neighbours and relaxed distance pruning that keeps diverse
edges, in two passes; nodes that no path from the entries reaches get an edge from the nearest that one does.
Searches start from entries spread over the shard, so that no far cluster is missed. Every query meets every shard, in blocks, by beam search; the shards' best
are merged by exact score.

Inner product is searched as distance after one more coordinate lifts all vectors of a shard
to equal length. Greedy search and pruning run for a batch of nodes at a time in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

SHARD_NODES = 8192
DEGREE = 32
BEAM = 72
ALPHA = 1.2
ENTRIES = 24        # spread starts of every search
SPARE = 8           # edges a node may take on for unreached ones
BATCH = 512
QUERY_BLOCK = 8192


class Graph:
    """Directed neighbour graph over the rows of x (float32); ``edges`` holds -1 where free."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam, self.alpha = x, degree, beam, np.float32(alpha * alpha)
        self.norm = np.einsum("nd,nd->n", x, x)
        self.edges = np.full((len(x), degree + SPARE), -1, np.int32)
        self.entries = self._spread()

    def _spread(self) -> np.ndarray:
        """The node nearest to the mean, then each time the node farthest from those taken."""
        if not len(self.x):
            return np.zeros(0, np.int64)
        taken = [int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin())]
        away = np.full(len(self.x), np.inf, np.float32)
        while len(taken) < min(ENTRIES, self.beam, len(self.x)):
            away = np.minimum(away, self.norm + self.norm[taken[-1]] - 2 * (self.x @ self.x[taken[-1]]))
            away[taken] = -np.inf
            taken.append(int(away.argmax()))
        return np.array(taken, np.int64)

    def build(self, seed: int = 7) -> Graph:
        order = np.random.default_rng(seed).permutation(len(self.x))
        order = np.concatenate([self.entries, order[~np.isin(order, self.entries)]])
        at, size = 0, len(self.entries)
        while at < len(order):  # batches grow with the graph that they search
            self._link(order[at:at + size])
            at += size
            size = min(BATCH, 2 * size)
        for at in range(0, len(order), BATCH):  # again, in the whole graph
            self._link(order[at:at + BATCH])
        return self._reach()

    def _link(self, nodes: np.ndarray) -> None:
        found, _ = self.search(self.x[nodes], self.beam)
        found = np.concatenate([found, self.edges[nodes, :self.degree]], axis=1)
        self.edges[nodes, :self.degree] = self.prune(nodes, found)
        self._back(nodes)

    def reached(self) -> np.ndarray:
        """Which nodes a path from an entry reaches."""
        met = np.zeros(len(self.x), bool)
        front = self.entries
        while len(front):
            met[front] = True
            near = np.unique(self.edges[front])
            near = near[near >= 0]
            front = near[~met[near]]
        return met

    def _reach(self) -> Graph:
        """Every node on some path: the nearest reached node with room takes an edge to an unreached one, until none is left."""
        while True:
            met = self.reached()
            lost = np.flatnonzero(~met)
            if not len(lost):
                return self
            for a in range(0, len(lost), BATCH):
                some = lost[a:a + BATCH]
                found, _ = self.search(self.x[some], self.beam)
                for node, near in zip(some, found):
                    near = near[near >= 0]
                    room = near[self.edges[near, -1] < 0]
                    if not len(room):  # all full: any reached node does
                        room = np.flatnonzero(met & (self.edges[:, -1] < 0))
                    to = self.edges[room[0], self.degree:]
                    to[(to < 0).argmax()] = node
                    met[node] = True

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search for each row of q: (nodes, squared distances less |q|**2), nearest first, -1 padded."""
        b = len(q)
        ids = np.full((b, beam), -1, np.int64)
        dist = np.full((b, beam), np.inf, np.float32)
        done = np.ones((b, beam), bool)
        start = self.entries[:beam]
        ids[:, :len(start)], done[:, :len(start)] = start, False
        dist[:, :len(start)] = self.norm[start] - 2 * (q @ self.x[start].T)
        near_first = np.argsort(dist, axis=1, kind="stable")
        ids, dist, done = (np.take_along_axis(a, near_first, axis=1) for a in (ids, dist, done))
        met = np.zeros((b, len(self.x)), bool)
        met[:, start] = True
        live = np.arange(b)
        while len(live):
            first = (~done[live]).argmax(axis=1)
            open_ = ~done[live, first]
            live, first = live[open_], first[open_]
            if not len(live):
                break
            done[live, first] = True
            near = self.edges[ids[live, first]]
            new = near >= 0
            near = np.where(new, near, 0)
            new &= ~met[live[:, None], near]
            rows, cols = np.nonzero(new)
            met[live[rows], near[rows, cols]] = True
            d = np.full(near.shape, np.inf, np.float32)
            v = near[rows, cols]
            d[rows, cols] = self.norm[v] - 2 * np.einsum("nd,nd->n", self.x[v], q[live[rows]])
            all_d = np.concatenate([dist[live], d], axis=1)
            top = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            take = lambda a, c: np.take_along_axis(np.concatenate([a, c], axis=1), top, axis=1)
            ids[live] = take(ids[live], np.where(new, near, -1))
            done[live] = take(done[live], ~new)
            dist[live] = np.take_along_axis(all_d, top, axis=1)
        return ids, dist

    def prune(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Robust pruning: keep the nearest candidate, drop those much nearer to it than to
        the node, and go on, until ``degree`` are kept."""
        c = np.where(found == nodes[:, None], -1, found)
        ok = c >= 0
        c = np.where(ok, c, 0)
        x, p = self.x[c], self.x[nodes]
        n = self.norm[c]
        own = np.where(ok, n + self.norm[nodes][:, None] - 2 * np.einsum("bcd,bd->bc", x, p), np.inf)
        order = np.argsort(own, axis=1, kind="stable")
        c, own, x, n = (np.take_along_axis(a, order if a.ndim == 2 else order[:, :, None], axis=1) for a in (c, own, x, n))
        ok = np.isfinite(own)
        between = n[:, :, None] + n[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        out = np.full((len(nodes), self.degree), -1, np.int32)
        row = np.arange(len(nodes))
        for k in range(self.degree):
            pick = ok.argmax(axis=1)
            there = ok[row, pick]
            if not there.any():
                break
            out[there, k] = c[row, pick][there]
            ok &= ~(self.alpha * between[row, pick] <= own) | ~there[:, None]
            ok[row, pick] = False
            # equal candidates may stand in the list twice
            ok &= c != np.where(there, c[row, pick], -1)[:, None]
        return out

    def _back(self, nodes: np.ndarray) -> None:
        """Edges back from the new nodes' neighbours; full lists are pruned again."""
        to = self.edges[nodes, :self.degree]
        src, dst = np.repeat(nodes, self.degree), to.ravel()
        new = (dst >= 0) & ~(self.edges[dst, :self.degree] == src[:, None]).any(axis=1)  # -1 reads the last row, to no effect
        src, dst = src[new], dst[new]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        while len(dst):
            new = np.concatenate([[True], dst[1:] != dst[:-1]])
            start = np.flatnonzero(new)
            rank = np.arange(len(dst)) - np.repeat(start, np.diff(np.concatenate([start, [len(dst)]])))
            now = rank < self.degree  # at most so many at a time; hubs take more rounds
            who = dst[start]
            slot = np.cumsum(new) - 1
            more = np.full((len(who), self.degree), -1, np.int64)
            more[slot[now], rank[now]] = src[now]
            both = np.concatenate([self.edges[who, :self.degree].astype(np.int64), more], axis=1)
            for a in range(0, len(who), BATCH):
                some = slice(a, a + BATCH)
                full = (both[some] >= 0).sum(axis=1) > self.degree
                packed = np.take_along_axis(both[some], np.argsort(both[some] < 0, axis=1, kind="stable"), axis=1)
                self.edges[who[some], :self.degree] = packed[:, :self.degree]
                if full.any():
                    self.edges[who[some][full], :self.degree] = self.prune(who[some][full], both[some][full])
            src, dst = src[~now], dst[~now]


def lifted(v: np.ndarray) -> np.ndarray:
    """One more coordinate that gives every row the largest row's length."""
    sq = np.einsum("nd,nd->n", v, v)
    return np.concatenate([v, np.sqrt(np.maximum(sq.max(initial=0.0) - sq, 0.0))[:, None]], axis=1).astype(np.float32)


def _distinct(k: int, shards: int):
    """Per batch: distinct vectors with their k + 1 smallest ids, dealt to shards."""
    import zlib

    def run(batches):
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            v = batch.column("v")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # -0.0 becomes 0.0
            offs = v.offsets.to_numpy() - v.offsets[0].as_py()
            for i, (a, b) in zip(batch.column("vec_id").to_pylist(), zip(offs[:-1], offs[1:])):
                seen.setdefault(flat[a:b].tobytes(), []).append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(x) // 8 for x in seen], pa.int32()), pa.array([zlib.crc32(x) % shards for x in seen], pa.int32()),
                 pa.array(list(seen), pa.binary()), pa.array([sorted(set(s))[:k + 1] for s in seen.values()], pa.list_(pa.int64()))],
                names=["dim", "shard", "vec", "ids"])
    return run


def _build(k: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        nodes: dict[bytes, list[int]] = {}
        for x, ids in zip(table.column("vec").to_pylist(), table.column("ids").to_pylist()):
            nodes[x] = sorted({*nodes[x], *ids})[:k + 1] if x in nodes else ids
        names = sorted(nodes)  # the graph doesn't depend on the rows' order
        v = np.frombuffer(b"".join(names), "<f8").reshape(len(names), -1)
        g = Graph(lifted(v)).build()
        return pa.table({
            "dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
            "entries": pa.array([g.entries.tolist()], pa.list_(pa.int64())), "vectors": pa.array([b"".join(names)], pa.binary()),
            "edges": pa.array([g.edges.tobytes()], pa.binary()),
            "ids": pa.array([[nodes[x] for x in names]], pa.list_(pa.list_(pa.int64())))})
    return run


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], index: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and queries.num_rows:
            dim = key[0].as_py()
            v = np.frombuffer(index.column("vectors")[0].as_py(), "<f8").reshape(-1, dim)
            g = Graph(lifted(v))
            g.entries = np.array(index.column("entries")[0].as_py(), np.int64)
            g.edges = np.frombuffer(index.column("edges")[0].as_py(), np.int32).reshape(len(v), -1)
            ids = index.column("ids")[0].as_py()
            qid = queries.column("query_id").to_pylist()
            q = np.array(queries.column("v").to_pylist(), "<f8").reshape(len(qid), dim)
            for a in range(0, len(qid), BATCH):
                part = q[a:a + BATCH]
                found, _ = g.search(np.concatenate([part, np.zeros((len(part), 1))], axis=1).astype(np.float32), BEAM)
                for i, row in enumerate(found):
                    row = row[row >= 0]
                    exact = v[row] @ part[i]
                    near = sorted((-s, i2) for s, r in zip(exact.tolist(), row.tolist()) for i2 in ids[r]
                                  if i2 != qid[a + i])
                    best: dict[int, float] = {}
                    for s, i2 in near:  # an id's best vector comes first
                        best.setdefault(i2, -s)
                        if len(best) == k:
                            break
                    for i2, s in best.items():
                        out[0].append(qid[a + i]), out[1].append(i2), out[2].append(s)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})
    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows with an id whose vector is not null, not zero and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null")
            .where(finite & F.exists("v", lambda x: x != 0)))


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20) -> DataFrame:
    """vectors(vec_id long, embedding array, ...) -> (query_id, rank, vec_id, score): for each row whose
    vec_id is divisible by ``query_every`` the k rows found with the largest inner product, the
    row itself left out; ties go to the smaller vec_id.

    Rows without an id, and vectors null, zero, or with null or non-finite components, take no part; vectors
    meet vectors of their own length only. Repeated rows count once; a vec_id with several vectors is a candidate by each and
    is listed once, with its best score. An empty
    table gives no rows; extra columns are ignored."""
    clean = usable(vectors)
    sized = clean.groupBy().count().first()[0]
    shards = max(1, -(-sized // SHARD_NODES))
    nodes = clean.mapInArrow(_distinct(k, shards), "dim int, shard int, vec binary, ids array<long>")
    index = materialise(nodes.groupBy("dim", "shard").applyInArrow(
        _build(k), "dim int, shard int, entries array<long>, vectors binary, edges binary, ids array<array<long>>"), "graphs")
    queries = clean.where(F.col("vec_id") % query_every == 0).select(
        F.col("vec_id").alias("query_id"), "v", F.size("v").alias("dim")).dropDuplicates(["query_id", "v"])
    blocks = max(1, -(-sized // (query_every * QUERY_BLOCK)))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copied = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = copied.groupBy("dim", "shard", "block").cogroup(dealt.groupBy("dim", "shard", "block")).applyInArrow(
        _search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
