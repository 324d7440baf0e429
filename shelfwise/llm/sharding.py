"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt into hash blocks. How many rows each block sends to each shard is drawn from
the exact distribution of a uniform permutation (multivariate hypergeometric, with the
shard sizes as margins); rows are permuted inside their block, cut by the drawn counts,
exchanged, and permuted again inside the shard. Rows move through DataFrame operators only;
the driver draws the matrix, blocks x shards numbers of which there are at most
``MAX_BLOCKS`` x shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096           # rows of a block, until there are MAX_BLOCKS
MIN_BLOCKS, MAX_BLOCKS = 256, 1 << 16


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among ``draws`` without replacement: inversion on the probability
    ratios around the mode, so no factorials and no limit on the population."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    mode = min(hi, max(lo, ((draws + 1) * (good + 1)) // (good + bad + 2)))
    total = good + bad
    sd = (draws * good / total * (bad / total) * max(1, total - draws) / max(1, total - 1)) ** 0.5
    reach = int(12 * sd) + 40  # beyond it less than 1e-30 of the mass
    up = np.arange(mode, min(hi, mode + reach), dtype=np.float64)
    down = np.arange(mode, max(lo, mode - reach), -1, dtype=np.float64)
    rise = np.cumprod((good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1)))
    fall = np.cumprod(down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1)))
    mass = np.concatenate([fall[::-1], [1.0], rise])
    at = np.searchsorted(np.cumsum(mass), rng.random() * mass.sum(), "right")
    return mode - len(fall) + min(int(at), len(mass) - 1)


def communication_matrix(block_rows: list[int], shard_rows: list[int], seed: int) -> np.ndarray:
    """Counts with the given margins, distributed as under a uniform permutation."""
    rng = np.random.default_rng(seed)
    left = list(shard_rows)
    out = np.zeros((len(block_rows), len(left)), np.int64)
    for i, rows in enumerate(block_rows):
        rest = sum(left)
        for j, room in enumerate(left):
            k = hypergeometric(rng, room, rest - room, rows)
            out[i, j] = k
            left[j] -= k
            rows -= k
            rest -= room
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


def uniform_shards(df: DataFrame, key: str = "doc_id", shards: int = 16, seed: int = 20240229) -> DataFrame:
    """All columns of df plus (shard int, slot long): a uniform random permutation cut into shards whose
    row counts differ by one at most; slots run from 0 without gaps in each shard.

    The result depends on the rows and the seed, not on partitions or their order. Null keys and repeated
    rows are rows like others (identical rows may swap places). Input columns named shard or slot are replaced; other
    extra columns are carried along."""
    spark = df.sparkSession
    names = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(F.col(key).alias("key"), F.struct(*names).alias("row"))
    key = "key"
    rows = df.select(key).count()
    blocks = MIN_BLOCKS
    while blocks < MAX_BLOCKS and blocks * BLOCK_ROWS < rows:
        blocks *= 2

    block = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(blocks)).cast("int")
    sizes = [0] * blocks
    for r in df.select(block.alias("b")).groupBy("b").count().collect():  # at most MAX_BLOCKS rows
        sizes[r["b"]] = r["count"]
    matrix = communication_matrix(sizes, shard_sizes(rows, shards), seed)
    cuts = spark.createDataFrame([(i, c) for i, c in enumerate(np.cumsum(matrix, axis=1).tolist())],
                                 "block int, cuts array<long>")

    # permute inside the block, then cut
    order = F.xxhash64(F.lit(seed + 1), F.col(key))
    local = df.withColumn("block", block).withColumn(
        "rank", F.row_number().over(Window.partitionBy("block").orderBy(order, key)) - 1)
    placed = local.join(F.broadcast(cuts), "block").withColumn(
        "shard", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))

    # permute inside the shard: random parts, whose sizes give each its first slot
    parts = max(1, blocks // shards)
    part = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(key)), F.lit(parts)).cast("int")
    placed = placed.withColumn("part", part).drop("block", "rank", "cuts")
    sized = placed.groupBy("shard", "part").count()  # blocks rows
    first = sized.select("shard", "part", (F.sum("count").over(
        Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("first"))
    again = F.row_number().over(Window.partitionBy("shard", "part").orderBy(F.xxhash64(F.lit(seed + 3), F.col(key)), key))
    return (placed.withColumn("at", again - 1).join(F.broadcast(first), ["shard", "part"])
            .select(*[F.col(f"row.{c}").alias(c) for c in names], "shard", (F.col("first") + F.col("at")).alias("slot")))
