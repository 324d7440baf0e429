"""Table access and materialisation shared by the operators of this package."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 2 << 20  # of an Arrow batch of texts on its way to Python


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes, not only the rows, of the Arrow batches that this session's tasks exchange with Python; a smaller bound
    of the session's own stands."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).lower().removesuffix("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as Parquet into a fresh folder of the shared checkpoint directory and read
    it back: lineage ends there, and a lost executor costs one stage at most."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: F.Column, modulus: int, remainder: int) -> F.Column:
    """crc32 of the id's decimal text modulo ``modulus`` equals ``remainder``; null ids are
    not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus == remainder, F.lit(False))


def held_out_py(ids: list, modulus: int, remainder: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids], bool)


def row_key(*cols: F.Column) -> F.Column:
    """64-bit key of a row's own content, to bring a derived frame back to its rows: equal
    rows get equal keys and therefore equal results."""
    return F.xxhash64(*cols, *[c.isNull() for c in cols])
