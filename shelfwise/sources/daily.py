"""Sources and sinks: parquet tables, the wide daily CSV, forecasts, fitted pipelines.

Operators 1-4 of the inventory plus the builder of the wide daily layout (one row per
day, one column per item and measure) from long sales, used to round-trip that layout.
"""

from __future__ import annotations

import datetime as _dt
import json
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.constants import (
    DATE_COL, QTY_PREFIX, REV_PREFIX, WEEKDAY_ONEHOT_ORDER, WEEKDAY_PREFIX)
from shelfwise.functions.exprs import weekday_name


def read_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- 1. scan_daily
def scan_daily(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "csv", date_col: str = DATE_COL) -> DataFrame:
    """Read the daily table (CSV with header, or parquet); fail clearly without ``Date``.

    A declared schema avoids a second pass for inference; without one all CSV columns
    are read as strings and the caller casts.
    """
    reader = spark.read
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
        if schema is not None:
            # the header must carry the declared names in the declared order: columns are
            # bound by position, and a reordered file would swap their values
            reader = reader.schema(schema).option("enforceSchema", False)
            header = spark.read.option("header", True).csv(path).columns
            if date_col not in header:
                raise ValueError(f"daily table at {path} has no '{date_col}' column")
        df = reader.csv(path)
    else:
        df = reader.schema(schema).parquet(path) if schema is not None else reader.parquet(path)
    if date_col not in df.columns:
        raise ValueError(f"daily table at {path} has no '{date_col}' column")
    return df


def wide_schema(items: Sequence[str], date_type: T.DataType = T.DateType(),
                with_weekdays: bool = True) -> T.StructType:
    """Schema of the wide daily layout built by :func:`daily_wide`."""
    fields = [T.StructField(DATE_COL, date_type)]
    if with_weekdays:
        fields += [T.StructField(WEEKDAY_PREFIX + d, T.IntegerType()) for d in WEEKDAY_ONEHOT_ORDER]
    fields += [T.StructField(QTY_PREFIX + i, T.LongType()) for i in items]
    fields += [T.StructField(REV_PREFIX + i, T.DoubleType()) for i in items]
    return T.StructType(fields)


def known_items(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """df, failing on the first item outside the given list instead of dropping it."""
    bad = F.raise_error(F.concat(F.lit("item outside the given list: "), F.coalesce("item", F.lit("null"))))
    return df.withColumn("item", F.when(F.col("item").isin(list(items)), F.col("item")).otherwise(bad.cast("string")))


def daily_wide(sales: DataFrame, items: Sequence[str], with_weekdays: bool = True) -> DataFrame:
    """Long ``(date, item, qty, revenue)`` -> one row per day, a quantity and a revenue
    column per item. The item list is given, so the pivot needs no extra distinct job.
    Several rows of one day and item add up. One shuffle on ``date``."""
    p = (known_items(sales, items).groupBy("date").pivot("item", list(items))
         .agg(F.sum("qty").alias("q"), F.sum("revenue").cast("double").alias("r")))
    cols = [F.col("date").alias(DATE_COL)]
    if with_weekdays:
        dname = weekday_name("date")
        cols += [(dname == d).cast("int").alias(WEEKDAY_PREFIX + d) for d in WEEKDAY_ONEHOT_ORDER]
    cols += [F.col(f"`{i}_q`").alias(QTY_PREFIX + i) for i in items]
    cols += [F.col(f"`{i}_r`").alias(REV_PREFIX + i) for i in items]
    return p.select(*cols)


def write_daily_csv(wide: DataFrame, path: str) -> str:
    wide.write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-MM-dd").csv(path)
    return path


# --------------------------------------------------------------- 2. parse_dates
def parse_dates(df: DataFrame, col: str = DATE_COL, mode: str = "strict",
                fmt: str | None = None) -> DataFrame:
    """strict: an unparseable date fails the job; coerce: it becomes null and the row
    is dropped. Independent of the session's ANSI setting."""
    raw = F.col(f"`{col}`")
    parsed = F.try_to_date(raw, F.lit(fmt)) if fmt else F.try_to_date(raw)
    if mode == "strict":
        checked = F.when(parsed.isNull() & raw.isNotNull(),
                         F.raise_error(F.concat(F.lit(f"unparseable {col}: "), raw.cast("string"))))
        return df.withColumn(col, F.coalesce(parsed, checked.cast("date")))
    if mode == "coerce":
        return df.withColumn(col, parsed).where(F.col(f"`{col}`").isNotNull())
    raise ValueError(f"mode must be 'strict' or 'coerce', got {mode!r}")


# ------------------------------------------------------------ 3. write_forecast
def write_forecast(df: DataFrame, path: str, fmt: str = "parquet", name: str = "forecast",
                   stamp: str | None = None, partition_by: Sequence[str] | None = None) -> str:
    """Write predictions/orders under ``path/<name>_<timestamp>``; returns that folder."""
    stamp = stamp or f"{_dt.datetime.now(_dt.timezone.utc):%Y%m%d_%H%M%S}_{uuid.uuid4().hex[:8]}"
    out = f"{path.rstrip('/')}/{name}_{stamp}"
    w = df.write.mode("errorifexists")  # a save never replaces another
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(out)
    else:
        w.format(fmt).save(out)
    return out


def read_forecast(spark: SparkSession, out: str, fmt: str = "parquet",
                  schema: T.StructType | None = None) -> DataFrame:
    if fmt == "csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema is not None else r).csv(out)
    return spark.read.format(fmt).load(out)


class RunNotCommitted(LookupError):
    """No complete set of tables is published under the run id."""


def _marker(spark: SparkSession, root: str, run_id: str):
    """(file system, path) of a run's commit marker, through Hadoop: any store that Spark writes to."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", run_id):
        raise ValueError(f"run id {run_id!r} is no plain name")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_commits/{run_id}.json")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _read_marker(spark: SparkSession, root: str, run_id: str) -> dict | None:
    fs, path = _marker(spark, root, run_id)
    if not fs.exists(path):
        return None
    return json.loads("".join(r[0] for r in spark.read.text(path.toString()).collect()))  # one line


def publish(tables: dict[str, DataFrame], root: str, run_id: str, fmt: str = "parquet") -> dict[str, str]:
    """Publish several tables (predictions and orders) as one set under a run id: all of them or none.

    Each attempt writes into its own folder ``root/run_id/attempt-<id>/<table>``; nothing that readers use is touched.
    Only when every table is complete does the run's marker, a small file that names the attempt, appear by a rename. An
    attempt that is lost half-way leaves a folder that no marker names, and a re-run starts its own. Publishing a run id
    that has its marker writes nothing and gives the published folders, so repeating a job is harmless. Returns the
    tables' folders."""
    if not tables:
        raise ValueError("no table to publish")
    spark = next(iter(tables.values())).sparkSession
    done = _read_marker(spark, root, run_id)
    if done:
        if sorted(done["tables"]) != sorted(tables):
            raise ValueError(f"run {run_id} is published with the tables {sorted(done['tables'])}")
        return done["tables"]
    attempt = uuid.uuid4().hex[:12]
    folders = {name: f"{root.rstrip('/')}/{run_id}/attempt-{attempt}/{name}" for name in tables}
    for name, df in tables.items():
        w = df.write.mode("errorifexists")
        w.option("header", True).csv(folders[name]) if fmt == "csv" else w.format(fmt).save(folders[name])
    fs, path = _marker(spark, root, run_id)
    staged = spark._jvm.org.apache.hadoop.fs.Path(f"{path.getParent().toString()}/.{run_id}-{attempt}")
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps({"run_id": run_id, "format": fmt, "tables": folders}).encode()))
    out.close()
    if fs.exists(path) or not fs.rename(staged, path):  # another attempt was faster: its set counts
        fs.delete(staged, False)
        return publish(tables, root, run_id, fmt)
    return folders


def read_published(spark: SparkSession, root: str, run_id: str,
                   schemas: dict[str, T.StructType] | None = None) -> dict[str, DataFrame]:
    """The tables of a published run; raises :class:`RunNotCommitted` where no complete set exists."""
    done = _read_marker(spark, root, run_id)
    if not done:
        raise RunNotCommitted(f"run {run_id} under {root} has no complete set of tables")
    return {name: read_forecast(spark, folder, done["format"], (schemas or {}).get(name)) for name, folder in done["tables"].items()}


# ------------------------------------------------- 4. save_pipeline / load_pipeline
def save_pipeline(model, path: str) -> str:
    """Persist a fitted ``PipelineModel`` (scaler stats + both learners)."""
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


