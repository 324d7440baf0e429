"""Year-on-year by weekday: 26 yoy_weekday_aligned and 41 yoy_weekday_report.

The original finds, for every current-year day, the base-year day of the same
weekday by a per-day scan of the whole table. Here the aligned date is closed form:
first base-year day on/after Jan 2 with the same weekday, plus the number of whole
weeks since Jan 2 of the current year; the base values then come from a single
equi-join on that date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.constants import WEEKDAYS
from shelfwise.functions.exprs import weekday_name, weekday_number
from shelfwise.operators.calendar import attach_row, date_slice


def aligned_base_date(d: F.Column, base_year: int) -> F.Column:
    start_cur = F.make_date(F.year(d), F.lit(1), F.lit(2))
    base_start = F.make_date(F.lit(base_year), F.lit(1), F.lit(2))
    offset = F.pmod(weekday_number(d) - weekday_number(base_start), F.lit(7))
    weeks = F.floor(F.datediff(d, start_cur) / 7).cast("int")
    return F.date_add(base_start, (offset + weeks * 7).cast("int"))


# ------------------------------------------------------- 26. yoy_weekday_aligned
def yoy_weekday_aligned(daily: DataFrame, as_of, base_year: int, value: str = "sales",
                        date_col: str = "date") -> DataFrame:
    """Current-year days Jan 2..as_of with their weekday-aligned base-year day;
    a base day absent from the data counts 0."""
    cur = date_slice(daily.select(date_col, value), as_of, date_col)
    cur = cur.select(F.col(date_col), weekday_name(date_col).alias("weekday"), F.col(value),
                     aligned_base_date(F.col(date_col), base_year).alias("base_date"))
    base = daily.select(F.col(date_col).alias("base_date"), F.col(value).alias("_bv"))
    return (cur.join(base, "base_date", "left")
            .select(date_col, "weekday", value, "base_date",
                    F.coalesce(F.col("_bv"), F.lit(0).cast(daily.schema[value].dataType)).alias("base_" + value)))


def weekday_table(spark: SparkSession) -> DataFrame:
    """The 7 weekdays, Monday..Sunday, with their number (a fixed dimension)."""
    arr = F.array(*[F.struct(F.lit(n).alias("weekday"), F.lit(i + 1).alias("weekday_no"))
                    for i, n in enumerate(WEEKDAYS)])
    return spark.range(1).select(F.inline(arr))


# -------------------------------------------------------- 41. yoy_weekday_report
def yoy_weekday_report(aligned: DataFrame, value: str = "sales") -> DataFrame:
    """Mean day total per weekday for both years (missing weekday = 0), rounded
    half-even to whole units; change % on the rounded values to 2 places (null when
    the base is 0); overall means of the seven weekday means; days analysed."""
    g = aligned.groupBy("weekday").agg(
        F.avg(value).alias("current_avg"), F.avg("base_" + value).alias("base_avg"),
        F.count(F.lit(1)).alias("n_days"))
    wk = weekday_table(aligned.sparkSession)
    t = wk.join(g, "weekday", "left").select(
        "weekday", "weekday_no",
        F.coalesce("current_avg", F.lit(0.0)).alias("current_avg"),
        F.coalesce("base_avg", F.lit(0.0)).alias("base_avg"),
        F.coalesce("n_days", F.lit(0)).alias("n_days"))
    t = (t.withColumn("current_rounded", F.bround("current_avg", 0).cast("bigint"))
          .withColumn("base_rounded", F.bround("base_avg", 0).cast("bigint")))
    change = F.try_divide((F.col("current_rounded") - F.col("base_rounded")).cast("double"),
                          F.col("base_rounded").cast("double")) * 100
    t = t.withColumn("change_pct", F.bround(change, 2))
    overall = t.agg(F.avg("current_avg").alias("current_overall"),
                    F.avg("base_avg").alias("base_overall"),
                    F.sum("n_days").alias("days_analysed"))
    return attach_row(t, overall).orderBy("weekday_no")
