"""Stored sketches of the readings that merge to any coarser grain.

Quantiles: values are counted in buckets whose borders grow by a constant
factor, so a bucket's middle is within ``ERROR`` of every value in it, whatever
the values. Merging is adding counts, so neither order nor grouping of merges
can change a result. Distinct stations: HyperLogLog states, merged by union.
The sketches of a city and day are written once per snapshot; coarser grains
read them, not the readings.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.arith import rnd
from airlens.session import store_root
from airlens.sources.tables import _fingerprint, published

ERROR = 0.01              # greatest relative error of a quantile
GAMMA = (1 + ERROR) / (1 - ERROR)
LOG_K = 12                # 4,096 HyperLogLog registers: a standard error of about 1.6 %
QUANTILES = {"median": 0.5, "q95": 0.95}


def bucket(v: Column) -> Column:
    """The signed bucket of a value: (sign, step), the order of values kept."""
    sign = F.signum(v).cast("int")
    step = F.when(sign != 0, F.ceil(F.log(F.abs(v)) / math.log(GAMMA))).otherwise(F.lit(0))
    return F.struct(sign.alias("sign"), (sign * step).cast("bigint").alias("step"))


def middle(b: str) -> Column:
    """The value that stands for a bucket."""
    sign, step = F.col(f"{b}.sign"), F.col(f"{b}.step")
    return sign * 2 * F.pow(F.lit(GAMMA), sign * step) / (GAMMA + 1)


def value_sketch(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by, bucket, n): counts per bucket, null and NaN values left out."""
    v = F.col(col).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*by, bucket(v).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, by: list) -> DataFrame:
    """The same sketch at a coarser grain."""
    return sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], asked: dict[str, float]) -> DataFrame:
    """(by, n, one column per name): the value at the lower rank floor(q * (n - 1)),
    within ``ERROR`` of it. A group has a few thousand buckets at most (a
    double's range), however many rows it counts."""
    group = Window.partitionBy(*by)
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    s = sketch.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(q * (F.col("all") - 1)), F.col("bucket")))
    g = s.groupBy(*by).agg(F.max("all").alias("n"), *[at(q).alias(f"b_{n}") for n, q in asked.items()])
    return g.select(*by, "n", *[middle(f"b_{n}").alias(n) for n in asked])


def distinct_sketch(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """(by, hll): a mergeable state of the distinct values."""
    return df.groupBy(*by).agg(F.hll_sketch_agg(col, LOG_K).alias("hll"))


def distinct_estimate(sketch: DataFrame, by: list) -> DataFrame:
    """(by, n_distinct) of states merged to a coarser grain."""
    return sketch.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"))


def stored(t, name: str, build) -> DataFrame:
    """The table that ``build`` gives, written once per snapshot; of the caller's
    own frames, which have no snapshot to name them by, built each time."""
    if not t.sf_dir:
        return build()
    folder = f"{store_root(t.spark)}/{_fingerprint(t.spark, t.sf_dir)}/sketch_{name}"
    return t.spark.read.parquet(published(t.spark, folder, lambda f: build().write.parquet(f)))


def k4(t):
    """Median and 95th percentile of PM2.5 per state and year from the stored
    sketches of cities and days."""
    day = t.readings.withColumn("day", F.to_date("ts"))
    cells = stored(t, "pm25", lambda: value_sketch(day, ["state", "city", "day"], "pm25"))
    by = ["state", "year"]
    g = merged(cells.withColumn("year", F.year("day")), by)
    return quantiles(g, by, QUANTILES).select(
        "state", F.col("year").cast("bigint").alias("year"), "n", *[rnd(F.col(n), 6).alias(n) for n in QUANTILES])


# PM2.5 of the fixture is above 0, so the step alone orders the buckets here
_STEPS = (f"select state, year(ts) as year, cast(ceil(ln(pm25) / {math.log(GAMMA)!r}) as bigint) as step "
          f"from readings where pm25 > 0")
K4_SQL = ("select state, year, max(n) as n, " + ", ".join(
    f"round(max(case when rn = cast(floor({q} * (n - 1)) as bigint) then 2 * pow({GAMMA!r}, step) / ({GAMMA!r} + 1) "
    f"end), 6) as {name}" for name, q in QUANTILES.items())
    + f" from (select state, year, step, row_number() over (partition by state, year order by step) - 1 as rn, "
      f"count(*) over (partition by state, year) as n from ({_STEPS}) s) x group by state, year")


def registry():
    from airlens.plans.registry import Entry
    return {"K4": Entry(k4, K4_SQL, ("readings",))}
