"""Gold answers for every variant of a template in one job.

The reference answers each of its ~24.7k questions by running that question's
program. For the largest template (T8: location x pollutant x month x year x
statistic x position = 12,096 variants) this computes all answers at once:
one aggregation per location level yields every statistic for every
(year, month); an unpivot turns them into one row per variant; each end of
the ranking is a per-variant ``row_number() <= k`` with a literal k, which
Spark limits before the shuffle (``WindowGroupLimit``), so no variant's
locations are sorted whole. Semantics are those of ``catalog.t8``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.arith import rnd
from airlens.functions.stats import agg
from airlens.operators.catalog import LOCS, SIX


def sweep_t8(t, locs=LOCS, pms=("pm25", "pm10"), stats=("mean", "median", "q25", "q75"),
             years=tuple(range(1995, 2002)), positions=SIX) -> DataFrame:
    r = t.readings.where(F.col("year").isin(list(years)))
    measures = [f"{pm}__{st}" for pm in pms for st in stats]
    parts = []
    for loc in locs:
        g = (r.where(F.col(loc).isNotNull())
             .groupBy(F.col(loc).alias("lbl"), "year", F.month("ts").alias("month"))
             .agg(*[agg(st, pm).cast("double").alias(f"{pm}__{st}") for pm in pms for st in stats]))
        parts.append(g.unpivot(["lbl", "year", "month"], measures, "measure", "v")
                     .withColumn("loc", F.lit(loc)))
    allv = reduce(DataFrame.unionByName, parts)
    key = ["loc", "year", "month", "measure"]
    out = []
    fwd = sorted({p for p in positions if p >= 0})
    bwd = sorted({-p for p in positions if p < 0})
    if fwd:
        w = Window.partitionBy(*key).orderBy(F.col("v").asc_nulls_last(), F.col("lbl").asc())
        a = allv.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(fwd) + 1)
        out.append(a.withColumn("pos", (F.col("rn") - 1).cast("int"))
                   .where(F.col("pos").isin(fwd)))
    if bwd:
        w = Window.partitionBy(*key).orderBy(F.col("v").desc_nulls_first(), F.col("lbl").desc())
        b = allv.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= max(bwd))
        out.append(b.withColumn("pos", (-F.col("rn")).cast("int"))
                   .where(F.col("pos").isin([-x for x in bwd])))
    res = reduce(DataFrame.unionByName, out)
    return res.select("loc", F.split_part("measure", F.lit("__"), F.lit(1)).alias("pm"),
                      F.split_part("measure", F.lit("__"), F.lit(2)).alias("stat"),
                      "year", "month", "pos", F.col("lbl").alias("answer"),
                      rnd(F.col("v"), 9).alias("value"))
