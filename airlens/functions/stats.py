"""Group statistics (G1-G8) with the reference's pandas semantics.

* mean / std / var skip NULLs; std and var use ddof 1 (n = 1 gives NULL).
* median and quantiles are exact with linear interpolation, never
  ``approx_percentile``. Over the readings they are taken by ``group_stats``,
  which counts per value and opens only the bucket that holds the rank, so no
  task holds a group; Spark's ``percentile`` (a map of a whole group's values in
  one task) is left to dimension tables.
* sum of an all-NULL group is 0.0 (pandas), not NULL (SQL).

Each entry has a Spark builder and the DuckDB SQL used by the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sum0(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


STATS = {
    "mean": (lambda c: F.avg(c), "avg({c})"),
    "median": (lambda c: F.median(c), "median({c})"),
    "q25": (lambda c: F.percentile(c, 0.25), "quantile_cont({c}, 0.25)"),
    "q75": (lambda c: F.percentile(c, 0.75), "quantile_cont({c}, 0.75)"),
    "sum": (_sum0, "coalesce(sum({c}), 0)"),
    "std": (lambda c: F.stddev_samp(c), "stddev_samp({c})"),
    "var": (lambda c: F.var_samp(c), "var_samp({c})"),
    "nunique": (lambda c: F.count_distinct(c), "count(distinct {c})"),
}

QUANTILES = {"median": 0.5, "q25": 0.25, "q75": 0.75}


def agg(stat: str, col: str) -> Column:
    return STATS[stat][0](col)


def sql_agg(stat: str, col: str) -> str:
    return STATS[stat][1].format(c=col)


def sem(col: str) -> Column:
    """Standard error of the mean, std(ddof 1) / sqrt(n)."""
    return F.stddev_samp(col) / F.sqrt(F.count(col))


def _bucket(v: Column) -> Column:
    """A coarse monotone step of a value: about a thousandth of its size."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * 1024)


# plain statistics that follow from the counts per value
_COUNTED = ("mean", "sum", "nunique")


def group_stats(df: DataFrame, key: Column, stats: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """(lbl, one column per name): statistics of ``df`` per ``key``.

    Quantiles: rows are counted per (group, measure, value), map-side first;
    counts per bucket of values, a small table, say which buckets hold the two
    ranks; the values of those alone are put in order. Work on one group is
    spread over its values, whatever share of all rows it has. Mean, sum and
    distinct count come from the same counts, so the rows are read once: both
    uses of the counts have the same plan up to their shuffle, which is reused
    (every join below is null-safe, as an inferred null filter would go into one
    of them only). Std and variance beside quantiles are a second reading.
    """
    quant = {n: (QUANTILES[s], c) for n, (s, c) in stats.items() if s in QUANTILES}
    plain = {n: (s, c) for n, (s, c) in stats.items() if s not in QUANTILES}
    if not quant:
        return df.groupBy(key.alias("lbl")).agg(*[agg(s, c).alias(n) for n, (s, c) in plain.items()]) \
            .select("lbl", *stats)
    measures: list = []              # one per column, though several statistics may ask for it
    number = {}
    for n, (s, c) in stats.items():
        if s in QUANTILES or s in _COUNTED:
            same = [i for i, m in enumerate(measures) if m is c or (isinstance(m, str) and isinstance(c, str) and m == c)]
            if not same:
                measures.append(c)
            number[n] = same[0] if same else len(measures) - 1
    cols = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in measures]
    if len(cols) == 1:
        rows = df.select(key.alias("lbl"), F.lit(0).alias("m"), cols[0].alias("v"))
    else:
        rows = df.select(key.alias("lbl"), F.posexplode(F.array(*cols)).alias("m", "v"))
    counts = rows.groupBy("lbl", "m", "v").agg(F.count(F.lit(1)).alias("n")).select(
        "lbl", "m", "v", F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0).alias("n"),
        _bucket(F.col("v")).alias("b"))
    buckets = counts.groupBy("lbl", "m", "b").agg(
        F.sum("n").alias("nb"), F.sum(F.col("v") * F.col("n")).alias("total"), F.count("v").alias("values"))

    def counted(name: str, stat: str) -> Column:
        mine = F.col("m") == number[name]
        total, n = F.sum(F.when(mine, F.col("total"))), F.sum(F.when(mine, F.col("nb")))
        if stat == "mean":
            return F.when(n > 0, total / n)
        return F.coalesce(total, F.lit(0.0)) if stat == "sum" else F.sum(F.when(mine, F.col("values")))

    group = Window.partitionBy("lbl", "m")
    asked = F.array(*[F.struct(F.lit(number[n]).alias("m"), F.lit(n).alias("name"), F.lit(q).alias("q"))
                      for n, (q, _) in quant.items()])
    runs = buckets.select(
        "lbl", "m", "b", "nb", F.sum("nb").over(group).alias("all"),
        (F.sum("nb").over(group.orderBy(F.col("b").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
         - F.col("nb")).alias("before"))
    points = runs.select("*", F.explode(F.filter(asked, lambda x: x["m"] == F.col("m"))).alias("ask")).select(
        F.col("lbl").alias("hl"), F.col("m").alias("hm"), F.col("b").alias("hb"), "nb", "before",
        F.col("ask.name").alias("name"), (F.col("ask.q") * (F.col("all") - 1)).alias("at"))
    lo, hi = F.floor("at"), F.ceil("at")
    held = points.where((F.col("before") <= hi) & (F.col("before") + F.col("nb") > lo)).drop("nb")
    same = (F.col("lbl").eqNullSafe(F.col("hl")) & F.col("m").eqNullSafe(F.col("hm"))
            & F.col("b").eqNullSafe(F.col("hb")))
    inner = Window.partitionBy("lbl", "name", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(held, same).withColumn("up_to", F.col("before") + F.sum("n").over(inner))
    ends = ranked.groupBy("lbl", "name").agg(
        F.first("at").alias("at"), F.min(F.when(F.col("up_to") > lo, F.col("v"))).alias("v0"),
        F.min(F.when(F.col("up_to") > hi, F.col("v"))).alias("v1"))
    value = F.col("v0") + (F.col("at") - lo) * (F.col("v1") - F.col("v0"))
    wide = ends.withColumn("value", value).groupBy(F.col("lbl").alias("wl")).agg(*[
        F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in quant])
    shown = [counted(n, s).alias(n) for n, (s, _) in plain.items() if n in number]
    base = buckets.groupBy("lbl").agg(*shown) if shown else buckets.select("lbl").distinct()
    out = base.join(wide, F.col("lbl").eqNullSafe(F.col("wl")), "left").drop("wl")
    apart = {n: sc for n, sc in plain.items() if n not in number}
    if apart:
        more = df.groupBy(key.alias("pl")).agg(*[agg(s, c).alias(n) for n, (s, c) in apart.items()])
        out = out.join(more, F.col("lbl").eqNullSafe(F.col("pl")), "left")
    return out.select("lbl", *stats)
