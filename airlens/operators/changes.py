"""Differences of two snapshots of a table, and counts above many thresholds.

* ``keyed_difference``: added, removed and changed keys by one aggregation of the
  union, a row of either side carried as a struct; no join, and what map tasks
  see of both sides is combined before the shuffle.
* ``multiset_difference``: how often each whole row is only in one side and in
  both (``EXCEPT ALL`` and ``INTERSECT ALL`` at once), by counts per row, null-safe.
* ``count_above``: for every threshold of a key the number of its values above it,
  without pairs: values are counted, cut into chunks of their range, and a
  chunk's suffix sums are carried on from one row per key and chunk, so a hot
  key is many pieces of work.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 4.0                # width of a chunk of values


def _sides(before: DataFrame, after: DataFrame) -> DataFrame:
    if sorted(before.columns) != sorted(after.columns):
        raise ValueError("the two snapshots have different columns")
    row = lambda df, side: df.select(
        F.struct(*before.columns).alias("row"), F.lit(side).alias("side"))
    return row(before, 0).unionByName(row(after, 1))


def keyed_difference(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, change, old, new): one row per key that was ``added``, ``removed`` or
    ``changed``, with its row on either side (null: none). A null in a key is a
    key like any other, and two nulls are alike. Each side has one row per key;
    where it has several, the greatest in column order stands for them."""
    both = _sides(before, after)
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("row")))
    g = both.groupBy(*[F.col(f"row.{k}").alias(k) for k in keys]).agg(side(0).alias("old"), side(1).alias("new"))
    change = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
              .when(~F.col("old").eqNullSafe(F.col("new")), "changed"))
    return g.withColumn("change", change).where(F.col("change").isNotNull()).select(*keys, "change", "old", "new")


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(row, n_removed, n_added, n_common) per distinct row of either side."""
    both = _sides(before, after).groupBy("row").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    zero = F.lit(0)
    return both.select("row", F.greatest(F.col("a") - F.col("b"), zero).alias("n_removed"),
                       F.greatest(F.col("b") - F.col("a"), zero).alias("n_added"),
                       F.least("a", "b").alias("n_common"))


def count_above(values: DataFrame, thresholds: DataFrame, key: str, value: str, threshold: str,
                step: float = STEP) -> DataFrame:
    """Every row of ``thresholds`` with ``n_above``, the number of rows of ``values`` of its
    key whose value is greater. Null keys, values and thresholds take no part; a threshold
    with nothing above it has 0."""
    chunk = lambda c: F.floor(F.col(c) / step)
    counts = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(
        F.col(key).alias("key"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("chunk", chunk("v"))
    asked = thresholds.where(F.col(key).isNotNull() & F.col(threshold).isNotNull()).select(
        F.col(key).alias("key"), F.col(threshold).cast("double").alias("v"), F.lit(0).cast("bigint").alias("n"),
        F.struct(*thresholds.columns).alias("ask")).withColumn("chunk", chunk("v"))
    both = counts.withColumn("ask", F.lit(None).cast(asked.schema["ask"].dataType)).unionByName(asked)
    # the rows of greater values in the chunk: a RANGE frame leaves the threshold's own value out
    higher = Window.partitionBy("key", "chunk").orderBy(F.col("v").desc())
    up_to = F.sum("n").over(higher.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("n").over(Window.partitionBy("key", "chunk", "v"))
    within = both.select("key", "chunk", "ask", (up_to - own).alias("within")).where(F.col("ask").isNotNull())
    # one row per key and chunk that holds a value or a threshold
    per_chunk = both.groupBy("key", "chunk").agg(F.sum("n").alias("n"))
    later = Window.partitionBy("key").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select("key", "chunk", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("carried"))
    return (within.join(carried, ["key", "chunk"])
            .select("ask.*", (F.col("within") + F.col("carried")).alias("n_above")))


# --- the registered queries ------------------------------------------------------------

def _snapshots(t) -> tuple[DataFrame, DataFrame]:
    """City days as they are, and as a later delivery has them: every 11th day left
    out, totals of every 7th day corrected, and every 13th day moved on by ten years."""
    days = t.readings.groupBy("city", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("pm25").alias("total"))
    no = F.datediff("day", F.lit("1990-01-01"))
    after = days.where(no % 11 != 0).select(
        "city", F.when(no % 13 == 0, F.date_add("day", 3650)).otherwise(F.col("day")).alias("day"), "n",
        F.when(no % 7 == 0, F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    return days, after


_BEFORE = "select city, cast(ts as date) as day, count(*) as n, sum(pm25) as total from readings group by 1, 2"
_NO = "date_diff('day', date '1990-01-01', day)"
_AFTER = (f"select city, case when {_NO} % 13 = 0 then cast(day + interval 3650 day as date) else day end as day, n, "
          f"case when {_NO} % 7 = 0 then total + 1 else total end as total from ({_BEFORE}) d where {_NO} % 11 <> 0")


def _text(day: Column) -> Column:
    return day.cast("string")


def k1(t):
    """Added, removed and changed city days between two deliveries."""
    before, after = _snapshots(t)
    d = keyed_difference(before, after, ["city", "day"])
    return d.select("city", _text(F.col("day")).alias("day"), "change", F.col("old.total").alias("old_total"),
                    F.col("new.total").alias("new_total"))


K1_SQL = f"""
select coalesce(a.city, b.city) as city, cast(coalesce(a.day, b.day) as varchar) as day,
       case when a.city is null then 'added' when b.city is null then 'removed' else 'changed' end as change,
       a.total as old_total, b.total as new_total
from (select city, day, n, max(total) as total from ({_BEFORE}) x group by 1, 2, 3) a
full join (select city, day, max(struct_pack(n := n, total := total)).n as n,
                  max(struct_pack(n := n, total := total)).total as total from ({_AFTER}) y group by 1, 2) b
on a.city = b.city and a.day = b.day
where a.city is null or b.city is null or a.n <> b.n or a.total is distinct from b.total
"""


def k2(t):
    """Rows (city, readings, PM2.5 total) of city days, by how often each delivery has them."""
    before, after = (s.select("city", "n", "total") for s in _snapshots(t))
    return multiset_difference(before, after).select("row.*", "n_removed", "n_added", "n_common").withColumnRenamed(
        "n", "readings")


_A, _B = (f"select city, n as readings, total from ({s}) s" for s in (_BEFORE, _AFTER))
_PARTS = (("n_removed", f"({_A}) except all ({_B})"), ("n_added", f"({_B}) except all ({_A})"),
          ("n_common", f"({_A}) intersect all ({_B})"))
K2_SQL = ("select city, readings, total, " + ", ".join(
    f"cast(sum(case when part = '{p}' then 1 else 0 end) as bigint) as {p}" for p, _ in _PARTS)
    + " from (" + " union all ".join(f"select '{p}' as part, * from ({q}) q_{p}" for p, q in _PARTS)
    + ") u group by city, readings, total")


def k3(t):
    """For every station the readings of its state above the station's own mean."""
    r = t.readings
    means = r.where(F.col("pm25").isNotNull()).groupBy("state", "station").agg(F.avg("pm25").alias("mean"))
    return count_above(r, means, "state", "pm25", "mean").select("state", "station", "n_above")


K3_SQL = """
select m.state, m.station, count(r.pm25) as n_above
from (select state, station, avg(pm25) as mean from readings where pm25 is not null group by state, station) m
left join (select state, pm25 from readings) r on r.state = m.state and r.pm25 > m.mean
where m.state is not null group by m.state, m.station
"""


def registry():
    from airlens.plans.registry import Entry
    return {"K1": Entry(k1, K1_SQL, ("readings",)), "K2": Entry(k2, K2_SQL, ("readings",)),
            "K3": Entry(k3, K3_SQL, ("readings",))}
