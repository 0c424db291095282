"""Time operators over station and city days: as-of join, episodes, interval join, sliding frames.

All of them cut time into chunks, so that a key that holds most rows is many
pieces of work and never one window; what has to pass from chunk to chunk is one
row per key and chunk, or the rows at a chunk's borders.

* ``asof_join``: both sides in one time-ordered union per (key, chunk); the last
  known row of earlier chunks is carried in from a table of one row per key and chunk.
* ``episodes``: islands of consecutive days per (key, chunk); only islands at a
  chunk's border are stitched.
* ``overlap_join``: intervals meet in bins of a fixed width, and a pair belongs to
  the bin where the later one begins, so no pair comes twice and no loop is needed.
* ``sliding``: RANGE frames per (key, chunk), each chunk with a halo of the frame's
  length from the chunk before.

Days are whole numbers (days since 1970-01-01). Null keys, days and ends take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.arith import rnd

CHUNK = 64                # days of a chunk
LIMIT = 25                # PM2.5 above which a day counts
FRAMES = (7, 30)


def _chunk(day: Column, size: int) -> Column:
    return F.floor(day / size)


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], day: str, values: Sequence[str],
              chunk: int = CHUNK) -> DataFrame:
    """Every row of ``left`` with ``values`` and ``found_<day>`` of the last row of ``right`` of its
    key at or before its day (null: none). ``right`` has one row per key and day."""
    keys = list(on)
    found = F.struct(F.col(day).alias(f"found_{day}"), *values)
    r = right.dropna(subset=[*keys, day]).select(
        *keys, day, _chunk(F.col(day), chunk).alias("chunk"), found.alias("found"))
    none = F.lit(None).cast(r.schema["found"].dataType)
    l = left.select(*keys, day, _chunk(F.col(day), chunk).alias("chunk"), F.struct(*left.columns).alias("row"))
    both = (l.withColumn("found", none).withColumn("side", F.lit(1))
            .unionByName(r.withColumn("row", F.lit(None).cast(l.schema["row"].dataType)).withColumn("side", F.lit(0))))
    upto = Window.partitionBy(*keys, "chunk").orderBy(day, "side").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    own = both.withColumn("own", F.last("found", ignorenulls=True).over(upto)).filter("side = 1")
    # one row per key and chunk: the last known row of the chunks before
    last = (r.groupBy(*keys, "chunk").agg(F.max_by("found", day).alias("last"))
            .unionByName(l.select(*keys, "chunk").distinct().withColumn("last", none))
            .groupBy(*keys, "chunk").agg(F.max("last").alias("last")))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last")
    out = own.join(carried, [*keys, "chunk"], "left").withColumn("got", F.coalesce("own", "carried"))
    return out.select("row.*", "got.*")


def episodes(hits: DataFrame, key: str, day: str, value: str, chunk: int = CHUNK) -> DataFrame:
    """(key, first, last, days, total, peak) of the stretches of consecutive days in ``hits`` (one row per key and day)."""
    h = hits.dropna(subset=[key, day]).withColumn("chunk", _chunk(F.col(day), chunk))
    place = F.row_number().over(Window.partitionBy(key, "chunk").orderBy(day))
    part = (h.withColumn("island", F.col(day) - place).groupBy(key, "chunk", "island")
            .agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count(F.lit(1)).alias("days"),
                 F.sum(value).alias("total"), F.max(value).alias("peak")))
    border = (F.col("first") == F.col("chunk") * chunk) | (F.col("last") == (F.col("chunk") + 1) * chunk - 1)
    cols = [key, "first", "last", "days", "total", "peak"]
    # at most two islands of a chunk lie at its borders
    w = Window.partitionBy(key).orderBy("first")
    begins = F.coalesce(F.col("first") != F.lag("last").over(w) + 1, F.lit(True)).cast("int")
    edge = part.filter(border).withColumn("begins", begins)
    edge = (edge.withColumn("episode", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy(key, "episode").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                         F.sum("days").alias("days"), F.sum("total").alias("total"),
                                         F.max("peak").alias("peak")))
    return part.filter(~border).select(*cols).unionAll(edge.select(*cols))


def overlap_join(a: DataFrame, b: DataFrame, on: Sequence[str], a_ends: tuple[str, str], b_ends: tuple[str, str],
                 width: int = CHUNK) -> DataFrame:
    """Pairs of rows of one key whose intervals (both ends included) share a day, each pair once.

    An interval whose end lies before its start meets nothing. Column names other
    than the keys differ between the two sides.
    """
    def binned(df, ends):
        s, e = map(F.col, ends)
        return df.filter(s <= e).withColumn("bin", F.explode(F.sequence(_chunk(s, width), _chunk(e, width))))

    (a0, a1), (b0, b1) = a_ends, b_ends
    owner = F.greatest(_chunk(F.col(a0), width), _chunk(F.col(b0), width))
    return (binned(a, a_ends).join(binned(b, b_ends), [*on, "bin"])
            .filter((F.col(a0) <= F.col(b1)) & (F.col(b0) <= F.col(a1)) & (F.col("bin") == owner)).drop("bin"))


def sliding(daily: DataFrame, key: str, day: str, total: str, n: str, frames: Sequence[int] = FRAMES,
            chunk: int = CHUNK) -> DataFrame:
    """``daily`` (one row per key and day) with mean_<k> and days_<k> of the k days that end on each day."""
    halo = max(frames) - 1
    chunk = max(chunk, halo)
    d = daily.dropna(subset=[key, day]).withColumn("own", _chunk(F.col(day), chunk))
    reach = F.when(F.col(day) + halo >= (F.col("own") + 1) * chunk, F.array(F.col("own"), F.col("own") + 1)) \
        .otherwise(F.array("own"))
    d = d.withColumn("chunk", F.explode(reach))
    out = []
    for k in frames:
        w = Window.partitionBy(key, "chunk").orderBy(day).rangeBetween(-(k - 1), 0)
        out += [(F.sum(total).over(w) / F.sum(n).over(w)).alias(f"mean_{k}"),
                F.count(F.lit(1)).over(w).alias(f"days_{k}")]
    return d.select("*", *out).filter("chunk = own").drop("chunk", "own")


# -- queries ------------------------------------------------------------------

def city_days(t) -> DataFrame:
    """(city, day, total, n) of PM2.5 per city and day."""
    return (t.readings.where(F.col("pm25").isNotNull() & F.col("city").isNotNull())
            .groupBy("city", F.unix_date(F.to_date("ts")).alias("day"))
            .agg(F.sum("pm25").alias("total"), F.count(F.lit(1)).alias("n")))


def _date(c: str) -> Column:
    return F.date_from_unix_date(F.col(c).cast("int")).cast("string")


def city_episodes(t) -> DataFrame:
    hits = city_days(t).withColumn("v", F.col("total") / F.col("n")).where(F.col("v") > LIMIT)
    return episodes(hits, "city", "day", "v")


def w1(t):
    """The last reading of the station on or before each order of its customer."""
    orders = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("station")),
                           "o_custkey").select("o_orderkey", "station",
                                               F.unix_date(F.to_date("o_orderdate")).alias("day"))
    last = (t.readings.where(F.col("pm25").isNotNull())
            .groupBy("station", F.unix_date(F.to_date("ts")).alias("day")).agg(F.max("pm25").alias("pm25")))
    j = asof_join(orders, last, ["station"], "day", ["pm25"])
    return j.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "station",
                    _date("found_day").alias("read_on"), "pm25",
                    (F.col("day") - F.col("found_day")).cast("bigint").alias("age_days"))


W1_SQL = """
select cast(o.o_orderkey as bigint) as o_orderkey, o.station, cast(r.d as varchar) as read_on, r.pm25,
       cast(o.d - r.d as bigint) as age_days
from (select o_orderkey, c_name as station, cast(o_orderdate as date) as d
      from orders join customer on o_custkey = c_custkey) o
asof left join (select station, cast(ts as date) as d, max(pm25) as pm25 from readings
                where pm25 is not null group by 1, 2) r
  on o.station = r.station and o.d >= r.d
"""


def w2(t):
    """Episodes of consecutive days of a city above the limit."""
    e = city_episodes(t)
    return e.select("city", _date("first").alias("first_day"), _date("last").alias("last_day"),
                    F.col("days").cast("bigint").alias("days"), rnd(F.col("total") / F.col("days"), 6).alias("mean"),
                    rnd(F.col("peak"), 6).alias("peak"))


_DAYS = """select city, cast(ts as date) as d, sum(pm25) as total, count(*) as n
           from readings where pm25 is not null and city is not null group by 1, 2"""
_EPISODES = f"""select city, min(d) as a, max(d) as b, count(*) as days, avg(v) as mean, max(v) as peak
  from (select city, d, v, d - cast(row_number() over (partition by city order by d) as integer) as island
        from (select city, d, total / n as v from ({_DAYS}) x) y where v > {LIMIT}) z
  group by city, island"""
W2_SQL = f"""
select city, cast(a as varchar) as first_day, cast(b as varchar) as last_day, cast(days as bigint) as days,
       round(mean, 6) as mean, round(peak, 6) as peak from ({_EPISODES}) e
"""

# the funding years of the fixture: (column, first day, last day)
YEARS = (("rel_fy1", "1996-04-01", "1997-03-31"), ("rel_fy2", "1997-04-01", "1998-03-31"),
         ("rel_fy3", "1998-04-01", "1999-03-31"))


def w3(t):
    """Episodes of a city in each of its funding years: how many, how many days, and the money released."""
    spans = F.explode(F.array(*[F.struct(
        F.lit(c).alias("fy"), F.unix_date(F.lit(a).cast("date")).alias("fy_first"),
        F.unix_date(F.lit(b).cast("date")).alias("fy_last"), F.col(c).alias("released")) for c, a, b in YEARS]))
    years = t.funding.select("city", spans.alias("y")).select("city", "y.*")
    j = overlap_join(city_episodes(t), years, ["city"], ("first", "last"), ("fy_first", "fy_last"))
    days = F.least("last", "fy_last") - F.greatest("first", "fy_first") + 1
    return (j.groupBy("city", "fy").agg(F.count(F.lit(1)).alias("episodes"), F.sum(days).cast("bigint").alias("days"),
                                        rnd(F.max("released"), 2).alias("released")))


_YEARS_SQL = " union all ".join(
    f"select city, '{c}' as fy, date '{a}' as a, date '{b}' as b, {c} as released from funding" for c, a, b in YEARS)
W3_SQL = f"""
select e.city, fy, count(*) as episodes,
       cast(sum(least(e.b, f.b) - greatest(e.a, f.a) + 1) as bigint) as days, round(max(released), 2) as released
from ({_EPISODES}) e join ({_YEARS_SQL}) f on e.city = f.city and e.a <= f.b and f.a <= e.b
group by e.city, fy
"""


def w4(t):
    """Mean of the last 7 and 30 days of a city, by its readings, on every day that has any."""
    s = sliding(city_days(t), "city", "day", "total", "n")
    return s.select("city", _date("day").alias("day"), *[c for k in FRAMES for c in (
        rnd(F.col(f"mean_{k}"), 6).alias(f"mean_{k}"), F.col(f"days_{k}").cast("bigint").alias(f"days_{k}"))])


W4_SQL = f"""
select city, cast(d as varchar) as day,
       {", ".join(f"round(sum(total) over w{k} / sum(n) over w{k}, 6) as mean_{k}, "
                  f"count(*) over w{k} as days_{k}" for k in FRAMES)}
from ({_DAYS}) x
window {", ".join(f"w{k} as (partition by city order by d range between interval {k - 1} day preceding and current row)"
                  for k in FRAMES)}
"""


def registry():
    from airlens.plans.registry import Entry
    return {"W1": Entry(w1, W1_SQL, ("readings",)), "W2": Entry(w2, W2_SQL, ("readings",)),
            "W3": Entry(w3, W3_SQL, ("readings", "funding")), "W4": Entry(w4, W4_SQL, ("readings",))}
