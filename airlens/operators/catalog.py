"""The query catalog: 67 parameterised templates (T1-T73) as Spark plans.

Every template returns a small DataFrame -- one row per requested position
(``pos``), or one row per parameter value for count/scalar templates -- with
the answer the reference prints plus the ranked value. Each ``tNN`` has a
twin ``tNN_sql`` giving the same computation in DuckDB SQL over the fixture
views; the registry uses it as the correctness oracle.

Plan shape shared by the templates: pruned, partition-pruned scan of
``readings`` -> (filter) -> partial aggregation -> one shuffle on the group
key -> (join to a dimension table the planner may broadcast after checking its
size) -> ``TakeOrderedAndProject`` top-k. The program, not the question text,
is the specification (see SURVEY 5): day/month quirks are kept.

Years: the fixture spans 1995-2001 for the reference's 2018-2024; funding
financial years 1996-97, 1997-98, 1998-99 stand for 2019-20 ... 2021-22.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.functions import timefx as tf
from airlens.functions.arith import pdiv, rnd, sql_pdiv
from airlens.functions.stats import QUANTILES, agg, group_stats, sql_agg
from airlens.operators.rank import nth, nth_of_counts, sql_nth, sql_top_k, top_k
from airlens.sources.tables import Tables

# Positions as the templates enumerate them (negative = len(df) - k).
SIX = (-1, -2, -3, 2, 1, 0)
EIGHT = (0, -1, 1, -2, 2, -3, 3, -4)
TEN = (0, -1, 1, -2, 2, -3, 3, -4, 4, -5)
SIXP = (0, -1, 1, -2, 2, -3)
SKIP3 = (0, -1, 1, -2, 2, -3, 4, -5)
FOUR = (0, -1, 1, -2)
TWO = (0, -1)
CHANGE = (-1, 1, 2, -4, -5)

LOCS = ("state", "city", "station")
PMS = {"pm25": "PM2.5", "pm10": "PM10"}


# ---------------------------------------------------------------------------
# shared pieces
# ---------------------------------------------------------------------------

def _group(df: DataFrame, key: Column | str, value: Column) -> DataFrame:
    """``groupby(key)[col].stat()`` -> (lbl, v); NULL keys dropped as pandas does."""
    k = F.col(key) if isinstance(key, str) else key
    return df.where(k.isNotNull()).groupBy(k.alias("lbl")).agg(value.alias("v"))


def _group_stat(df: DataFrame, key, stat: str, col: str) -> DataFrame:
    """(lbl, v): one statistic per group of the readings."""
    k = F.col(key) if isinstance(key, str) else key
    return group_stats(df.where(k.isNotNull()), k, {"v": (stat, col)})


def _ranked(base: DataFrame, positions, digits: int = 9, asc: bool = True) -> DataFrame:
    return nth(base, [("v", asc), ("lbl", asc)], positions,
               [F.col("lbl").cast("string").alias("answer"),
                rnd(F.col("v").cast("double"), digits).alias("value")])


def _sql_group(key: str, value: str, where: str = "true", table: str = "readings") -> str:
    return (f"select {key} as lbl, {value} as v from {table} "
            f"where ({where}) and {key} is not null group by {key}")


def _sql_ranked(base: str, positions, digits: int = 9, asc: bool = True) -> str:
    return sql_nth(base, [("v", asc), ("lbl", asc)], positions,
                   ["cast(lbl as varchar) as answer", f"round(cast(v as double), {digits}) as value"])


# ---------------------------------------------------------------------------
# filter -> row rank
# ---------------------------------------------------------------------------

def _row_rank(t: Tables, cond, loc: str, pm: str, positions) -> DataFrame:
    r = t.readings
    rows = r.where(cond(r) & F.col(pm).isNotNull()).select(
        F.col(loc).alias("lbl"), F.col(pm).alias("v"))
    return _ranked(rows, positions)


def _sql_row_rank(where: str, loc: str, pm: str, positions) -> str:
    base = f"select {loc} as lbl, {pm} as v from readings where ({where}) and {pm} is not null"
    return _sql_ranked(base, positions)


def t1(t, loc="station", pm="pm25", year=1998, positions=SIX):
    """Location of the nth reading on 14 January of a year (row level)."""
    return _row_rank(t, lambda r: tf.on_date(year, 1, 14, r), loc, pm, positions)


def t1_sql(loc="station", pm="pm25", year=1998, positions=SIX):
    return _sql_row_rank(tf.sql_on_date(year, 1, 14), loc, pm, positions)


def t7(t, loc="city", pm="pm10", year=1997, positions=SIX):
    """Asks for 27 January; the program filters day 26 -- kept."""
    return _row_rank(t, lambda r: tf.on_date(year, 1, 26, r), loc, pm, positions)


def t7_sql(loc="city", pm="pm10", year=1997, positions=SIX):
    return _sql_row_rank(tf.sql_on_date(year, 1, 26), loc, pm, positions)


def t12(t, pm="pm10", year=1999, positions=SIX):
    """The nth pm value itself in a year."""
    r = t.readings
    rows = r.where(tf.in_year(year, r) & F.col(pm).isNotNull()).select(F.col(pm).alias("v"))
    # values hardly repeat, so counts per value would shuffle nearly every row
    return nth(rows, [("v", True)], positions, [rnd(F.col("v"), 6).alias("value")])


def t12_sql(pm="pm10", year=1999, positions=SIX):
    base = f"select {pm} as v from readings where ({tf.sql_in_year(year)}) and {pm} is not null"
    return sql_nth(base, [("v", True)], positions, ["round(v, 6) as value"])


def t27(t, city="NATION_1/BUILDING", pm="pm25", last_years=3, as_of_year=2001, positions=SIX):
    """Date of the nth reading in a city over the last N calendar years."""
    r = t.readings
    rows = r.where((F.col("city") == city) & tf.last_n_years(as_of_year, last_years, r)
                   & F.col(pm).isNotNull()).select(
        F.col(pm).alias("v"), F.to_date("ts").cast("string").alias("lbl"))
    return nth_of_counts(rows, [("v", True), ("lbl", True)], positions,
                         [F.col("lbl").alias("answer"), rnd(F.col("v").cast("double"), 9).alias("value")])


def t27_sql(city="NATION_1/BUILDING", pm="pm25", last_years=3, as_of_year=2001, positions=SIX):
    base = (f"select {pm} as v, cast(cast(ts as date) as varchar) as lbl from readings "
            f"where city = '{city}' and ts >= timestamp '{as_of_year - last_years}-01-01' "
            f"and {pm} is not null")
    return _sql_ranked(base, positions)


# ---------------------------------------------------------------------------
# filter -> group statistic -> rank
# ---------------------------------------------------------------------------

def _grs(t, cond, key, stat, pm, positions, dropna=False, key_sql=None):
    r = t.readings
    df = r.where(cond(r)) if cond is not None else r
    k = F.col(key) if isinstance(key, str) else key
    g = _group_stat(df, k, stat, pm)
    if dropna:
        g = g.where(F.col("v").isNotNull())
    return _ranked(g, positions)


def _grs_sql(where, key, stat, pm, positions, dropna=False):
    base = _sql_group(key, sql_agg(stat, pm), where)
    if dropna:
        base = f"select * from ({base}) g where v is not null"
    return _sql_ranked(base, positions)


def t2(t, loc="station", pm="pm25", positions=SIX):
    """Location by nth mean; an all-NULL group ranks highest (not dropped)."""
    return _grs(t, None, loc, "mean", pm, positions)


def t2_sql(loc="station", pm="pm25", positions=SIX):
    return _grs_sql("true", loc, "mean", pm, positions)


def t3(t, loc="city", positions=SIX):
    """State/city by nth number of distinct stations."""
    return _grs(t, None, loc, "nunique", "station", positions)


def t3_sql(loc="city", positions=SIX):
    return _grs_sql("true", loc, "nunique", "station", positions)


def t4(t, loc="state", pm="pm25", season="Winter", year=1998, stat="median", positions=SIX):
    """Location by nth statistic in a season (Winter = Dec, Jan, Feb of the same year)."""
    months = tf.SEASONS_A[season]
    return _grs(t, lambda r: tf.in_year(year, r) & tf.month_in(months), loc, stat, pm, positions)


def t4_sql(loc="state", pm="pm25", season="Winter", year=1998, stat="median", positions=SIX):
    months = ", ".join(map(str, tf.SEASONS_A[season]))
    return _grs_sql(f"{tf.sql_in_year(year)} and month(ts) in ({months})", loc, stat, pm, positions)


def t6(t, loc="city", pm="pm10", positions=SIX):
    """Location by nth standard deviation ("most stable" = largest std)."""
    return _grs(t, None, loc, "std", pm, positions)


def t6_sql(loc="city", pm="pm10", positions=SIX):
    return _grs_sql("true", loc, "std", pm, positions)


def t8(t, loc="city", pm="pm10", month=3, year=1996, stat="q25", positions=SIX):
    """Location by nth statistic in a month of a year."""
    return _grs(t, lambda r: tf.in_year(year, r) & tf.month_is(month), loc, stat, pm, positions)


def t8_sql(loc="city", pm="pm10", month=3, year=1996, stat="q25", positions=SIX):
    return _grs_sql(f"{tf.sql_in_year(year)} and month(ts) = {month}", loc, stat, pm, positions)


def t9(t, loc="state", pm="pm10", positions=SIX):
    """Location by nth median."""
    return _grs(t, None, loc, "median", pm, positions)


def t9_sql(loc="state", pm="pm10", positions=SIX):
    return _grs_sql("true", loc, "median", pm, positions)


def t11(t, pm="pm10", year=2000, stat="mean", positions=SIX):
    """Weekday name by nth statistic in a year."""
    return _grs(t, lambda r: tf.in_year(year, r), tf.weekday_name(), stat, pm, positions)


def t11_sql(pm="pm10", year=2000, stat="mean", positions=SIX):
    return _grs_sql(tf.sql_in_year(year), "dayname(ts)", stat, pm, positions)


def t13(t, pm="pm25", positions=SIX):
    """Year by nth mean (NULL readings dropped first)."""
    return _grs(t, lambda r: F.col(pm).isNotNull(), F.year("ts"), "mean", pm, positions)


def t13_sql(pm="pm25", positions=SIX):
    return _grs_sql(f"{pm} is not null", "year(ts)", "mean", pm, positions)


def t14(t, pm="pm10", month=7, stat="median", positions=SIX):
    """Asks for a month, answers the year with the nth statistic in that month."""
    return _grs(t, lambda r: tf.month_is(month) & tf.in_any_year((month,), t.stored_years), F.year("ts"), stat, pm, positions)


def t14_sql(pm="pm10", month=7, stat="median", positions=SIX):
    return _grs_sql(f"month(ts) = {month}", "year(ts)", stat, pm, positions)


def t15(t, pm="pm25", positions=SIX):
    """Month name by nth mean over all years."""
    return _grs(t, None, tf.month_name(), "mean", pm, positions)


def t15_sql(pm="pm25", positions=SIX):
    return _grs_sql("true", "monthname(ts)", "mean", pm, positions)


def t16(t, pm="pm10", year=1997, stat="q75", positions=SIX):
    """ISO week by nth statistic within a calendar year."""
    return _grs(t, lambda r: tf.in_year(year, r), tf.iso_week(), stat, pm, positions)


def t16_sql(pm="pm10", year=1997, stat="q75", positions=SIX):
    return _grs_sql(tf.sql_in_year(year), "weekofyear(ts)", stat, pm, positions)


def t17(t, pm="pm25", year=1999, stat="mean", positions=SIX):
    """Season (Winter = Oct-Dec mapping) by nth statistic in a year."""
    return _grs(t, lambda r: tf.in_year(year, r), tf.season_b(), stat, pm, positions)


def t17_sql(pm="pm25", year=1999, stat="mean", positions=SIX):
    return _grs_sql(tf.sql_in_year(year), tf.SQL_SEASON_B, stat, pm, positions)


def t18(t, loc="city", pm="pm25", year=1998, positions=SIX):
    """Asks for January 5; the program filters 5 June -- kept. NULL means dropped."""
    return _grs(t, lambda r: tf.on_date(year, 6, 5, r), loc, "mean", pm, positions, dropna=True)


def t18_sql(loc="city", pm="pm25", year=1998, positions=SIX):
    return _grs_sql(tf.sql_on_date(year, 6, 5), loc, "mean", pm, positions, dropna=True)


def t19(t, loc="state", pm="pm10", positions=SIX):
    """Location by nth mean on 31 December across all years."""
    return _grs(t, lambda r: tf.month_day(12, 31) & tf.in_any_year((12,), t.stored_years, 31), loc, "mean", pm, positions, dropna=True)


def t19_sql(loc="state", pm="pm10", positions=SIX):
    return _grs_sql("month(ts) = 12 and day(ts) = 31", loc, "mean", pm, positions, dropna=True)


def t20(t, loc="city", pm="pm25", year=1997, stat="q75", positions=SIX):
    """Asks for 31 March; the program covers Oct-Mar of the calendar year."""
    months = (10, 11, 12, 1, 2, 3)
    return _grs(t, lambda r: tf.month_in(months) & tf.in_year(year, r), loc, stat, pm,
                positions, dropna=True)


def t20_sql(loc="city", pm="pm25", year=1997, stat="q75", positions=SIX):
    return _grs_sql(f"month(ts) in (10, 11, 12, 1, 2, 3) and {tf.sql_in_year(year)}",
                    loc, stat, pm, positions, dropna=True)


def t22(t, loc="station", pm="pm10", positions=SIX):
    """Location by nth mean in April of the fixed year (1997 for 2020)."""
    return _grs(t, lambda r: tf.month_is(4) & tf.in_year(1997, r), loc, "mean", pm,
                positions, dropna=True)


def t22_sql(loc="station", pm="pm10", positions=SIX):
    return _grs_sql(f"month(ts) = 4 and {tf.sql_in_year(1997)}", loc, "mean", pm, positions,
                    dropna=True)


def t23(t, loc="city", pm="pm10", year=2000, positions=SIX):
    """Location by nth mean on 15 August of a year."""
    return _grs(t, lambda r: tf.on_date(year, 8, 15, r), loc, "mean", pm, positions, dropna=True)


def t23_sql(loc="city", pm="pm10", year=2000, positions=SIX):
    return _grs_sql(tf.sql_on_date(year, 8, 15), loc, "mean", pm, positions, dropna=True)


def t29(t, year=1999):
    """Worst month name by mean PM2.5 over 1995..Y."""
    return _grs(t, lambda r: tf.in_years(1995, year, r), tf.month_name(), "mean", "pm25", (-1,))


def t29_sql(year=1999):
    where = f"ts >= timestamp '1995-01-01' and ts < timestamp '{year + 1}-01-01'"
    return _grs_sql(where, "monthname(ts)", "mean", "pm25", (-1,))


def t30(t, city="NATION_2/AUTOMOBILE", pm="pm10", positions=SIX):
    """ISO week by nth mean for a city; drops NULLs of ``pm`` but averages PM2.5."""
    cond = lambda r: (F.col("city") == city) & F.col(pm).isNotNull()
    return _grs(t, cond, tf.iso_week(), "mean", "pm25", positions)


def t30_sql(city="NATION_2/AUTOMOBILE", pm="pm10", positions=SIX):
    return _grs_sql(f"city = '{city}' and {pm} is not null", "weekofyear(ts)", "mean", "pm25",
                    positions)


def t31(t, city="NATION_3/HOUSEHOLD", year=2000):
    """Cleanest year (lowest mean PM2.5) for a city over 1995..Y."""
    cond = lambda r: ((F.col("city") == city) & tf.in_years(1995, year, r)
                      & F.col("pm25").isNotNull())
    return _grs(t, cond, F.year("ts"), "mean", "pm25", (0,))


def t31_sql(city="NATION_3/HOUSEHOLD", year=2000):
    where = (f"city = '{city}' and ts >= timestamp '1995-01-01' and "
             f"ts < timestamp '{year + 1}-01-01' and pm25 is not null")
    return _grs_sql(where, "year(ts)", "mean", "pm25", (0,))


def t70(t, loc="city", pm="pm25", positions=TEN):
    """Funded state/city by nth mean pm (semi-join on total funding > 0)."""
    funded = t.funding.where(F.col("total_released") > 0).select(F.col(loc).alias("lbl"))
    g = _group(t.readings, loc, agg("mean", pm)).join(funded, "lbl", "left_semi")
    return _ranked(g, positions)


def t70_sql(loc="city", pm="pm25", positions=TEN):
    base = (f"select * from ({_sql_group(loc, sql_agg('mean', pm))}) g where lbl in "
            f"(select {loc} from funding where total_released > 0)")
    return _sql_ranked(base, positions)


# ---------------------------------------------------------------------------
# group -> two-period difference -> rank
# ---------------------------------------------------------------------------

def t21(t, loc="state", pm="pm10", year=1996, stat="mean", positions=SIX):
    """Location by nth (October - December) statistic; one pass, pivot as
    conditional aggregation; locations missing either month are dropped."""
    r = t.readings
    m = F.month("ts")
    df = r.where(tf.in_year(year, r) & m.isin(10, 12) & F.col(loc).isNotNull())
    g = group_stats(df, F.col(loc), {"m10": (stat, F.when(m == 10, F.col(pm))),
                                     "m12": (stat, F.when(m == 12, F.col(pm)))})
    g = g.select("lbl", (F.col("m10") - F.col("m12")).alias("v")).where(F.col("v").isNotNull())
    return _ranked(g, positions)


def t21_sql(loc="state", pm="pm10", year=1996, stat="mean", positions=SIX):
    base = (f"select lbl, m10 - m12 as v from (select {loc} as lbl, "
            f"{sql_agg(stat, f'case when month(ts) = 10 then {pm} end')} as m10, "
            f"{sql_agg(stat, f'case when month(ts) = 12 then {pm} end')} as m12 "
            f"from readings where {tf.sql_in_year(year)} and month(ts) in (10, 12) "
            f"and {loc} is not null group by {loc}) p where m10 - m12 is not null")
    return _sql_ranked(base, positions)


def t26(t, loc="city", pm="pm25", month=11, stat="median"):
    """Location with the largest rise from 1996 to 1997 in a month (iloc[-1])."""
    r = t.readings
    df = r.where(tf.month_is(month) & tf.year_in((1996, 1997), r) & F.col(loc).isNotNull())
    y = F.year("ts")
    g = group_stats(df, F.col(loc), {"a": (stat, F.when(y == 1996, F.col(pm))),
                                     "b": (stat, F.when(y == 1997, F.col(pm)))})
    g = g.select("lbl", (F.col("b") - F.col("a")).alias("v")).where(F.col("v").isNotNull())
    return _ranked(g, (-1,))


def t26_sql(loc="city", pm="pm25", month=11, stat="median"):
    base = (f"select lbl, b - a as v from (select {loc} as lbl, "
            f"{sql_agg(stat, f'case when year(ts) = 1996 then {pm} end')} as a, "
            f"{sql_agg(stat, f'case when year(ts) = 1997 then {pm} end')} as b "
            f"from readings where month(ts) = {month} and year(ts) in (1996, 1997) "
            f"and {loc} is not null group by {loc}) p where b - a is not null")
    return _sql_ranked(base, (-1,))


# ---------------------------------------------------------------------------
# scalar / count templates
# ---------------------------------------------------------------------------

def t25(t, state="NATION_3", day=2, stat="mean", pm="pm25"):
    """Mean/median of pm on a weekday (Mon = 0) in one state -- a scalar."""
    r = t.readings
    rows = r.where((F.col("state") == state) & tf.weekday_is(day))
    if stat not in QUANTILES:
        return rows.agg(rnd(agg(stat, pm), 9).alias("value"))
    return group_stats(rows, F.lit(0), {"v": (stat, pm)}).agg(rnd(F.max("v"), 9).alias("value"))


def t25_sql(state="NATION_3", day=2, stat="mean", pm="pm25"):
    return (f"select round({sql_agg(stat, pm)}, 9) as value from readings "
            f"where state = '{state}' and isodow(ts) - 1 = {day}")


def t32(t, loc="city", nums=tuple(range(1, 11))):
    """For each n: how many states/cities have exactly n distinct stations."""
    r = t.readings
    counts = r.where(F.col(loc).isNotNull()).groupBy(loc).agg(
        F.count_distinct("station").alias("n_st"))
    spark = r.sparkSession
    ns = spark.createDataFrame([(int(n),) for n in nums], "n bigint")
    hits = counts.groupBy("n_st").agg(F.count(F.lit(1)).alias("value"))
    # both sides are small (the literal list; one row per station count)
    return (ns.join(hits, ns.n == hits.n_st, "left")
            .select("n", F.coalesce("value", F.lit(0)).cast("bigint").alias("value")))


def t32_sql(loc="city", nums=tuple(range(1, 11))):
    vals = ", ".join(f"({n})" for n in nums)
    return (f"select ns.n, cast(coalesce(h.value, 0) as bigint) as value from "
            f"(select cast(col0 as bigint) as n from (values {vals}) v(col0)) ns left join "
            f"(select n_st, count(*) as value from (select {loc}, count(distinct station) as n_st "
            f"from readings where {loc} is not null group by {loc}) c group by n_st) h "
            f"on ns.n = h.n_st")


def t36(t, year=1998, pm="pm25", limits=(15, 30, 45, 60, 75, 90), city="NATION_5/FURNITURE"):
    """Distinct days a city exceeded each limit in a year (one pass for all limits)."""
    r = t.readings
    df = r.where(tf.in_year(year, r) & (F.col("city") == city) & F.col(pm).isNotNull())
    # a day exceeds a limit if its highest reading does: one row per day, then plain counts
    days = df.groupBy("ts").agg(F.max(pm).alias("top"))
    row = days.agg(*[F.count(F.when(F.col("top") > lim, 1)).alias(f"d{i}")
                     for i, lim in enumerate(limits)])
    stack = ", ".join(f"{float(lim)}D, d{i}" for i, lim in enumerate(limits))
    return row.selectExpr(f"stack({len(limits)}, {stack}) as (limit_value, value)")


def t36_sql(year=1998, pm="pm25", limits=(15, 30, 45, 60, 75, 90), city="NATION_5/FURNITURE"):
    parts = [f"select cast({lim} as double) as limit_value, count(distinct ts) as value "
             f"from readings where {tf.sql_in_year(year)} and city = '{city}' "
             f"and {pm} is not null and {pm} > {lim}" for lim in limits]
    return "\nunion all\n".join(parts)


# ---------------------------------------------------------------------------
# nested rank
# ---------------------------------------------------------------------------

def t28(t, loc="city", pm="pm25", positions=SIX):
    """Location with the fewest readings equal to the nth pm value."""
    # readings of one value and location as one row: ranked, and looked up again
    each = t.readings.where(F.col(pm).isNotNull()).groupBy(F.col(pm).alias("v"), F.col(loc).alias("lbl")).agg(
        F.count(F.lit(1)).alias("n"))
    vals = nth_of_counts(each.select("v", "n"), [("v", True)], positions, [F.col("v").alias("at")], "n")
    # vals has one row per position: broadcasting it is bounded by len(positions).
    hits = each.join(F.broadcast(vals), F.col("v").eqNullSafe(F.col("at")))
    counts = hits.groupBy("pos", "lbl").agg(F.sum("n").alias("n"))
    # not a filter: it would go below one use of the counts and end their sharing
    best = counts.groupBy("pos").agg(F.min(F.when(F.col("lbl").isNotNull(), F.struct("n", "lbl"))).alias("m"))
    return best.where(F.col("m").isNotNull()).select("pos", F.col("m.lbl").alias("answer"), F.col("m.n").alias("value"))


def t28_sql(loc="city", pm="pm25", positions=SIX):
    vals = sql_nth(f"select {pm} as v from readings where {pm} is not null", [("v", True)],
                   positions, ["v"])
    return (f"select pos, lbl as answer, n as value from (select pos, lbl, n, row_number() over "
            f"(partition by pos order by n, lbl) as rk from (select vals.pos, r.{loc} as lbl, "
            f"count(*) as n from readings r join ({vals}) vals on r.{pm} = vals.v "
            f"where r.{loc} is not null group by vals.pos, r.{loc}) c) x where rk = 1")


# ---------------------------------------------------------------------------
# group -> join states -> ratio -> rank
# ---------------------------------------------------------------------------

def _states(t: Tables, ut: bool | None) -> DataFrame:
    s = t.states
    if ut is not None:
        s = s.where(F.col("is_ut") == ut)
    return s


def _sql_states(ut: bool | None) -> str:
    if ut is None:
        return "states"
    return f"(select * from states where is_ut = {'true' if ut else 'false'})"


def _state_stat(t, stat, pm, cond=None) -> DataFrame:
    r = t.readings
    if cond is not None:
        r = r.where(cond(r))
    return _group_stat(r, "state", stat, pm).withColumnRenamed("lbl", "state")


def _sql_state_stat(stat, pm, where="true") -> str:
    return f"select state, {sql_agg(stat, pm)} as pmv from readings where ({where}) " \
           f"and state is not null group by state"


def _ratio_rank(j: DataFrame, ratio: Column, positions, digits: int) -> DataFrame:
    g = j.select(F.col("state").alias("lbl"), ratio.alias("v"))
    return _ranked(g, positions, digits)


def _per_area(t, stat, pm, ut, positions):
    s = _states(t, ut).select("state", "area_km2")
    j = _state_stat(t, stat, pm).join(s, "state")
    return _ratio_rank(j, pdiv(F.col("v"), F.col("area_km2")), positions, 12)


def _sql_per_area(stat, pm, ut, positions):
    base = (f"select g.state as lbl, {sql_pdiv('g.pmv', 's.area_km2')} as v from "
            f"({_sql_state_stat(stat, pm)}) g join {_sql_states(ut)} s on g.state = s.state")
    return _sql_ranked(base, positions, 12)


def t37(t, stat="var", pm="pm10", positions=SIXP):
    """State (not UT) by nth statistic per km2."""
    return _per_area(t, stat, pm, False, positions)


def t37_sql(stat="var", pm="pm10", positions=SIXP):
    return _sql_per_area(stat, pm, False, positions)


def t38(t, stat="q25", pm="pm25", positions=SIXP):
    """UT by nth statistic per km2."""
    return _per_area(t, stat, pm, True, positions)


def t38_sql(stat="q25", pm="pm25", positions=SIXP):
    return _sql_per_area(stat, pm, True, positions)


def _stations_per(t, ut, denom, positions, digits):
    s = _states(t, ut).select("state", denom)
    j = _state_stat(t, "nunique", "station").join(s, "state")
    return _ratio_rank(j, pdiv(F.col("v"), F.col(denom)), positions, digits)


def _sql_stations_per(ut, denom, positions, digits):
    base = (f"select g.state as lbl, {sql_pdiv('g.pmv', f's.{denom}')} as v from "
            f"({_sql_state_stat('nunique', 'station')}) g join {_sql_states(ut)} s "
            f"on g.state = s.state")
    return _sql_ranked(base, positions, digits)


def t39(t, positions=EIGHT):
    """State (UTs kept) by nth stations per km2."""
    return _stations_per(t, None, "area_km2", positions, 12)


def t39_sql(positions=EIGHT):
    return _sql_stations_per(None, "area_km2", positions, 12)


def t40(t, positions=EIGHT):
    """UT by nth stations per km2."""
    return _stations_per(t, True, "area_km2", positions, 12)


def t40_sql(positions=EIGHT):
    return _sql_stations_per(True, "area_km2", positions, 12)


def t51(t, positions=TEN):
    """State by nth stations per person (named per million, not scaled)."""
    return _stations_per(t, None, "population", positions, 15)


def t51_sql(positions=TEN):
    return _sql_stations_per(None, "population", positions, 15)


def t52(t, positions=EIGHT):
    """UT by nth stations per person."""
    return _stations_per(t, True, "population", positions, 15)


def t52_sql(positions=EIGHT):
    return _sql_stations_per(True, "population", positions, 15)


def _combined_area(t, ut, positions):
    r = t.readings
    g = r.where(F.col("state").isNotNull()).groupBy("state").agg(
        F.avg("pm25").alias("a25"), F.avg("pm10").alias("a10"))
    s = _states(t, ut).select("state", "area_km2")
    j = g.join(s, "state").select("state", "area_km2",
                                  (F.col("a25") + F.col("a10")).alias("combined"))
    return nth(j, [("combined", True), ("state", True)], positions,
               [F.col("state").alias("answer"), F.col("area_km2")])


def _sql_combined_area(ut, positions):
    base = (f"select g.state, s.area_km2, g.a25 + g.a10 as combined from (select state, "
            f"avg(pm25) as a25, avg(pm10) as a10 from readings where state is not null "
            f"group by state) g join {_sql_states(ut)} s on g.state = s.state")
    return sql_nth(base, [("combined", True), ("state", True)], positions,
                   ["state as answer", "area_km2"])


def t41(t, positions=EIGHT):
    """Area of the state (not UT) at the nth combined mean PM2.5 + PM10."""
    return _combined_area(t, False, positions)


def t41_sql(positions=EIGHT):
    return _sql_combined_area(False, positions)


def t42(t, positions=EIGHT):
    """Area of the UT at the nth combined mean."""
    return _combined_area(t, True, positions)


def t42_sql(positions=EIGHT):
    return _sql_combined_area(True, positions)


def _area_filtered(t, stat, pm, ut, op, limit, positions):
    s = _states(t, ut).select("state", "area_km2")
    s = s.where(F.col("area_km2") > limit) if op == ">" else s.where(F.col("area_km2") < limit)
    j = _state_stat(t, stat, pm).join(s, "state")
    return _ratio_rank(j, F.col("v"), positions, 9)


def _sql_area_filtered(stat, pm, ut, op, limit, positions):
    base = (f"select g.state as lbl, g.pmv as v from ({_sql_state_stat(stat, pm)}) g "
            f"join {_sql_states(ut)} s on g.state = s.state where s.area_km2 {op} {limit}")
    return _sql_ranked(base, positions, 9)


def t45(t, op=">", stat="median", pm="pm10", positions=SKIP3):
    """State (UTs kept) by nth statistic among states with area >/< 50,000."""
    return _area_filtered(t, stat, pm, None, op, 50000, positions)


def t45_sql(op=">", stat="median", pm="pm10", positions=SKIP3):
    return _sql_area_filtered(stat, pm, None, op, 50000, positions)


def t46(t, op=">", stat="std", pm="pm25", positions=FOUR):
    """UT by nth statistic among UTs with area >/< 1,000."""
    return _area_filtered(t, stat, pm, True, op, 1000, positions)


def t46_sql(op=">", stat="std", pm="pm25", positions=FOUR):
    return _sql_area_filtered(stat, pm, True, op, 1000, positions)


def _per_capita(t, pm, year, ut, positions):
    s = _states(t, ut).select("state", "population")
    j = _state_stat(t, "mean", pm, lambda r: tf.in_year(year, r)).join(s, "state")
    return _ratio_rank(j, pdiv(F.col("v"), F.col("population")) * 1000000, positions, 9)


def _sql_per_capita(pm, year, ut, positions):
    base = (f"select g.state as lbl, {sql_pdiv('g.pmv', 's.population')} * 1000000 as v from "
            f"({_sql_state_stat('mean', pm, tf.sql_in_year(year))}) g join {_sql_states(ut)} s "
            f"on g.state = s.state")
    return _sql_ranked(base, positions, 9)


def t47(t, pm="pm25", year=1999, positions=SKIP3):
    """State (UTs kept) by nth per-capita mean in a year."""
    return _per_capita(t, pm, year, None, positions)


def t47_sql(pm="pm25", year=1999, positions=SKIP3):
    return _sql_per_capita(pm, year, None, positions)


def t48(t, pm="pm10", year=2000, positions=SIXP):
    """UT by nth per-capita mean in a year."""
    return _per_capita(t, pm, year, True, positions)


def t48_sql(pm="pm10", year=2000, positions=SIXP):
    return _sql_per_capita(pm, year, True, positions)


def _per_density(t, stat, pm, ut, positions):
    s = _states(t, ut).select("state", "population", "area_km2")
    j = _state_stat(t, stat, pm).join(s, "state")
    density = pdiv(F.col("population"), F.col("area_km2"))
    return _ratio_rank(j, pdiv(F.col("v"), density), positions, 12)


def _sql_per_density(stat, pm, ut, positions):
    dens = sql_pdiv("s.population", "s.area_km2")
    base = (f"select g.state as lbl, {sql_pdiv('g.pmv', dens)} as v from "
            f"({_sql_state_stat(stat, pm)}) g join {_sql_states(ut)} s on g.state = s.state")
    return _sql_ranked(base, positions, 12)


def t53(t, stat="sum", pm="pm25", positions=TEN):
    """State (UTs kept) by nth statistic / population density."""
    return _per_density(t, stat, pm, None, positions)


def t53_sql(stat="sum", pm="pm25", positions=TEN):
    return _sql_per_density(stat, pm, None, positions)


def t54(t, stat="mean", pm="pm10", positions=EIGHT):
    """UT by nth statistic / population density."""
    return _per_density(t, stat, pm, True, positions)


def t54_sql(stat="mean", pm="pm10", positions=EIGHT):
    return _sql_per_density(stat, pm, True, positions)


# ---------------------------------------------------------------------------
# top-k by a statistic, then rank by an attribute
# ---------------------------------------------------------------------------

def _topk_then(t, stat, pm, ut, k, attr, positions):
    s = _states(t, ut).select("state", attr)
    j = _state_stat(t, stat, pm).join(s, "state")
    top = top_k(j, [("v", False), ("state", False)], k)
    return nth(top, [(attr, True), ("state", True)], positions,
               [F.col("state").alias("answer"), F.col(attr)])


def _sql_topk_then(stat, pm, ut, k, attr, positions):
    j = (f"select g.state, g.pmv as v, s.{attr} from ({_sql_state_stat(stat, pm)}) g "
         f"join {_sql_states(ut)} s on g.state = s.state")
    top = sql_top_k(j, [("v", False), ("state", False)], k)
    return sql_nth(top, [(attr, True), ("state", True)], positions, ["state as answer", attr])


def t43(t, k=5, stat="mean", pm="pm25", positions=SIXP):
    """State (not UT) by nth area among the top k by a statistic."""
    return _topk_then(t, stat, pm, False, k, "area_km2", positions)


def t43_sql(k=5, stat="mean", pm="pm25", positions=SIXP):
    return _sql_topk_then(stat, pm, False, k, "area_km2", positions)


def t44(t, k=4, stat="q75", pm="pm10", positions=FOUR):
    """UT by nth area among the top k UTs."""
    return _topk_then(t, stat, pm, True, k, "area_km2", positions)


def t44_sql(k=4, stat="q75", pm="pm10", positions=FOUR):
    return _sql_topk_then(stat, pm, True, k, "area_km2", positions)


def t55(t, k=10, stat="median", pm="pm10", positions=SIXP):
    """State (not UT) by nth population among the top k by a statistic."""
    return _topk_then(t, stat, pm, False, k, "population", positions)


def t55_sql(k=10, stat="median", pm="pm10", positions=SIXP):
    return _sql_topk_then(stat, pm, False, k, "population", positions)


def t56(t, k=2, stat="sum", pm="pm25", positions=FOUR):
    """UT by nth population among the top k UTs."""
    return _topk_then(t, stat, pm, True, k, "population", positions)


def t56_sql(k=2, stat="sum", pm="pm25", positions=FOUR):
    return _sql_topk_then(stat, pm, True, k, "population", positions)


# ---------------------------------------------------------------------------
# threshold -> semi-join -> share of population
# ---------------------------------------------------------------------------

def _pop_share(t, stat, pm, ut, values, cond=None):
    s = _states(t, ut).select("state", "population")
    g = _state_stat(t, stat, pm, cond)
    spark = g.sparkSession
    vals = spark.createDataFrame([(float(v),) for v in values], "threshold double")
    # States above each threshold; the threshold list is a literal of len(values) rows.
    hot = g.join(F.broadcast(vals), F.col("v") > F.col("threshold")).select("threshold", "state")
    total = s.agg(F.sum("population").alias("total"))
    hot_pop = hot.join(s, "state").groupBy("threshold").agg(F.sum("population").alias("hot"))
    out = vals.join(hot_pop, "threshold", "left")
    pct = pdiv(F.coalesce(F.col("hot"), F.lit(0)) * 100.0, total.scalar())
    return out.select("threshold", rnd(pct, 9).alias("value"))


def _sql_pop_share(stat, pm, ut, values, where="true"):
    vals = ", ".join(f"({float(v)})" for v in values)
    st = _sql_states(ut)
    return (f"select v.threshold, round({sql_pdiv('coalesce(h.hot, 0) * 100.0', f'(select sum(population) from {st} s0)')}, 9) as value "
            f"from (select cast(col0 as double) as threshold from (values {vals}) x(col0)) v "
            f"left join (select th.threshold, sum(s.population) as hot from "
            f"({_sql_state_stat(stat, pm, where)}) g join (select cast(col0 as double) as threshold "
            f"from (values {vals}) y(col0)) th on g.pmv > th.threshold join {st} s "
            f"on g.state = s.state group by th.threshold) h on v.threshold = h.threshold")


def t57(t, stat="mean", pm="pm25", values=(25.3, 25.6, 60.0)):
    """Percent of all population living in states whose statistic exceeds v."""
    return _pop_share(t, stat, pm, None, values)


def t57_sql(stat="mean", pm="pm25", values=(25.3, 25.6, 60.0)):
    return _sql_pop_share(stat, pm, None, values)


def t58(t, stat="q75", pm="pm10", values=(78.8, 79.0, 100.0)):
    """Percent of UT population living in UTs whose statistic exceeds v."""
    return _pop_share(t, stat, pm, True, values)


def t58_sql(stat="q75", pm="pm10", values=(78.8, 79.0, 100.0)):
    return _sql_pop_share(stat, pm, True, values)


# ---------------------------------------------------------------------------
# funding templates
# ---------------------------------------------------------------------------

FY_COLS = {"rel_fy1": "Amount released during FY 1996-97",
           "rel_fy2": "Amount released during FY 1997-98",
           "rel_fy3": "Amount released during FY 1998-99"}


def _funding_sum(t, key, value: Column) -> DataFrame:
    return _group(t.funding, key, F.coalesce(F.sum(value), F.lit(0.0)))


def _sql_funding_sum(key, value: str) -> str:
    return _sql_group(key, f"coalesce(sum({value}), 0)", table="funding")


def _per_capita_funding(t, stat, op, ut, positions):
    s = _states(t, ut).select("state", "population")
    fund = _funding_sum(t, "state", F.col("total_released")).withColumnRenamed("lbl", "state")
    j = s.join(fund, "state")
    threshold = s.agg(agg(stat, "population")).scalar()
    cond = F.col("population") < threshold if op == "<" else F.col("population") > threshold
    j = j.where(cond)
    return _ratio_rank(j, pdiv(F.col("v"), F.col("population")), positions, 12)


def _sql_per_capita_funding(stat, op, ut, positions):
    st = _sql_states(ut)
    base = (f"select s.state as lbl, {sql_pdiv('f.v', 's.population')} as v from {st} s join "
            f"({_sql_funding_sum('state', 'total_released')}) f on s.state = f.lbl "
            f"where s.population {op} (select {sql_agg(stat, 'population')} from {st} s2)")
    return _sql_ranked(base, positions, 12)


def t49(t, stat="median", op="<", positions=SIXP):
    """State by nth funding per capita among states below/above a population statistic."""
    return _per_capita_funding(t, stat, op, None, positions)


def t49_sql(stat="median", op="<", positions=SIXP):
    return _sql_per_capita_funding(stat, op, None, positions)


def t50(t, stat="q25", op=">", positions=TWO):
    """UT version of T49; the threshold is over UTs only."""
    return _per_capita_funding(t, stat, op, True, positions)


def t50_sql(stat="q25", op=">", positions=TWO):
    return _sql_per_capita_funding(stat, op, True, positions)


def t59(t, stat="std", positions=SIXP):
    """Financial year by nth statistic of the per-city amounts (unpivot)."""
    f = t.funding.select(*[F.col(c).alias(name) for c, name in FY_COLS.items()])
    long = f.unpivot([], list(FY_COLS.values()), "column", "amount")
    g = long.groupBy("column").agg(agg(stat, "amount").alias("v"))
    g = g.select(F.element_at(F.split("column", " "), -1).alias("lbl"), "v")
    return _ranked(g, positions, 4)


def t59_sql(stat="std", positions=SIXP):
    parts = " union all ".join(
        f"select '{name}' as col, {c} as amount from funding" for c, name in FY_COLS.items())
    base = (f"select split_part(col, ' ', 5) as lbl, {sql_agg(stat, 'amount')} as v "
            f"from ({parts}) u group by col")
    return _sql_ranked(base, positions, 4)


def _funding_area(t, ut, positions):
    s = _states(t, ut).select("state", "area_km2")
    fund = _funding_sum(t, "state", F.col("total_released")).withColumnRenamed("lbl", "state")
    j = fund.join(s, "state")
    return _ratio_rank(j, pdiv(F.col("v"), F.col("area_km2")), positions, 6)


def _sql_funding_area(ut, positions):
    base = (f"select f.lbl, {sql_pdiv('f.v', 's.area_km2')} as v from "
            f"({_sql_funding_sum('state', 'total_released')}) f join {_sql_states(ut)} s "
            f"on f.lbl = s.state")
    return _sql_ranked(base, positions, 6)


def t60(t, positions=TEN):
    """State (not UT) by nth funding per km2."""
    return _funding_area(t, False, positions)


def t60_sql(positions=TEN):
    return _sql_funding_area(False, positions)


def t61(t, positions=FOUR):
    """UT by nth funding per km2."""
    return _funding_area(t, True, positions)


def t61_sql(positions=FOUR):
    return _sql_funding_area(True, positions)


def t62(t, loc="city", positions=TEN):
    """State/city by nth sum of (released - utilised)."""
    g = _funding_sum(t, loc, F.col("total_released") - F.col("utilised"))
    return _ranked(g, positions, 2)


def t62_sql(loc="city", positions=TEN):
    return _sql_ranked(_sql_funding_sum(loc, "total_released - utilised"), positions, 2)


_CHANGES = {"t63": ("rel_fy1", "rel_fy2"), "t64": ("rel_fy1", "rel_fy3"),
            "t65": ("rel_fy2", "rel_fy3")}


def _change(t, which, loc, ascending, positions):
    a, b = _CHANGES[which]
    g = _funding_sum(t, loc, F.col(b) - F.col(a))
    return _ranked(g, positions, 2, asc=ascending)


def _sql_change(which, loc, ascending, positions):
    a, b = _CHANGES[which]
    return _sql_ranked(_sql_funding_sum(loc, f"{b} - {a}"), positions, 2, asc=ascending)


def t63(t, loc="city", ascending=False, positions=CHANGE):
    """Change FY1 -> FY2 summed per state/city, sorted in the chosen direction."""
    return _change(t, "t63", loc, ascending, positions)


def t63_sql(loc="city", ascending=False, positions=CHANGE):
    return _sql_change("t63", loc, ascending, positions)


def t64(t, loc="state", ascending=True, positions=CHANGE):
    """Change FY1 -> FY3."""
    return _change(t, "t64", loc, ascending, positions)


def t64_sql(loc="state", ascending=True, positions=CHANGE):
    return _sql_change("t64", loc, ascending, positions)


def t65(t, loc="city", ascending=True, positions=CHANGE):
    """Change FY2 -> FY3."""
    return _change(t, "t65", loc, ascending, positions)


def t65_sql(loc="city", ascending=True, positions=CHANGE):
    return _sql_change("t65", loc, ascending, positions)


def t66(t, loc="state", positions=TEN):
    """State/city by nth total funding released."""
    return _ranked(_funding_sum(t, loc, F.col("total_released")), positions, 2)


def t66_sql(loc="state", positions=TEN):
    return _sql_ranked(_sql_funding_sum(loc, "total_released"), positions, 2)


def t67(t, loc="city", positions=TEN):
    """State/city by nth utilisation percent (0/0 is missing and ranks highest)."""
    f = t.funding
    g = f.where(F.col(loc).isNotNull()).groupBy(F.col(loc).alias("lbl")).agg(
        F.coalesce(F.sum("total_released"), F.lit(0.0)).alias("tot"),
        F.coalesce(F.sum("utilised"), F.lit(0.0)).alias("used"))
    g = g.select("lbl", (pdiv(F.col("used"), F.col("tot")) * 100).alias("v"))
    return _ranked(g, positions, 9)


def t67_sql(loc="city", positions=TEN):
    base = (f"select lbl, {sql_pdiv('used', 'tot')} * 100 as v from (select {loc} as lbl, "
            f"coalesce(sum(total_released), 0) as tot, coalesce(sum(utilised), 0) as used "
            f"from funding where {loc} is not null group by {loc}) g")
    return _sql_ranked(base, positions, 9)


def t68(t, positions=TEN):
    """State by nth number of funded cities."""
    return _ranked(_group(t.funding, "state", F.count_distinct("city")), positions)


def t68_sql(positions=TEN):
    return _sql_ranked(_sql_group("state", "count(distinct city)", table="funding"), positions)


def t69(t, positions=FOUR):
    """UT by nth number of funded cities."""
    g = _group(t.funding, "state", F.count_distinct("city")).withColumnRenamed("lbl", "state")
    j = _states(t, True).select("state").join(g, "state")
    return _ratio_rank(j, F.col("v"), positions, 6)


def t69_sql(positions=FOUR):
    base = (f"select s.state as lbl, c.v from {_sql_states(True)} s join "
            f"({_sql_group('state', 'count(distinct city)', table='funding')}) c "
            f"on s.state = c.lbl")
    return _sql_ranked(base, positions)


_FY_YEAR = {"t71": ("rel_fy1", 1997), "t72": ("rel_fy2", 1998), "t73": ("rel_fy3", 1999)}


def _funding_per_pm(t, which, loc, stat, pm, positions):
    fy, year = _FY_YEAR[which]
    g = _group_stat(t.readings.where(tf.in_year(year, t.readings)), loc, stat, pm)
    # Funding rows are joined unaggregated: at state level one state matches
    # several city rows (1:N), as the program does.
    f = t.funding.select(F.col(loc).alias("lbl"), F.col(fy).alias("amount"))
    j = g.join(f, "lbl").select("lbl", pdiv(F.col("amount"), F.col("v")).alias("v"))
    return _ranked(j, positions, 6)


def _sql_funding_per_pm(which, loc, stat, pm, positions):
    fy, year = _FY_YEAR[which]
    base = (f"select g.lbl, {sql_pdiv(f'f.{fy}', 'g.v')} as v from "
            f"({_sql_group(loc, sql_agg(stat, pm), tf.sql_in_year(year))}) g "
            f"join funding f on g.lbl = f.{loc}")
    return _sql_ranked(base, positions, 6)


def t71(t, loc="state", stat="mean", pm="pm25", positions=TEN):
    """State/city by nth FY1 amount per unit of the 1997 statistic."""
    return _funding_per_pm(t, "t71", loc, stat, pm, positions)


def t71_sql(loc="state", stat="mean", pm="pm25", positions=TEN):
    return _sql_funding_per_pm("t71", loc, stat, pm, positions)


def t72(t, loc="city", stat="median", pm="pm10", positions=TEN):
    """FY2 amount per unit of the 1998 statistic."""
    return _funding_per_pm(t, "t72", loc, stat, pm, positions)


def t72_sql(loc="city", stat="median", pm="pm10", positions=TEN):
    return _sql_funding_per_pm("t72", loc, stat, pm, positions)


def t73(t, loc="city", stat="sum", pm="pm25", positions=TEN):
    """FY3 amount per unit of the 1999 statistic."""
    return _funding_per_pm(t, "t73", loc, stat, pm, positions)


def t73_sql(loc="city", stat="sum", pm="pm25", positions=TEN):
    return _sql_funding_per_pm("t73", loc, stat, pm, positions)


TEMPLATE_IDS = (1, 2, 3, 4, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23,
                25, 26, 27, 28, 29, 30, 31, 32, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46,
                47, 48, 49, 50, 51, 52, 53, 54, 55, 56, 57, 58, 59, 60, 61, 62, 63, 64, 65,
                66, 67, 68, 69, 70, 71, 72, 73)
