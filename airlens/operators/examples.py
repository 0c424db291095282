"""Documentation examples (Q1-Q12): queries the reference shows or describes
outside the template set, built from the same pieces as the catalog."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from airlens.functions import timefx as tf
from airlens.functions.arith import pdiv, rnd, sql_pdiv
from airlens.operators.catalog import (SIX, _pop_share, _ranked, _sql_pop_share, _sql_ranked,
                                       _state_stat)
from airlens.plans.registry import Entry


def q1(t):
    """Highest PM2.5 ever recorded."""
    return t.readings.agg(F.max("pm25").alias("value"))


Q1_SQL = "select max(pm25) as value from readings"


def _two_year_means(t, loc, pm, y1, y2):
    """Per-location means of two years in one pass (outer alignment: a
    location missing a year gets NULL for it)."""
    r = t.readings
    y = F.year("ts")
    df = r.where(tf.year_in((y1, y2), r) & F.col(loc).isNotNull())
    return df.groupBy(F.col(loc).alias("lbl")).agg(
        F.avg(F.when(y == y1, F.col(pm))).alias("a"),
        F.avg(F.when(y == y2, F.col(pm))).alias("b"))


def _sql_two_year_means(loc, pm, y1, y2):
    return (f"select {loc} as lbl, avg(case when year(ts) = {y1} then {pm} end) as a, "
            f"avg(case when year(ts) = {y2} then {pm} end) as b from readings "
            f"where year(ts) in ({y1}, {y2}) and {loc} is not null group by {loc}")


def q2(t, pm="pm10", y1=1997, y2=2000, positions=SIX):
    """State by nth decrease (mean y1 - mean y2); example asks for index 1."""
    g = _two_year_means(t, "state", pm, y1, y2).select("lbl", (F.col("a") - F.col("b")).alias("v"))
    return _ranked(g, positions)


def q2_sql(pm="pm10", y1=1997, y2=2000, positions=SIX):
    return _sql_ranked(f"select lbl, a - b as v from ({_sql_two_year_means('state', pm, y1, y2)}) m",
                       positions)


def q3(t, y1=1998, y2=1999):
    """State with the largest year-over-year improvement in mean PM2.5."""
    g = _two_year_means(t, "state", "pm25", y1, y2).select(
        "lbl", (F.col("a") - F.col("b")).alias("v")).where(F.col("v").isNotNull())
    return _ranked(g, (-1,))


def q3_sql(y1=1998, y2=1999):
    base = (f"select lbl, a - b as v from ({_sql_two_year_means('state', 'pm25', y1, y2)}) m "
            f"where a - b is not null")
    return _sql_ranked(base, (-1,))


def q4(t, year=2000):
    """State with the highest population-weighted mean PM2.5 in a year."""
    s = t.states.select("state", "population")
    j = _state_stat(t, "mean", "pm25", lambda r: tf.in_year(year, r)).join(s, "state")
    g = j.select(F.col("state").alias("lbl"), (F.col("v") * F.col("population")).alias("v"))
    return _ranked(g, (-1,), 2)


def q4_sql(year=2000):
    base = (f"select g.state as lbl, g.v * s.population as v from (select state, avg(pm25) as v "
            f"from readings where {tf.sql_in_year(year)} and state is not null group by state) g "
            f"join states s on g.state = s.state")
    return _sql_ranked(base, (-1,), 2)


AS_OF = dt.date(2001, 11, 30)


def q5(t, city="NATION_7/HOUSEHOLD", limit=15.0, as_of=AS_OF, days=5 * 365):
    """Distinct days in the last 5 x 365 days a city's PM2.5 exceeded a limit."""
    r = t.readings
    return r.where((F.col("city") == city) & tf.last_days(as_of, days, r)
                   & (F.col("pm25") > limit)).agg(
        F.count_distinct(F.to_date("ts")).alias("value"))


def q5_sql(city="NATION_7/HOUSEHOLD", limit=15.0, as_of=AS_OF, days=5 * 365):
    start = as_of - dt.timedelta(days=days)
    return (f"select count(distinct cast(ts as date)) as value from readings where "
            f"city = '{city}' and ts >= timestamp '{start.isoformat()}' and pm25 > {limit}")


def q6(t):
    """Mean utilisation rate over funded cities."""
    f = t.funding.where(F.col("total_released") > 0)
    return f.agg(rnd(F.avg(F.col("utilised") / F.col("total_released")), 9).alias("value"))


Q6_SQL = ("select round(avg(utilised / total_released), 9) as value from funding "
          "where total_released > 0")


def q7(t, y1=1996, y2=1999, positions=SIX):
    """Cities by PM2.5 improvement (mean y1 - mean y2) per unit of funding."""
    g = _two_year_means(t, "city", "pm25", y1, y2)
    f = t.funding.select(F.col("city").alias("lbl"), "total_released")
    j = g.join(f, "lbl").select("lbl", pdiv(F.col("a") - F.col("b"),
                                            F.col("total_released")).alias("v"))
    return _ranked(j.where(F.col("v").isNotNull()), positions, 15)


def q7_sql(y1=1996, y2=1999, positions=SIX):
    base = (f"select m.lbl, {sql_pdiv('m.a - m.b', 'f.total_released')} as v from "
            f"({_sql_two_year_means('city', 'pm25', y1, y2)}) m join funding f on m.lbl = f.city "
            f"where {sql_pdiv('m.a - m.b', 'f.total_released')} is not null")
    return _sql_ranked(base, positions, 15)


def q8(t, city="NATION_4/BUILDING", year=1999):
    """Monthly mean PM2.5 series for a city over a year (a table, not a scalar)."""
    r = t.readings
    return (r.where((F.col("city") == city) & tf.in_year(year, r))
            .groupBy(F.month("ts").cast("bigint").alias("month"))
            .agg(rnd(F.avg("pm25"), 9).alias("value"), F.count(F.lit(1)).alias("n")))


def q8_sql(city="NATION_4/BUILDING", year=1999):
    return (f"select month(ts) as month, round(avg(pm25), 9) as value, count(*) as n "
            f"from readings where city = '{city}' and {tf.sql_in_year(year)} group by month(ts)")


def q9(t, positions=SIX):
    """States by monitoring stations per million people."""
    s = t.states.select("state", "population")
    j = _state_stat(t, "nunique", "station").join(s, "state")
    g = j.select(F.col("state").alias("lbl"),
                 pdiv(F.col("v"), F.col("population") / 1e6).alias("v"))
    return _ranked(g, positions, 9)


def q9_sql(positions=SIX):
    base = (f"select g.state as lbl, {sql_pdiv('g.v', 's.population / 1e6')} as v from "
            f"(select state, count(distinct station) as v from readings where state is not null "
            f"group by state) g join states s on g.state = s.state")
    return _sql_ranked(base, positions, 9)


def q10(t, pm="pm25"):
    """Rank of every state by mean PM per km2 (the window spans the states
    dimension only: at most one row per state)."""
    s = t.states.select("state", "area_km2")
    j = _state_stat(t, "mean", pm).join(s, "state").select(
        "state", pdiv(F.col("v"), F.col("area_km2")).alias("v"))
    w = Window.orderBy(F.col("v").desc_nulls_last())
    return j.select("state", rnd(F.col("v"), 12).alias("value"), F.rank().over(w).cast("bigint").alias("rnk"))


def q10_sql(pm="pm25"):
    return (f"select state, round(v, 12) as value, rank() over (order by v desc nulls last) as rnk "
            f"from (select g.state, {sql_pdiv('g.v', 's.area_km2')} as v from (select state, "
            f"avg({pm}) as v from readings where state is not null group by state) g "
            f"join states s on g.state = s.state) x")


def q11(t, year=2000, values=(15.0, 25.5)):
    """Percent of population in states whose mean PM2.5 in a year exceeds v."""
    return _pop_share(t, "mean", "pm25", None, values, lambda r: tf.in_year(year, r))


def q11_sql(year=2000, values=(15.0, 25.5)):
    return _sql_pop_share("mean", "pm25", None, values, tf.sql_in_year(year))


def q12(t, city="NATION_12/HOUSEHOLD", pm="pm10", day=(1998, 3, 14), positions=SIX):
    """Station of a city with the nth reading on a date."""
    r = t.readings
    y, m, d = day
    rows = r.where((F.col("city") == city) & tf.on_date(y, m, d, r) & F.col(pm).isNotNull())
    return _ranked(rows.select(F.col("station").alias("lbl"), F.col(pm).alias("v")), positions)


def q12_sql(city="NATION_12/HOUSEHOLD", pm="pm10", day=(1998, 3, 14), positions=SIX):
    y, m, d = day
    base = (f"select station as lbl, {pm} as v from readings where city = '{city}' and "
            f"{tf.sql_on_date(y, m, d)} and {pm} is not null")
    return _sql_ranked(base, positions)


def registry():
    return {
        "Q1": Entry(q1, Q1_SQL),
        "Q2": Entry(q2, q2_sql()),
        "Q3": Entry(q3, q3_sql()),
        "Q4": Entry(q4, q4_sql()),
        "Q5": Entry(q5, q5_sql()),
        "Q6": Entry(q6, Q6_SQL),
        "Q7": Entry(q7, q7_sql()),
        "Q8": Entry(q8, q8_sql()),
        "Q9": Entry(q9, q9_sql()),
        "Q10": Entry(q10, q10_sql()),
        "Q11": Entry(q11, q11_sql()),
        "Q12": Entry(q12, q12_sql()),
    }
