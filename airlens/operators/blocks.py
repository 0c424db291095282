"""Building blocks of SURVEY section 2 as standalone queries (P, F, G, R, J, X).

The catalog composes these; here each one is registered on its own over the
whole readings / states / funding tables so it has its own oracle check.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from airlens.functions import timefx as tf
from airlens.functions.arith import pdiv, rnd, sql_pdiv
from airlens.functions.stats import group_stats, sem, sql_agg
from airlens.operators.rank import nth, sql_nth, sql_top_k, top_k
from airlens.plans.registry import Entry


def _profile(df):
    return df.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("pm25"), 9).alias("mean_pm25"),
                  rnd(F.avg("pm10"), 9).alias("mean_pm10"))


def _sql_profile(where, table="readings"):
    return (f"select count(*) as n, round(avg(pm25), 9) as mean_pm25, round(avg(pm10), 9) as "
            f"mean_pm10 from {table} where {where}")


# --- predicates on readings: (id, spark condition builder, SQL condition) ---------
AS_OF = dt.date(2001, 11, 30)
_P = [
    ("P1", lambda r, years: tf.in_year(1998, r), tf.sql_in_year(1998)),
    ("P2", lambda r, years: tf.month_is(2) & tf.in_any_year((2,), years), "month(ts) = 2"),
    ("P3", lambda r, years: tf.on_date(1999, 1, 14, r), tf.sql_on_date(1999, 1, 14)),
    ("P4", lambda r, years: tf.month_day(12, 31) & tf.in_any_year((12,), years, 31), "month(ts) = 12 and day(ts) = 31"),
    ("P5", lambda r, years: tf.month_in((12, 1, 2)) & tf.in_any_year((12, 1, 2), years), "month(ts) in (12, 1, 2)"),
    ("P6", lambda r, years: tf.year_in((1996, 2000), r), "year(ts) in (1996, 2000)"),
    ("P7", lambda r, years: tf.in_years(1997, 1999, r), "year(ts) between 1997 and 1999"),
    ("P8", lambda r, years: tf.last_n_years(2001, 3, r), "year(ts) >= 1998"),
    ("P9", lambda r, years: tf.last_days(AS_OF, 5 * 365, r),
     f"ts >= timestamp '{(AS_OF - dt.timedelta(days=1825)).isoformat()}'"),
    ("P10", lambda r, years: tf.weekday_is(4), "isodow(ts) - 1 = 4"),
    ("P11", lambda r, years: (F.col("state") == "NATION_7") & (F.col("city") == "NATION_7/BUILDING"),
     "state = 'NATION_7' and city = 'NATION_7/BUILDING'"),
    ("P12", lambda r, years: F.col("pm25").isNotNull(), "pm25 is not null"),
    ("P13", lambda r, years: F.col("pm10") > 75, "pm10 > 75"),
]


def _pred_entry(cond, sql):
    return Entry(lambda t: _profile(t.readings.where(cond(t.readings, t.stored_years))), _sql_profile(sql))


def p14(t):
    """States with area > 50,000 (and < for the complement count)."""
    s = t.states
    return s.agg(F.sum(F.when(F.col("area_km2") > 50000, 1).otherwise(0)).alias("n_gt"),
                 F.sum(F.when(F.col("area_km2") < 50000, 1).otherwise(0)).alias("n_lt"))


P14_SQL = ("select cast(sum(case when area_km2 > 50000 then 1 else 0 end) as bigint) as n_gt, "
           "cast(sum(case when area_km2 < 50000 then 1 else 0 end) as bigint) as n_lt from states")


def p15(t):
    """States below the median population (a scalar subquery)."""
    s = t.states
    return s.where(F.col("population") < s.agg(F.median("population")).scalar()).select("state")


P15_SQL = "select state from states where population < (select median(population) from states)"


def p16(t):
    """UT and non-UT counts."""
    return t.states.groupBy("is_ut").agg(F.count(F.lit(1)).alias("n"))


P16_SQL = "select is_ut, count(*) as n from states group by is_ut"


def p17(t):
    """Cities with exactly n distinct stations (HAVING)."""
    g = t.readings.groupBy("city").agg(F.count_distinct("station").alias("n_st"))
    return g.where(F.col("n_st") == 12).select("city")


P17_SQL = "select city from readings group by city having count(distinct station) = 12"


def p18(t):
    """Readings of funded cities (membership in a computed set: semi-join)."""
    funded = t.funding.where(F.col("total_released") > 0).select("city")
    return _profile(t.readings.join(funded, "city", "left_semi"))


P18_SQL = _sql_profile("city in (select city from funding where total_released > 0)")


def p19(t):
    """Rows whose pm25 equals the 3rd smallest value (join to a 1-row rank)."""
    r = t.readings.where(F.col("pm25").isNotNull())
    v = nth(r.select(F.col("pm25").alias("v")), [("v", True)], [2], ["v"])
    return _profile(r.join(F.broadcast(v), r.pm25 == v.v))


P19_SQL = _sql_profile("pm25 = (select pm25 from readings where pm25 is not null order by pm25 "
                       "limit 1 offset 2)")


def p20(t):
    """P20: inclusive 1-based id range."""
    return t.samples.where(F.col("question_id").between(10, 20)).agg(F.count(F.lit(1)).alias("n"))


P20_SQL = "select count(*) as n from samples where question_id between 10 and 20"


def p21(t):
    """One category."""
    return t.samples.where(F.col("category") == "cat_3").agg(F.count(F.lit(1)).alias("n"))


P21_SQL = "select count(*) as n from samples where category = 'cat_3'"


# --- scalar functions ---------------------------------------------------------------

def _counts_by(key_spark, key_sql, where_spark=None, where_sql="true", name="k"):
    def build(t):
        r = t.readings
        if where_spark is not None:
            r = r.where(where_spark(r))
        return r.groupBy(key_spark().alias(name)).agg(F.count(F.lit(1)).alias("n"))
    sql = f"select {key_sql} as {name}, count(*) as n from readings where {where_sql} group by {key_sql}"
    return Entry(build, sql)


def f8(t):
    """F8: financial-year label = last token of the column name, with the cities
    and the amount of each, from all of funding unpivoted by column name."""
    from airlens.operators.catalog import FY_COLS
    f = t.funding.select("city", *[F.col(c).alias(n) for c, n in FY_COLS.items()])
    u = f.unpivot(["city"], list(FY_COLS.values()), "col", "amount")
    return u.groupBy(F.element_at(F.split("col", " "), -1).alias("fy")).agg(
        F.count("amount").alias("n_cities"), rnd(F.sum("amount"), 4).alias("amount"))


def _f8_sql():
    from airlens.operators.catalog import FY_COLS
    return "select fy, count(amount) as n_cities, round(sum(amount), 4) as amount from (" + " union all ".join(
        f"select '{name.split()[-1]}' as fy, {col} as amount from funding"
        for col, name in FY_COLS.items()) + ") u group by fy"


def _state_ratio(expr_spark, expr_sql, digits, ut=None):
    def build(t):
        s = t.states
        j = t.readings.groupBy("state").agg(F.avg("pm25").alias("m25"), F.avg("pm10").alias("m10"),
                                            F.count_distinct("station").alias("n_st")).join(s, "state")
        return j.select("state", rnd(expr_spark(), digits).alias("value"))
    sql = (f"select g.state, round({expr_sql}, {digits}) as value from (select state, avg(pm25) as "
           f"m25, avg(pm10) as m10, count(distinct station) as n_st from readings group by state) g "
           f"join states s on g.state = s.state")
    return Entry(build, sql)


def f13(t):
    """difference of two columns per row (funding)."""
    f = t.funding
    return f.select("city", rnd(F.col("total_released") - F.col("utilised"), 2).alias("value"))


F13_SQL = "select city, round(total_released - utilised, 2) as value from funding"


def f14(t):
    """percentage of totals."""
    f = t.funding
    return f.select("city", rnd(pdiv(F.col("utilised"), F.col("total_released")) * 100, 9).alias("pct"))


F14_SQL = f"select city, round({sql_pdiv('utilised', 'total_released')} * 100, 9) as pct from funding"


def f19(t):
    """Date_City key."""
    r = t.readings
    k = F.concat_ws("_", F.to_date("ts").cast("string"), F.col("city"))
    return r.agg(F.count_distinct(k).alias("n_keys"))


F19_SQL = ("select count(distinct cast(cast(ts as date) as varchar) || '_' || city) as n_keys "
           "from readings")


# --- aggregations --------------------------------------------------------------------

def _stat_by_state(stat, col, digits=9):
    def build(t):
        g = group_stats(t.readings.where(F.col("state").isNotNull()), F.col("state"), {"v": (stat, col)})
        return g.select(F.col("lbl").alias("state"), rnd(F.col("v").cast("double"), digits).alias("value"))
    sql = (f"select state, round(cast({sql_agg(stat, col)} as double), {digits}) as value from "
           f"readings where state is not null group by state")
    return Entry(build, sql)


def g9(t):
    return t.readings.agg(F.max("pm10").alias("value"))


def g10(t):
    r = t.readings
    g = group_stats(r, F.lit(0), {"mean": ("mean", "pm25"), "median": ("median", "pm25")})
    return g.agg(rnd(F.max("mean"), 9).alias("mean"), rnd(F.max("median"), 9).alias("median"))


def g11(t):
    """Column-wise statistic over the three FY columns (unpivot)."""
    from airlens.operators.catalog import FY_COLS
    f = t.funding.select(*[F.col(c).alias(n) for c, n in FY_COLS.items()])
    long = f.unpivot([], list(FY_COLS.values()), "col", "amount")
    return long.groupBy("col").agg(rnd(F.avg("amount"), 4).alias("mean"),
                                   rnd(F.median("amount"), 4).alias("median"))


def _sql_fy_long():
    from airlens.operators.catalog import FY_COLS
    return " union all ".join(f"select '{n}' as col, {c} as amount from funding"
                              for c, n in FY_COLS.items())


def g12(t):
    g = t.readings.groupBy("city").agg(rnd(F.avg("pm25"), 9).alias("m25"), rnd(F.avg("pm10"), 9).alias("m10"))
    return g


def g13(t):
    g = t.readings.groupBy("state").agg(rnd(sem("pm25"), 9).alias("sem"))
    return g


def g14(t):
    r = t.readings
    return r.groupBy("state", F.year("ts").cast("bigint").alias("year")).agg(rnd(F.avg("pm25"), 9).alias("value"))


def g15(t):
    r = t.readings
    return r.groupBy(tf.weekday_name().alias("weekday")).agg(rnd(F.avg("pm10"), 9).alias("value"))


def g16(t):
    """NULL group keys are dropped (pandas), not kept (SQL)."""
    r = t.readings
    key = F.when(F.col("pm25").isNotNull(), F.col("state"))
    return r.where(key.isNotNull()).groupBy(key.alias("state")).agg(F.count(F.lit(1)).alias("n"))


# --- ranking -------------------------------------------------------------------------

def _city_means(t):
    return t.readings.groupBy(F.col("city").alias("lbl")).agg(F.avg("pm10").alias("v"))


_SQL_CITY_MEANS = "select city as lbl, avg(pm10) as v from readings group by city"


def r1(t):
    return nth(_city_means(t), [("v", True), ("lbl", True)], (0, 1, 2, -1, -2, -3),
               [F.col("lbl").alias("answer"), rnd(F.col("v"), 9).alias("value")])


R1_SQL = sql_nth(_SQL_CITY_MEANS, [("v", True), ("lbl", True)], (0, 1, 2, -1, -2, -3),
                 ["lbl as answer", "round(v, 9) as value"])


def r2(t):
    """R2: len(df) - k positions (k <= n: same as -k; k > n: no row)."""
    return nth(_city_means(t), [("v", True), ("lbl", True)], (-4, -5, -1000),
               [F.col("lbl").alias("answer")])


R2_SQL = sql_nth(_SQL_CITY_MEANS, [("v", True), ("lbl", True)], (-4, -5, -1000), ["lbl as answer"])


def r3(t):
    return top_k(_city_means(t), [("v", False), ("lbl", False)], 5).select(
        F.col("lbl").alias("answer"), rnd(F.col("v"), 9).alias("value"))


_R3_TOP = sql_top_k(_SQL_CITY_MEANS, [("v", False), ("lbl", False)], 5)
R3_SQL = f"select lbl as answer, round(v, 9) as value from ({_R3_TOP}) t"


def r4(t):
    """Top 10 cities by mean PM10, then the 2nd by number of stations."""
    g = t.readings.groupBy(F.col("city").alias("lbl")).agg(
        F.avg("pm10").alias("v"), F.count_distinct("station").alias("n_st"))
    top = top_k(g, [("v", False), ("lbl", False)], 10)
    return nth(top, [("n_st", True), ("lbl", True)], (1,), [F.col("lbl").alias("answer"), "n_st"])


R4_SQL = sql_nth(sql_top_k("select city as lbl, avg(pm10) as v, count(distinct station) as n_st "
                           "from readings group by city", [("v", False), ("lbl", False)], 10),
                 [("n_st", True), ("lbl", True)], (1,), ["lbl as answer", "n_st"])


def r5(t):
    """Idxmax -- the label of the largest value (max_by)."""
    g = _city_means(t)
    return g.agg(F.max_by("lbl", "v").alias("answer"))


R5_SQL = f"select arg_max(lbl, v) as answer from ({_SQL_CITY_MEANS}) g"


def r6(t):
    """Descending order (NULLs stay last)."""
    return nth(_city_means(t), [("v", False), ("lbl", False)], (0, 1, -1),
               [F.col("lbl").alias("answer")])


R6_SQL = sql_nth(_SQL_CITY_MEANS, [("v", False), ("lbl", False)], (0, 1, -1), ["lbl as answer"])


def r7(t):
    """Top-3 and bottom-3 lists."""
    g = _city_means(t)
    top = top_k(g, [("v", False), ("lbl", False)], 3).withColumn("side", F.lit("top"))
    bottom = top_k(g, [("v", True), ("lbl", True)], 3).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", F.col("lbl").alias("answer"))


_R7_TOP = sql_top_k(_SQL_CITY_MEANS, [("v", False), ("lbl", False)], 3)
_R7_BOTTOM = sql_top_k(_SQL_CITY_MEANS, [("v", True), ("lbl", True)], 3)
R7_SQL = (f"select 'top' as side, lbl as answer from ({_R7_TOP}) a "
          f"union all select 'bottom', lbl from ({_R7_BOTTOM}) b")


# --- joins ---------------------------------------------------------------------------

def j1(t):
    g = t.readings.groupBy("state").agg(rnd(F.avg("pm25"), 9).alias("m"))
    return g.join(t.states.select("state", "area_km2"), "state")


J1_SQL = ("select g.state, g.m, s.area_km2 from (select state, round(avg(pm25), 9) as m from "
          "readings group by state) g join states s on g.state = s.state")


def j2(t):
    f = t.funding.groupBy("state").agg(F.sum("total_released").alias("tot"))
    j = f.join(t.states.select("state", "population"), "state")
    return j.select("state", rnd(F.col("tot") / F.col("population"), 9).alias("per_capita"))


J2_SQL = ("select f.state, round(f.tot / s.population, 9) as per_capita from (select state, "
          "sum(total_released) as tot from funding group by state) f join states s on f.state = s.state")


def j3(t):
    """State aggregate joined 1:N to city-level funding rows."""
    g = t.readings.groupBy("state").agg(rnd(F.avg("pm25"), 9).alias("m"))
    return g.join(t.funding.select("state", "city", "rel_fy1"), "state")


J3_SQL = ("select g.state, g.m, f.city, f.rel_fy1 from (select state, round(avg(pm25), 9) as m "
          "from readings group by state) g join funding f on g.state = f.state")


def j4(t):
    g = t.readings.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
    return g.join(t.funding.select("city", "total_released"), "city")


J4_SQL = ("select g.city, g.n, f.total_released from (select city, count(*) as n from readings "
          "group by city) g join funding f on g.city = f.city")


def j5(t):
    return t.states.join(t.funding.select("state"), "state", "left_semi").select("state")


J5_SQL = "select state from states where state in (select state from funding)"


def j6(t):
    return t.states.join(t.funding.select("state"), "state", "left_anti").select("state")


J6_SQL = "select state from states where state not in (select state from funding)"


def j7(t):
    """Map-lookup join: city -> canonical alias (most cities unmapped)."""
    from airlens.operators.bulletins import alias_table
    al = alias_table(t.spark)
    # the funded cities, and each state's name written as two cities that have aliases
    c = t.funding.select("city").unionByName(t.states.select(F.when(
        F.col("is_ut"), "Gurgaon").otherwise("vellore").alias("city")))
    return c.join(F.broadcast(al), c.city == al.raw, "left").select(
        "city", F.coalesce("canonical", "city").alias("canonical"))


J7_SQL = ("select city, city as canonical from funding union all select case when is_ut then 'Gurgaon' "
          "else 'vellore' end, case when is_ut then 'Gurugram' else 'Vellore' end from states")


def j8(t):
    """Responses joined to questions on id (not by position)."""
    q = t.documents.select(F.col("doc_id").alias("question_id"), "lang")
    s = t.samples.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return q.join(s, "question_id")


J8_SQL = ("select d.doc_id as question_id, d.lang, s.n from documents d join (select question_id, "
          "count(*) as n from samples group by question_id) s on d.doc_id = s.question_id")


def j11(t):
    """Two-period aligned subtraction in one pass (conditional aggregation)."""
    r = t.readings
    r = r.where(tf.year_in((1996, 2000), r))
    y = F.year("ts")
    g = r.groupBy("state").agg(F.avg(F.when(y == 1996, F.col("pm25"))).alias("a"),
                               F.avg(F.when(y == 2000, F.col("pm25"))).alias("b"))
    return g.select("state", rnd(F.col("a") - F.col("b"), 9).alias("decrease"))


J11_SQL = ("select state, round(avg(case when year(ts) = 1996 then pm25 end) - avg(case when "
           "year(ts) = 2000 then pm25 end), 9) as decrease from readings group by state")


# --- reshape ----------------------------------------------------------------------------

def x1(t):
    """Pivot on year (values listed, so one pass)."""
    r = t.readings.where(tf.in_years(1996, 1998, t.readings))
    p = r.groupBy("state").pivot("year", [1996, 1997, 1998]).agg(F.avg("pm25"))
    return p.select("state", *[rnd(F.col(str(y)), 9).alias(f"y{y}") for y in (1996, 1997, 1998)])


X1_SQL = ("select state, " + ", ".join(
    f"round(avg(case when year(ts) = {y} then pm25 end), 9) as y{y}" for y in (1996, 1997, 1998))
    + " from readings where year(ts) between 1996 and 1998 group by state")


def x3(t):
    """Concatenation keeps duplicates."""
    a = t.funding.select("state", "city")
    return a.unionByName(a).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


X3_SQL = "select state, 2 * count(*) as n from funding group by state"


def x4(t):
    """Drop duplicates keep first (by order key) -- min_by per key."""
    r = t.readings
    g = r.groupBy("city").agg(F.min_by("station", F.struct("ts", "station")).alias("first_station"))
    return g


X4_SQL = ("select city, station as first_station from (select city, station, row_number() over "
          "(partition by city order by ts, station) as rk from readings) x where rk = 1")


def x5(t):
    return t.readings.select("state").distinct()


X5_SQL = "select distinct state from readings"


def x6(t):
    """First five samples of each question (``generated_samples[:5]``).
    Rows past the fifth are cut by a per-question ``row_number() <= 5``, which
    Spark limits before the shuffle, so the array built is at most 5 long."""
    w = Window.partitionBy("question_id").orderBy("sample_idx")
    first = t.samples.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 5)
    s = first.groupBy("question_id").agg(F.array_sort(F.collect_list("sample_idx")).alias("a"))
    return s.select("question_id", F.size(F.slice("a", 1, 5)).cast("bigint").alias("n"))


X6_SQL = "select question_id, least(count(*), 5) as n from samples group by question_id"


def x7(t):
    """Explode sample lists back to rows. The lists are built in chunks of
    at most 10 samples per question, so no list grows with a hot question."""
    chunk = F.floor(F.col("sample_idx") / 10)
    s = t.samples.groupBy("question_id", chunk.alias("chunk")).agg(
        F.collect_list("sample_idx").alias("a"))
    return s.select("question_id", F.explode("a").alias("sample_idx"))


X7_SQL = "select question_id, sample_idx from samples"


def x2(t):
    """The three FY columns unpivoted to (column, amount) rows."""
    from airlens.operators.catalog import FY_COLS
    f = t.funding.select("city", *[F.col(c).alias(n) for c, n in FY_COLS.items()])
    return f.unpivot(["city"], list(FY_COLS.values()), "col", "amount").select(
        "city", "col", rnd(F.col("amount"), 2).alias("amount"))


def c2(t):
    """Lint of the template documents built from the tables, sound and faulty ones."""
    from airlens.operators.corpus import lint_templates
    from airlens.sources.files import template_values, write_templates
    lint = lint_templates(*template_values(t.spark, write_templates(t, faulty=True)))
    return lint.select("template_id", *[
        F.array_join(c, ",").alias(c)
        for c in ("unequal_lists", "undeclared", "unused", "code_undeclared", "code_unused")])


C2_SQL = ("select cast(r_regionkey as integer) as template_id, '' as unequal_lists, '' as undeclared, "
          "'' as unused, '' as code_undeclared, '' as code_unused from region union all "
          "select cast(r_regionkey + 1000 as integer), case when exists (select 1 from nation where "
          "n_regionkey = r_regionkey) then 'state' else '' end, 'month', '', 'code_col', 'code_year' "
          "from region")


def registry():
    from airlens.operators import evaluation as ev
    from airlens.operators import corpus as co
    reg = {pid: _pred_entry(cond, sql) for pid, cond, sql in _P}
    reg.update({
        "X2": Entry(x2, "select city, col, round(amount, 2) as amount from (" + " union all ".join(
            f"select city, '{n}' as col, {c} as amount from funding" for c, n in
            __import__("airlens.operators.catalog", fromlist=["FY_COLS"]).FY_COLS.items()) + ") u"),
        "C2": Entry(c2, C2_SQL, ()),
        "F17": Entry(ev.e1, ev.E1_SQL, ()),
        "F18": Entry(co.c1, co.C1_SQL, ("readings",)),
        "J9": Entry(ev.e17, ev.E17_SQL, ("samples",)),
        "J10": Entry(ev.e16, ev.E16_SQL, ("samples",)),
    })
    reg.update({
        "P14": Entry(p14, P14_SQL), "P15": Entry(p15, P15_SQL), "P16": Entry(p16, P16_SQL),
        "P17": Entry(p17, P17_SQL), "P18": Entry(p18, P18_SQL), "P19": Entry(p19, P19_SQL),
        "P20": Entry(p20, P20_SQL, ("samples",)), "P21": Entry(p21, P21_SQL, ("samples",)),
        "F1": _counts_by(lambda: (F.year("ts") * 100 + F.month("ts")).cast("bigint"),
                         "year(ts) * 100 + month(ts)"),
        "F2": _counts_by(tf.weekday_name, "dayname(ts)"),
        "F3": _counts_by(tf.month_name, "monthname(ts)"),
        "F4": _counts_by(lambda: tf.iso_week().cast("bigint"), "weekofyear(ts)",
                         lambda r: tf.in_year(1999, r),
                         tf.sql_in_year(1999)),
        "F5": _counts_by(tf.season_a, "case when month(ts) in (3, 4, 5) then 'Summer' when month(ts) "
                         "in (12, 1, 2) then 'Winter' when month(ts) in (6, 7, 8) then 'Monsoon' "
                         "else 'Post-Monsoon' end"),
        "F6": _counts_by(tf.season_b, tf.SQL_SEASON_B),
        "F7": _counts_by(lambda: F.to_date("ts"), "cast(ts as date)", lambda r: tf.in_year(2000, r),
                         tf.sql_in_year(2000)),
        "F8": Entry(f8, _f8_sql()),
        "F9": _state_ratio(lambda: pdiv(F.col("m25"), F.col("area_km2")), sql_pdiv("m25", "area_km2"), 12),
        "F10": _state_ratio(lambda: pdiv(F.col("m25"), F.col("population")) * 1000000,
                            f"{sql_pdiv('m25', 'population')} * 1000000", 9),
        "F11": _state_ratio(lambda: pdiv(F.col("m10"), pdiv(F.col("population"), F.col("area_km2"))),
                            sql_pdiv("m10", sql_pdiv("population", "area_km2")), 12),
        "F12": _state_ratio(lambda: F.col("m25") + F.col("m10"), "m25 + m10", 9),
        "F13": Entry(f13, F13_SQL), "F14": Entry(f14, F14_SQL),
        "F15": _state_ratio(lambda: F.col("m25") * F.col("population"), "m25 * population", 2),
        "F16": _state_ratio(lambda: pdiv(F.col("n_st"), F.col("population") / 1e6),
                            sql_pdiv("n_st", "population / 1e6"), 9),
        "F19": Entry(f19, F19_SQL),
        "G1": _stat_by_state("mean", "pm10"), "G2": _stat_by_state("median", "pm10"),
        "G3": _stat_by_state("q25", "pm10"), "G4": _stat_by_state("sum", "pm25", 4),
        "G5": _stat_by_state("std", "pm10", 9), "G6": _stat_by_state("var", "pm10", 9),
        "G7": _stat_by_state("nunique", "city"),
        "G8": Entry(lambda t: t.readings.groupBy("state").agg(F.count(F.lit(1)).alias("n")),
                    "select state, count(*) as n from readings group by state"),
        "G9": Entry(g9, "select max(pm10) as value from readings"),
        "G10": Entry(g10, "select round(avg(pm25), 9) as mean, round(median(pm25), 9) as median "
                          "from readings"),
        "G11": Entry(g11, f"select col, round(avg(amount), 4) as mean, round(median(amount), 4) as "
                          f"median from ({_sql_fy_long()}) u group by col"),
        "G12": Entry(g12, "select city, round(avg(pm25), 9) as m25, round(avg(pm10), 9) as m10 "
                          "from readings group by city"),
        "G13": Entry(g13, "select state, round(stddev_samp(pm25) / sqrt(count(pm25)), 9) as sem "
                          "from readings group by state"),
        "G14": Entry(g14, "select state, year(ts) as year, round(avg(pm25), 9) as value from "
                          "readings group by state, year(ts)"),
        "G15": Entry(g15, "select dayname(ts) as weekday, round(avg(pm10), 9) as value from "
                          "readings group by dayname(ts)"),
        "G16": Entry(g16, "select state, count(*) as n from readings where pm25 is not null "
                          "group by state"),
        "R1": Entry(r1, R1_SQL), "R2": Entry(r2, R2_SQL), "R3": Entry(r3, R3_SQL),
        "R4": Entry(r4, R4_SQL), "R5": Entry(r5, R5_SQL), "R6": Entry(r6, R6_SQL),
        "R7": Entry(r7, R7_SQL),
        "J1": Entry(j1, J1_SQL), "J2": Entry(j2, J2_SQL), "J3": Entry(j3, J3_SQL),
        "J4": Entry(j4, J4_SQL), "J5": Entry(j5, J5_SQL), "J6": Entry(j6, J6_SQL),
        "J7": Entry(j7, J7_SQL), "J8": Entry(j8, J8_SQL, ("samples",)),
        "J11": Entry(j11, J11_SQL),
        "X1": Entry(x1, X1_SQL), "X3": Entry(x3, X3_SQL), "X4": Entry(x4, X4_SQL),
        "X5": Entry(x5, X5_SQL), "X6": Entry(x6, X6_SQL, ("samples",)),
        "X7": Entry(x7, X7_SQL, ("samples",)),
    })
    return reg
