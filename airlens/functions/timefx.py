"""Calendar predicates (P1-P10) and date-derived keys.

Year and day predicates are written as half-open ``ts`` ranges plus an
equality on the ``year`` partition column when the frame has one: the range
reaches the parquet reader as a pushed filter, the equality prunes
directories. ``year(ts) = Y`` alone would be pushed as ``IsNotNull`` only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.sources.tables import ts_literal

TS = "ts"


def _ts(d: dt.date) -> Column:
    return ts_literal(f"{d.isoformat()} 00:00:00")


def _has_year(df: DataFrame | None) -> bool:
    return df is not None and "year" in df.columns


def in_year(y: int, df: DataFrame | None = None) -> Column:
    """Calendar year = y."""
    cond = (F.col(TS) >= _ts(dt.date(y, 1, 1))) & (F.col(TS) < _ts(dt.date(y + 1, 1, 1)))
    return (F.col("year") == y) & cond if _has_year(df) else cond


def in_years(y0: int, y1: int, df: DataFrame | None = None) -> Column:
    """y0 <= year <= y1."""
    cond = (F.col(TS) >= _ts(dt.date(y0, 1, 1))) & (F.col(TS) < _ts(dt.date(y1 + 1, 1, 1)))
    return F.col("year").between(y0, y1) & cond if _has_year(df) else cond


def year_in(years, df: DataFrame | None = None) -> Column:
    """Year is one of ``years``."""
    cond = F.lit(False)
    for y in years:
        cond = cond | in_year(y, None)
    return F.col("year").isin(list(years)) & cond if _has_year(df) else cond


def on_date(y: int, m: int, d: int, df: DataFrame | None = None) -> Column:
    """The day y-m-d."""
    day = dt.date(y, m, d)
    cond = (F.col(TS) >= _ts(day)) & (F.col(TS) < _ts(day + dt.timedelta(days=1)))
    return (F.col("year") == y) & cond if _has_year(df) else cond


def month_is(m: int) -> Column:
    """P2."""
    return F.month(TS) == m


def month_in(months) -> Column:
    """P5."""
    return F.month(TS).isin(list(months))


def month_day(m: int, d: int) -> Column:
    """This month and day in any year."""
    return (F.month(TS) == m) & (F.dayofmonth(TS) == d)


def in_any_year(months, years, day: int | None = None) -> Column:
    """The stretches of time that hold these months (or one day of them), as ``ts``
    ranges, one or two for each of ``years``, the years that are stored
    (``Tables.stored_years``): implied by the month predicate it accompanies, and
    pushed to the parquet reader, so row groups of other months are skipped. With
    no years known it is always true."""
    spans: list[list[dt.date]] = []
    for y in sorted(years):
        for m in sorted(months):
            nxt = dt.date(y + m // 12, m % 12 + 1, 1)
            if day is None:
                a, b = dt.date(y, m, 1), nxt
            else:
                a = dt.date(y, m, 1) + dt.timedelta(days=day - 1)
                b = a + dt.timedelta(days=1)
                if a >= nxt:
                    continue
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
    if not years:
        return F.lit(True)
    out = F.lit(False)
    for a, b in spans:
        out = out | ((F.col(TS) >= _ts(a)) & (F.col(TS) < _ts(b)))
    return out


def weekday_is(k: int) -> Column:
    """P10: Monday = 0 ... Sunday = 6."""
    return F.weekday(TS) == k


def last_n_years(as_of_year: int, n: int, df: DataFrame | None = None) -> Column:
    """Year >= as_of_year - n (the clock is a parameter)."""
    y0 = as_of_year - n
    cond = F.col(TS) >= _ts(dt.date(y0, 1, 1))
    return (F.col("year") >= y0) & cond if _has_year(df) else cond


def last_days(as_of: dt.date, days: int, df: DataFrame | None = None) -> Column:
    """Ts >= as_of - days."""
    first = as_of - dt.timedelta(days=days)
    cond = F.col(TS) >= _ts(first)
    return (F.col("year") >= first.year) & cond if _has_year(df) else cond


def weekday_name() -> Column:
    """full English weekday name."""
    return F.date_format(TS, "EEEE")


def month_name() -> Column:
    """full English month name."""
    return F.date_format(TS, "MMMM")


def iso_week() -> Column:
    """ISO-8601 week number."""
    return F.weekofyear(TS)


def season_a(m: Column | None = None) -> Column:
    """Summer 3-5, Winter 12/1/2 (same calendar year), Monsoon 6-8, Post-Monsoon 9-11."""
    m = F.month(TS) if m is None else m
    return (F.when(m.isin(3, 4, 5), "Summer").when(m.isin(12, 1, 2), "Winter")
            .when(m.isin(6, 7, 8), "Monsoon").otherwise("Post-Monsoon"))


def season_b(m: Column | None = None) -> Column:
    """Winter 10-12, Summer 3-5, Monsoon 6-8, otherwise Post-Monsoon."""
    m = F.month(TS) if m is None else m
    return (F.when(m.isin(10, 11, 12), "Winter").when(m.isin(3, 4, 5), "Summer")
            .when(m.isin(6, 7, 8), "Monsoon").otherwise("Post-Monsoon"))


# Seasons of F5 as month lists, in the order the catalog enumerates them.
SEASONS_A = {"Summer": (3, 4, 5), "Winter": (12, 1, 2), "Monsoon": (6, 7, 8),
             "Post-Monsoon": (9, 10, 11)}

# SQL forms used by the oracle (DuckDB dialect).
SQL_SEASON_B = ("case when month(ts) in (10, 11, 12) then 'Winter' "
                "when month(ts) in (3, 4, 5) then 'Summer' "
                "when month(ts) in (6, 7, 8) then 'Monsoon' else 'Post-Monsoon' end")


def sql_in_year(y: int) -> str:
    return f"ts >= timestamp '{y}-01-01' and ts < timestamp '{y + 1}-01-01'"


def sql_on_date(y: int, m: int, d: int) -> str:
    day = dt.date(y, m, d)
    nxt = day + dt.timedelta(days=1)
    return f"ts >= timestamp '{day.isoformat()}' and ts < timestamp '{nxt.isoformat()}'"
