"""Arithmetic with pandas' float semantics.

ANSI mode raises on division by zero; pandas returns +/-inf, and NaN for 0/0.
``pdiv`` reproduces that: x/0 is +inf or -inf by the sign of x, 0/0 is NULL
(NaN is "missing" throughout this library and sorts like NULL).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def pdiv(num: Column, den: Column) -> Column:
    return (F.when(den.isNull() | num.isNull(), F.lit(None).cast("double"))
            .when(den == 0, F.when(num > 0, F.lit(INF))
                  .when(num < 0, F.lit(-INF))
                  .otherwise(F.lit(None).cast("double")))
            .otherwise(num.cast("double") / den))


def sql_pdiv(num: str, den: str) -> str:
    return (f"(case when ({den}) = 0 then (case when ({num}) > 0 then 'inf'::double "
            f"when ({num}) < 0 then '-inf'::double else null end) "
            f"else cast({num} as double) / ({den}) end)")


def rnd(c: Column, digits: int) -> Column:
    """Round a computed double for output (engines differ in the last bits)."""
    return F.round(c, digits)
