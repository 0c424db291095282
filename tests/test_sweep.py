"""The all-variants sweep agrees with the per-variant catalog function."""

from pyspark.sql import functions as F

from airlens.operators import catalog
from airlens.operators.sweep import sweep_t8
from airlens.sources.tables import tables
from tests.conftest import SF_SMALL


def test_sweep_matches_t8(spark):
    t = tables(spark, SF_SMALL)
    sw = sweep_t8(t, years=(1996, 1999)).cache()
    # 3 locations x 2 pollutants x 4 statistics x 12 months x 2 years x 6 positions at most
    assert sw.count() <= 3 * 2 * 4 * 12 * 2 * 6
    for loc, pm, stat, month, year in [("city", "pm10", "q25", 3, 1996),
                                       ("state", "pm25", "median", 11, 1999),
                                       ("station", "pm10", "mean", 7, 1996)]:
        want = {(r["pos"], r["answer"], r["value"]) for r in
                catalog.t8(t, loc=loc, pm=pm, month=month, year=year, stat=stat).collect()}
        got = {(r["pos"], r["answer"], r["value"]) for r in sw.where(
            (F.col("loc") == loc) & (F.col("pm") == pm) & (F.col("stat") == stat)
            & (F.col("month") == month) & (F.col("year") == year)).collect()}
        assert got == want
    sw.unpersist()
