"""Queries that rank from both ends or take quantiles read the readings once."""

import re

import pytest
from pyspark.sql import functions as F

from airlens.operators import blocks, catalog
from airlens.sources.tables import tables
from tests.conftest import SF_SMALL


def final_plan(df) -> str:
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def scans_of_readings(plan: str) -> int:
    """Scans that run: a reused exchange repeats none of what is below it."""
    return len(re.findall(r"FileScan parquet .*?(?:pm25|pm10)", plan))


@pytest.mark.parametrize("name, build", [
    ("G10", blocks.g10), ("T4", catalog.t4), ("T8", catalog.t8), ("T9", catalog.t9),
    ("T28", catalog.t28),
    ("T27", lambda t: catalog.t27(t, city=t.readings.select(F.min("city")).first()[0], last_years=9))])
def test_readings_are_read_once(spark, name, build):
    plan = final_plan(build(tables(spark, SF_SMALL)))
    assert scans_of_readings(plan) == 1, plan


def test_months_are_ranges_of_the_stored_years(spark):
    t = tables(spark, SF_SMALL)
    years = [r[0] for r in t.readings.select("year").distinct().orderBy("year").collect()]
    assert list(t.stored_years) == [y for y in years if y is not None]
    plan = blocks.registry()["P2"].build(t)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ts#\d+ >= ", plan)) == len(t.stored_years)


def test_own_frames_have_no_stored_years(spark):
    from airlens.sources.tables import Tables
    t = tables(spark, SF_SMALL)
    own = Tables.of(spark, t.readings.drop("year"))
    assert own.stored_years == ()
    assert blocks.registry()["P4"].build(own).collect() == blocks.registry()["P4"].build(t).collect()
