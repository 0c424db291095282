"""Large tables are built and grouped by more tasks, with the same rows."""

from datetime import datetime, timedelta

from airlens.operators import bulletins
from airlens.sources.tables import Tables, build_readings, tasks_for
from tests.conftest import SF_SMALL


def test_tasks_follow_the_rows(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks_for(spark.range(10)) == least
    assert tasks_for(spark.range(1000), 10) == 100


def test_build_and_city_days_deal_large_tables_to_more_tasks(spark, monkeypatch):
    t = Tables(spark, SF_SMALL)
    want = sorted(map(repr, build_readings(t).collect()))
    monkeypatch.setitem(build_readings.__globals__, "tasks_for", lambda rows, rows_a_task=1: 37)
    monkeypatch.setattr(bulletins, "tasks_for", lambda rows, rows_a_task=1: 41)
    monkeypatch.setitem(build_readings.__globals__, "ROWS_A_TASK", 10)
    built = build_readings(t)
    assert sorted(map(repr, built.collect())) == want
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and ", 37)" in plan
    own = Tables.of(spark, spark.createDataFrame(
        [(datetime(1999, 1, 1), "s", "c", "x", 1.0, 2.0)],
        "ts timestamp_ntz, station string, city string, state string, pm25 double, pm10 double"))
    days = bulletins.source_city_days(own)._jdf.queryExecution().executedPlan().toString()
    assert ", 41)" in days


def test_late_pages_deal_only_their_own_days(spark, tmp_path):
    start = datetime(1995, 1, 1)
    rows = [(start + timedelta(days=d), f"s{i}", f"c{i}", "x", 1.0 + i, 2.0) for d in range(-17, 52) for i in range(4)]
    rows += [(None, "s", "c", "x", 1.0, 2.0), (start, "s9", None, "x", 1.0, 2.0)]
    own = Tables.of(spark, spark.createDataFrame(
        rows, "ts timestamp_ntz, station string, city string, state string, pm25 double, pm10 double"))
    whole = bulletins.source_city_days(own).where("dn % 17 = 0").orderBy("d", "r")
    late = bulletins.source_city_days(own, bulletins.LATE_EVERY)
    assert late.orderBy("d", "r").collect() == whole.collect()
    assert late.select("d").distinct().count() == 5
    plan = bulletins.extra_cells(own)._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression"):]
    assert "% 17" in dealt
