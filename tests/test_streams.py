"""A sink resumes, two landings of one snapshot do not meet, every query is whole."""

from pyspark.sql import functions as F

from airlens.streaming import incremental as inc


def _landing(spark, folder, days):
    rows = [(f"2020-01-{d:02d} 10:00:00", "st", c, "S", float(p), 1.0) for d, c, p in days]
    (spark.createDataFrame(rows, "ts string, station string, city string, state string, pm25 double, pm10 double")
     .withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(folder))


def _rows(df):
    return sorted((str(r["date"]), r["city"], r["n_exceed"]) for r in df.collect())


def test_two_landings_of_one_snapshot(spark, tmp_path):
    days = [(1, "a", 20), (1, "a", 30), (2, "a", 10), (2, "b", 16)]
    want = [("2020-01-01", "a", 2), ("2020-01-02", "b", 1)]
    for n in ("one", "two"):
        _landing(spark, str(tmp_path / n), days)
    for n, sink in (("one", "s1"), ("two", "s2"), ("one", "s3")):
        assert _rows(inc.exceedance_stream(spark, str(tmp_path / n), str(tmp_path / sink))) == want


def test_a_sink_resumes_and_late_rows_count(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "sink")
    _landing(spark, src, [(5, "a", 20)])
    assert _rows(inc.exceedance_stream(spark, src, sink)) == [("2020-01-05", "a", 1)]
    _landing(spark, src, [(1, "b", 99), (5, "a", 21)])
    want = [("2020-01-01", "b", 1), ("2020-01-05", "a", 2)]
    assert _rows(inc.exceedance_stream(spark, src, sink)) == want
    assert _rows(inc.exceedance_stream(spark, src, sink)) == want


def test_own_frames_do_not_share_what_is_stored(spark):
    from airlens.operators import sketches
    from airlens.sources.tables import Tables
    for n in (1, 3):
        r = spark.createDataFrame([("2020-01-01 10:00:00", "st", "a", "S", 20.0 * n, 1.0)] * n,
                                  "ts string, station string, city string, state string, pm25 double, pm10 double")
        t = Tables.of(spark, r.withColumn("ts", F.to_timestamp_ntz("ts")))
        assert _rows(inc.s2(t)) == [("2020-01-01", "a", n)]
        got = sketches.k4(t).first()
        assert got["n"] == n and abs(got["median"] - 20 * n) <= sketches.ERROR * 20 * n
