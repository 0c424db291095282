"""File scans: columns by name, folders per run, records in full."""

from airlens.operators import evaluation as ev
from airlens.sources import files
from airlens.sources.tables import tables
from tests.conftest import SF_SMALL


def test_readings_file_with_columns_in_any_order(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "station,Timestamp,PM2.5,PM10,address,city,latitude,longitude,state\n"
        "S1,2020-01-02 00:00:00,12.5,NaN,Road 1,Agra,27.1,78.0,UP\n")
    r = files.read_readings_csv(spark, str(tmp_path)).first()
    assert (r["station"], r["city"], r["state"], r["pm25"], r["pm10"]) == ("S1", "Agra", "UP", 12.5, None)
    assert (r["address"], r["latitude"], r["longitude"]) == ("Road 1", 27.1, 78.0)


def test_questions_file(spark, tmp_path):
    (tmp_path / "q.csv").write_text('category,id,answer,extra,code,question\n'
                                    'a,7,"4\n2",x,"def f():\n    return ""q"" ","Which?\nWhy? "\n')
    r = files.read_questions_csv(spark, str(tmp_path)).first()
    assert tuple(r) == (7, "a", "Which?\nWhy? ", "4\n2", 'def f():\n    return "q" ')


def test_city_states(spark, tmp_path):
    (tmp_path / "c.csv").write_text("state,city\nUP,Agra\nMH,Pune\nMH,Pune\n")
    assert sorted(map(tuple, files.read_city_states(spark, str(tmp_path)).collect())) == [
        ("Agra", "UP"), ("Pune", "MH")]


def test_a_reader_keeps_its_files(spark):
    t = tables(spark, SF_SMALL)
    first, lint = files.a4(t), None
    from airlens.operators.blocks import c2
    lint = c2(t)
    again = files.a4(t)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert lint.count() == 10


def test_evaluation_of_response_records(spark):
    responses = spark.createDataFrame([("m", "c", 1, [f"```python\nx{i}\n```" for i in range(7)]),
                                       ("m", "c", 2, ["y"])],
                                      "model string, category string, question_id long, "
                                      "generated_samples array<string>")
    runs = spark.createDataFrame([(1, 0, 0, False, "EXEC_OK: 5", "5"), (1, 1, 1, False, "KeyError: 'a'", "5")],
                                 "question_id long, sample_idx long, exit_code int, timed_out boolean, "
                                 "log string, answer string")
    rows = sorted(ev.evaluate(responses, runs).collect(), key=lambda r: (r["question_id"], r["sample_idx"]))
    assert [(r["question_id"], r["sample_idx"]) for r in rows] == [(1, i) for i in range(5)] + [(2, 0)]
    assert [r["code"] for r in rows[:2]] == ["\nx0\n", "\nx1\n"]
    assert [r["passed"] for r in rows] == [True] + [False] * 5
    assert rows[0]["matched"] and rows[1]["error_type"] == "KeyError"
    q = {r["question_id"]: r for r in ev.question_metrics(ev.evaluate(responses, runs)).collect()}
    assert abs(q[1]["pass_at_1"] - 0.2) < 1e-12 and q[1]["n"] == 5


def test_late_rows_reach_the_streams(spark, tmp_path):
    import datetime as dt
    from airlens.streaming import incremental as inc
    schema = "ts timestamp_ntz, station string, city string, state string, pm25 double, pm10 double"
    src, sink = f"{tmp_path}/in", f"{tmp_path}/sink"

    def land(day, n):
        spark.createDataFrame([(dt.datetime.fromisoformat(day), f"s{i}", "A", "B", 40.0, 1.0)
                               for i in range(n)], schema).coalesce(1).write.mode("append").parquet(src)

    land("2022-07-01", 2)
    inc.exceedance_stream(spark, src, sink)
    land("2020-02-01", 3)                            # two years late, after a restart
    land("2022-07-01", 1)
    got = inc.exceedance_stream(spark, src, sink, files_per_batch=1).collect()
    assert sorted((str(r["date"]), r["n_exceed"]) for r in got) == [("2020-02-01", 3), ("2022-07-01", 3)]
