"""The catalog on a caller's own frames: a nine-column CSV, a city lookup, and nothing else."""

import pytest

from airlens.operators import bulletins, catalog
from airlens.sources import files
from airlens.sources.tables import Tables

HEADER = "Timestamp,station,PM2.5,PM10,address,city,latitude,longitude,state"
ROWS = [("2019-01-01 00:00:00", "S1", "10", "20", "C1", "A"), ("2019-01-02 00:00:00", "S1", "30", "nan", "C1", "A"),
        ("2019-01-01 00:00:00", "S2", "", "5", "C2", "A"), ("2020-02-03 00:00:00", "S3", "50.5", "7", "C3", "B")]


@pytest.fixture()
def own(spark, tmp_path):
    (tmp_path / "readings.csv").write_text("\n".join(
        [HEADER] + [f"{ts},{s},{a},{b},addr,{c},1.5,2.5,{st}" for ts, s, a, b, c, st in ROWS]))
    return Tables.of(spark, files.read_readings_csv(spark, str(tmp_path / "readings.csv")))


def test_t2_and_t13_on_a_csv(own):
    got = {r["pos"]: r for r in catalog.t2(own, loc="station", pm="pm25", positions=(0, 1, 2, -1)).collect()}
    assert [got[i]["answer"] for i in (0, 1, 2)] == ["S1", "S3", "S2"]      # S2 has no reading: last
    assert got[-1]["answer"] == "S2"
    years = catalog.t13(own, pm="pm10", positions=(0, 1)).collect()
    assert {r["pos"]: str(r["answer"]) for r in years} == {0: "2020", 1: "2019"}


def test_city_lookup_is_the_callers(spark, own):
    first = spark.createDataFrame([("C1", 1), ("C9", 1)], "city string, n int")
    assert {r["city"]: r["state"] for r in first.join(own.city_states, "city", "left").collect()} == {"C1": "A", "C9": None}
    t = Tables.of(spark, own.readings, city_states=spark.createDataFrame([("C1", "Z")], "city string, state string"))
    cells = bulletins.build_cells(t)
    good, bad = bulletins.city_day(cells, t.city_states)
    assert {r["state"] for r in good.select("state").distinct().collect()} <= {"Z"}
    assert "C1" not in {r["city"] for r in bad.select("city").distinct().collect()}


def test_missing_frames_and_columns_are_named(spark, own):
    with pytest.raises(ValueError, match="funding"):
        own.funding
    with pytest.raises(ValueError, match="pm10"):
        Tables.of(spark, own.readings.drop("pm10"))
