"""B1-B18 on literal bulletin tables (one per layout, plus the edge cases)."""

import datetime as dt

from pyspark.sql import functions as F

from airlens.operators import bulletins as b

H1 = b.LAYOUT_1_HEADERS[0]
H2 = b.LAYOUT_2_HEADERS[1]
H3 = b.LAYOUT_3_HEADERS[0]
H4 = b.LAYOUT_4_HEADERS[1]
N = None

TABLES = [
    # layout 1: quality comes from the next row's cell 2
    ("2020-01-01", 1, [H1, ["Agra", "", N, N, "138", "PM2.5"], [N, N, "Moderate", N, N, N],
                       ["Delhi", "", N, N, "300", "PM10"], ["", N, "Poor", N, N, N]]),
    # layout 2: quality in cell 1, or the next row; stations in cell 6
    ("2020-01-01", 2, [H2, ["Pune", "Good", N, N, "45", "O3", "3"],
                       ["Surat", "", N, N, "77", "PM10", "2"], [N, N, "Satisfactory", N, N, N, N]]),
    # layout 3
    ("2020-01-02", 1, [H3, ["Kota", "Moderate", "150", "PM10", "1"]]),
    # layout 4: AQI before a newline, row starts on a valid S.No
    ("2020-01-02", 2, [H4, ["1", "Ajmer", "Satisfactory", "53\n(x)", "PM\n2.5", "1"],
                       [N, N, "", N, N, N], ["2", " Gurgaon\n", "Poor", "201", "PM10", "3/4"]]),
    # legend: skipped
    ("2020-01-02", 3, [b.LEGEND_HEADERS[2], ["0-50", "Good", "green", "Minimal"]]),
    # unknown header: quarantined
    ("2020-01-03", 1, [["What", "Is", "This"], ["a", "b", "c"]]),
    # non-integer AQI: whole table dropped
    ("2020-01-03", 2, [H3, ["Kota", "Good", "40", "PM10", "1"], ["Bhopal", "Good", "N/A", "PM10", "1"]]),
    # last row needs a next row that does not exist: whole table dropped
    ("2020-01-04", 1, [H1, ["Agra", "", N, N, "100", "PM10"]]),
    # a city twice in one table: the last row wins
    ("2020-01-05", 1, [H3, ["vellore", "Good", "40", "PM10", "1"], ["Aurangabad", "Good", "41", "PM10", "1"],
                       ["vellore", "Poor", "250", "PM2.5", "2"]]),
    # same city again on a later page of the same day: the first page wins
    ("2020-01-05", 2, [H3, ["Vellore", "Severe", "450", "PM10", "9"]]),
]


def _cells(spark):
    return spark.createDataFrame(TABLES, b.CELLS_SCHEMA)


def test_route(spark):
    got = {(r["date"], r["page"]): r["layout"] for r in b.route(_cells(spark)).collect()}
    assert got[("2020-01-01", 1)] == 1 and got[("2020-01-01", 2)] == 2
    assert got[("2020-01-02", 1)] == 3 and got[("2020-01-02", 2)] == 4
    assert got[("2020-01-02", 3)] == 0 and got[("2020-01-03", 1)] is None


def test_every_layout_2_header_routes(spark):
    rows = [("2020-01-01", i, [h]) for i, h in enumerate(b.LAYOUT_2_HEADERS)]
    df = spark.createDataFrame(rows, b.CELLS_SCHEMA)
    assert {r["layout"] for r in b.route(df).collect()} == {2}


def test_quarantine(spark):
    got = {(r["date"], r["page"]): r["status"] for r in b.quarantine(_cells(spark)).collect()}
    assert got == {("2020-01-03", 1): "unknown_header", ("2020-01-03", 2): "bad_row",
                   ("2020-01-04", 1): "bad_row"}


def test_records_per_layout(spark):
    recs = {(r["date"], r["city_raw"]): r for r in b.records(_cells(spark)).collect()}
    agra = recs[("2020-01-01", "Agra")]
    assert (agra["aqi"], agra["pollutant"], agra["quality"], agra["stations"]) == \
        (138, "PM2.5", "Moderate", None)
    assert recs[("2020-01-01", "Delhi")]["quality"] == "Poor"
    assert recs[("2020-01-01", "Pune")]["quality"] == "Good"
    surat = recs[("2020-01-01", "Surat")]
    assert (surat["quality"], surat["stations"]) == ("Satisfactory", "2")
    kota = recs[("2020-01-02", "Kota")]
    assert (kota["aqi"], kota["pollutant"], kota["stations"]) == (150, "PM10", "1")
    ajmer = recs[("2020-01-02", "Ajmer")]
    assert (ajmer["aqi"], ajmer["quality"], ajmer["pollutant"]) == (53, "Satisfactory", "PM\n2.5")
    # continuation rows and legend rows emit nothing
    assert len([k for k in recs if k[0] == "2020-01-01"]) == 4


def test_city_day_pipeline(spark):
    lookup = spark.createDataFrame(
        [("Agra", "Uttar Pradesh"), ("Delhi", "Delhi"), ("Pune", "Maharashtra"),
         ("Surat", "Gujarat"), ("Kota", "Rajasthan"), ("Ajmer", "Rajasthan"),
         ("Vellore", "Tamil Nadu")], "city string, state string")
    good, bad = b.city_day(_cells(spark), lookup)
    got = {(r["date"], r["city"]): r for r in good.collect()}
    d5 = dt.date(2020, 1, 5)
    # Last row of the table wins; B16: the first page of the day wins
    assert got[(d5, "Vellore")]["aqi"] == 250
    # Aurangabad dropped; B12: stripped and aliased (Gurgaon -> Gurugram)
    assert not any(k[1] == "Aurangabad" for k in got)
    assert {r["city"] for r in bad.collect()} == {"Gurugram"}
    # B18 station counts
    assert got[(dt.date(2020, 1, 1), "Surat")]["n_stations"] == 2
    assert got[(dt.date(2020, 1, 1), "Agra")]["n_stations"] is None


def test_parse_stations(spark):
    df = spark.createDataFrame([("1/2",), ("3#",), (" 12\n/15",), ("x",), (None,)], "s string")
    got = [r["n"] for r in df.select(b.parse_stations(F.col("s")).alias("n")).collect()]
    assert got == [1, 3, 12, None, None]


def test_densify_and_spine(spark):
    cd = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1), (dt.date(2020, 1, 3), "B", 2)],
                               "date date, city string, aqi int")
    d = b.densify(cd)
    assert d.count() == 4 and d.where(F.col("aqi").isNull()).count() == 2
    spine = spark.sql("select explode(sequence(date'2020-01-01', date'2020-01-04')) as date")
    assert spine.count() == 4
    pend = b.pending_dates(spine, cd)
    assert sorted(r["date"].day for r in pend.collect()) == [2, 4]
