"""All variants of the catalog's shapes against a brute force, and how much is held and shuffled for them."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from airlens.operators import lattice

SCHEMA = "ts timestamp_ntz, station string, city string, state string, pm25 double, pm10 double"


def some_readings(n=900):
    r = random.Random(5)
    rows = [(None if r.random() < .02 else datetime(1999, 11, 1) + timedelta(days=r.randrange(120)),
             None if r.random() < .03 else f"s{r.randrange(40)}", f"c{r.randrange(5)}", f"b|{r.randrange(3)}",
             None if r.random() < .1 else float(r.randrange(6)), r.choice([None, 1.5, 0.1234567, r.random()]))
            for _ in range(n)]
    return rows + rows[:20]


def brute(rows):
    parts = defaultdict(list)
    for ts, station, city, state, *pm in rows:
        season = ts and next(s for s, m in lattice.SEASONS.items() if ts.month in m)
        at = {"station": station, "city": city, "state": state, "year": ts and ts.year, "month": ts and ts.month,
              "season": season, "weekday": ts and ts.isoweekday() % 7 + 1}
        for shape, label, scope in (s for level in lattice.SHAPES.values() for s in level):
            if at[label] is not None:
                text = "|".join("" if at[c] is None else str(at[c]) for c in scope)
                parts[shape, text, str(at[label])].append(pm)
    ranked = defaultdict(list)
    for (shape, scope, label), values in parts.items():
        for i, p in enumerate(lattice.POLLUTANTS):
            x = [round(v[i], 6) for v in values if v[i] is not None]
            told = {"mean": sum(x) / len(x), "max": max(x), "min": min(x)} if x else dict.fromkeys(["mean", "max", "min"])
            for stat, v in (told | {"n": float(len(x))}).items():
                # sums in another order differ in their last bits
                ranked[shape, scope, p, stat].append((v is None, v and round(v, 9), label))
    out = set()
    for key, found in ranked.items():
        found.sort(key=lambda f: (f[0], f[1] or 0.0, f[2]))
        for pos in [*range(3), -1, -2, -3]:
            if -len(found) <= pos < len(found):
                out.add((*key, pos, found[pos][2], found[pos][1]))
    return out


def told(df):
    rows = [(*r[:6], r["value"] and round(r["value"], 9)) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_every_variant_equals_brute_force_whatever_the_tasks_and_batches(spark):
    rows = some_readings()
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert told(lattice.answers(df)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert told(lattice.answers(df, tasks=3)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_window_sorts_the_labels_and_stations_are_shuffled_once(spark):
    df = spark.createDataFrame(some_readings(50), SCHEMA)
    plan = lattice.answers(df, tasks=3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" not in plan
    stations = lattice.station_variants(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert stations.count("Exchange") == 1


def test_cube_cells_do_not_hold_stations(spark):
    df = spark.createDataFrame(some_readings(50), SCHEMA)
    assert "station" not in lattice.cube(df)._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]
