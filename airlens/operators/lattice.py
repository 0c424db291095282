"""Answers to all variants of many template shapes in one job, and cubes, by a lattice of partial aggregates.

Cells hold mergeable partials (count, sum, least, greatest). Station cells would be
nearly as many as the readings, so the station shapes come from the readings dealt
by station, each aggregated in place; city cells come from the readings, merged before
the shuffle; state cells from city cells, time cells from state cells. A shape of
question is a row of a parameter table for one level: what it ranks (its label) and
what its variants fix (its scope). Each cell adds its partials to the variants of its
level's shapes. Of every variant's labels a task keeps the places from both ends
of each statistic, so what is shuffled and sorted are these few.

Sums are decimals of six places, so they are exact and the order in which partials
are merged changes no answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.sources.tables import tasks_for

POLLUTANTS = ("pm25", "pm10")
STATS = ("mean", "max", "min", "n")
EXACT = "decimal(28,6)"   # of a reading
PLACES = 3                # from each end

# months of the seasons as the catalog has them (December counts to its own year)
SEASONS = {"Winter": (12, 1, 2), "Spring": (3, 4, 5), "Summer": (6, 7, 8), "Autumn": (9, 10, 11)}

# level -> shapes (name, label, scope); the station, city and state levels share the first six
_PLACE = (("all", None), ("year", ("year",)), ("month", ("month",)), ("month_year", ("year", "month")),
          ("season_year", ("year", "season")), ("weekday", ("weekday",)))
SHAPES: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {
    level: [(f"{level}_by_{name}", level, scope or ()) for name, scope in _PLACE]
    for level in ("station", "city", "state")}
SHAPES["city"].append(("city_in_state", "city", ("state",)))
SHAPES["state"] += [("year_of_state", "year", ("state",)), ("month_of_state", "month", ("state",))]
SHAPES["time"] = [("year_by_all", "year", ()), ("year_by_month", "year", ("month",)),
                  ("month_by_all", "month", ()), ("month_by_year", "month", ("year",)),
                  ("weekday_by_all", "weekday", ()), ("weekday_by_year", "weekday", ("year",)),
                  ("season_by_year", "season", ("year",))]

_TIME = ["year", "month", "season", "weekday"]
_LEVELS = {"city": ["city", "state", *_TIME], "state": ["state", *_TIME], "time": _TIME}
_MERGE = {"n": F.sum, "s": F.sum, "lo": F.min, "hi": F.max}
ROWS_A_TASK = 150_000     # readings that a task has by station, about as many cells for each of the six shapes
MOST = 1 << 20            # rows a task holds at most


def dated(readings: DataFrame) -> DataFrame:
    """The readings with the columns that cells are made by, their values exact."""
    month = F.month("ts")
    season = F.lit(None).cast("string")
    for name, months in SEASONS.items():
        season = F.when(month.isin(*months), name).otherwise(season)
    place = [c for c in ("station", "city", "state") if c in readings.columns]
    exact = readings.select(*place, F.year("ts").alias("year"), month.alias("month"), season.alias("season"),
                            F.dayofweek("ts").alias("weekday"), *[F.col(p).cast(EXACT).alias(f"{p}_x") for p in POLLUTANTS])
    # rounded once: the least and greatest of these are those of the exact values
    return exact.select("*", *[F.col(f"{p}_x").cast("double").alias(f"{p}_d") for p in POLLUTANTS])


def cells(rows: DataFrame, keys: list) -> DataFrame:
    """Partials of every combination of the keys, from dated readings."""
    return rows.groupBy(*keys).agg(*[c for p in POLLUTANTS for c in (
        F.count(f"{p}_x").alias(f"{p}_n"), F.sum(f"{p}_x").alias(f"{p}_s"),
        F.min(f"{p}_d").alias(f"{p}_lo"), F.max(f"{p}_d").alias(f"{p}_hi"))])


def merged(cells: DataFrame, keys: list) -> DataFrame:
    """Coarser cells from finer ones."""
    return cells.groupBy(*keys).agg(*[f(f"{p}_{k}").alias(f"{p}_{k}") for p in POLLUTANTS for k, f in _MERGE.items()])


def _text(names) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names]) if names else F.lit("")


_YEAR0 = 300_000          # added to a year; 0 is none
_BITS = {"year": 16, "month": 12, "season": 8, "weekday": 4}     # where each is in a scope's number, the shape above


def _numbered(i: int, scope: tuple[str, ...]) -> Column:
    """The number of the variant of station shape ``i`` that a reading is in."""
    season = F.coalesce(F.array_position(F.array(*map(F.lit, SEASONS)), F.col("season")), F.lit(0))
    of = {"year": F.coalesce(F.col("year") + _YEAR0, F.lit(0)), "month": F.coalesce("month", F.lit(0)),
          "season": season, "weekday": F.coalesce("weekday", F.lit(0))}
    return reduce(lambda n, c: n + F.shiftleft(of[c].cast("long"), _BITS[c]), scope, F.lit(i << 40).cast("long"))


def _named(v: DataFrame) -> DataFrame:
    """``v`` with shape and scope for the number ``k``."""
    part = {c: F.shiftright("k", n).bitwiseAND(0xFFFFF if c == "year" else 0xF) for c, n in _BITS.items()}
    season = F.get(F.array(F.lit(None).cast("string"), *map(F.lit, SEASONS)), part["season"].cast("int"))
    of = {c: F.when(x > 0, x - _YEAR0 if c == "year" else x) for c, x in part.items()} | {"season": season}
    v = v.select("*", *[of[c].alias(c) for c in _TIME])
    shape, scope = F.lit(None).cast("string"), F.lit("")
    for i, (name, _, names) in enumerate(SHAPES["station"]):
        here = F.shiftright("k", 40) == i
        shape, scope = F.when(here, name).otherwise(shape), F.when(here, _text(names)).otherwise(scope)
    return v.select(shape.alias("shape"), scope.alias("scope"), "pollutant", "stat", "value", "label")


def station_variants(readings: DataFrame, tasks: int) -> DataFrame:
    """(k, label) with the partials of the station shapes: the only shuffle deals the readings by station."""
    rows = dated(readings.where(F.col("station").isNotNull()).select("station", "ts", *POLLUTANTS)
                 .repartition(tasks, "station"))
    k = F.explode(F.array(*[_numbered(i, scope) for i, (_, _, scope) in enumerate(SHAPES["station"])]))
    return (cells(rows.select("station", *[f"{p}_{x}" for p in POLLUTANTS for x in "xd"], k.alias("k")), ["station", "k"])
            .withColumn("label", F.col("station").cast("string")).drop("station"))


def variants(readings: DataFrame) -> DataFrame:
    """(shape, scope, label) with the merged partials of the other levels: one row per label of every variant."""
    parts, out = None, []
    for level, keys in _LEVELS.items():
        parts = cells(dated(readings.drop("station")), keys) if parts is None else merged(parts, keys)
        rows = F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), _text(scope).alias("scope"),
                                            F.col(label).cast("string").alias("label"))
                                   for n, label, scope in SHAPES[level]]))
        v = parts.withColumn("v", rows).select("v.*", *[c for c in parts.columns if "_" in c])
        out.append(merged(v.where(F.col("label").isNotNull()), ["shape", "scope", "label"]))
    return reduce(DataFrame.unionByName, out)


_RANKED = [(p, s) for p in POLLUTANTS for s in STATS]


def _rank(label: pa.Array) -> np.ndarray:
    return pc.rank(label, sort_keys="ascending", tiebreaker="dense").to_numpy()


def _sorted_ends(g: np.ndarray, x: np.ndarray, rank: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of the places at both ends of each group, in order; where each group begins in them)."""
    order = np.lexsort((rank, x, g))
    start = np.r_[0, np.flatnonzero(np.diff(g[order])) + 1]
    size = np.diff(np.r_[start, len(order)])
    at = np.arange(len(order)) - np.repeat(start, size)
    order = order[(at < places) | (at >= np.repeat(size, size) - places)]
    return order, np.r_[0, np.flatnonzero(np.diff(g[order])) + 1]


def _both_ends(places: int):
    """Of the labels of each variant ``k`` in a task those at both ends of every statistic.

    Once a group has enough, a value beyond its last place at both ends is passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict = {}
        low, high = np.empty((len(_RANKED), 0)), np.empty((len(_RANKED), 0))
        first = True
        held: list[list] = [[] for _ in _RANKED]     # (group, value, label) of each statistic

        def limited(j: int) -> None:
            g, x = (np.concatenate([h[k] for h in held[j]]) for k in (0, 1))
            label = pa.concat_arrays([h[2] for h in held[j]])
            keep, start = _sorted_ends(g, x, _rank(label), places)
            g, x = g[keep], x[keep]
            held[j] = [(g, x, label.take(pa.array(keep)))]
            enough = np.diff(np.r_[start, len(g)]) >= places
            low[j, g[start[enough]]] = x[start[enough] + places - 1]
            last = np.r_[start[1:], len(g)][enough]
            high[j, g[start[enough]]] = x[last - places]

        def told() -> Iterator[pa.RecordBatch]:
            names = np.array(list(ids))
            for j, (p, s) in enumerate(_RANKED):
                if held[j]:
                    limited(j)
                    g, x, label = held[j][0]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[g].tolist()), pa.array([p] * len(g), pa.string()),
                         pa.array([s] * len(g), pa.string()), pa.array(x, mask=np.isinf(x)), label],
                        names=["k", "pollutant", "stat", "value", "label"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("k").dictionary_encode()
            g = np.array([ids.setdefault(k, len(ids)) for k in key.dictionary.to_pylist()])[key.indices.to_numpy()]
            new = len(ids) - low.shape[1]
            low = np.concatenate([low, np.full((len(_RANKED), new), np.inf)], axis=1)
            high = np.concatenate([high, np.full((len(_RANKED), new), -np.inf)], axis=1)
            label = batch.column("label")
            rank = _rank(label)
            for j, (p, s) in enumerate(_RANKED):
                # one without a value comes last
                x = pc.fill_null(batch.column(f"{p}_{s}"), np.inf).to_numpy()
                at = np.flatnonzero((x <= low[j, g]) | (x >= high[j, g]))
                if not len(at):
                    continue
                at = at[_sorted_ends(g[at], x[at], rank[at], places)[0]]
                held[j].append((g[at], x[at], label.take(pa.array(at))))
                if first or len(held[j]) > 8:
                    limited(j)
            first = False
            if sum(len(h[0]) for hs in held for h in hs) > MOST:
                yield from told()
                held = [[] for _ in _RANKED]
        yield from told()
    return run


def answers(readings: DataFrame, places: int = PLACES, tasks: int | None = None) -> DataFrame:
    """shape, scope, pollutant, stat, pos, answer, value: the labels at both ends of every variant.

    Labels are ordered by the value, then by name; one without a reading has no mean, greatest or least value and comes last.
    """
    def stat(p, s):
        n = F.col(f"{p}_n")
        return {"mean": F.when(n > 0, F.col(f"{p}_s").cast("double") / n), "max": F.col(f"{p}_hi"),
                "min": F.col(f"{p}_lo"), "n": n}[s].cast("double").alias(f"{p}_{s}")

    tasks = tasks or tasks_for(readings, ROWS_A_TASK)
    key = ["shape", "scope", "pollutant", "stat"]

    def ends(v, kind):
        return v.select("k", "label", *[stat(p, s) for p, s in _RANKED]).mapInArrow(
            _both_ends(places), f"k {kind}, pollutant string, stat string, value double, label string")

    stations = _named(ends(station_variants(readings, tasks), "long"))
    # a shape's name has no bar
    others = ends(variants(readings).withColumn("k", F.concat("shape", F.lit("|"), "scope")), "string")
    others = others.withColumn("shape", F.substring_index("k", "|", 1)).withColumn(
        "scope", F.substr("k", F.length("shape") + 2)).drop("k")
    few = stations.unionByName(others)
    # of each variant 2 * places a task, each label once
    ranked = F.sort_array(F.collect_set(F.struct(F.col("value").isNull().alias("none"), "value", "label")))
    n = F.size("a")
    up = F.transform(F.slice("a", 1, places), lambda x, i: F.struct(i.alias("pos"), x.alias("x")))
    down = F.transform(F.slice(F.reverse("a"), 1, places), lambda x, i: F.struct((-1 - i).alias("pos"), x.alias("x")))
    return (few.groupBy(*key).agg(ranked.alias("a")).where(n > 0)
            .select(*key, F.explode(F.concat(up, down)).alias("r"))
            .select(*key, F.col("r.pos").cast("int").alias("pos"), F.col("r.x.label").alias("answer"),
                    F.col("r.x.value").alias("value")))


def v1(t):
    """All variants of 27 shapes of the catalog."""
    return answers(t.readings)


def _shape_sql(name: str, label: str, scope: tuple[str, ...]) -> str:
    text = " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in scope) or "''"
    cols = ", ".join(f"count({p}) as {p}_n, sum({p}) as {p}_s, min({p}) as {p}_lo, max({p}) as {p}_hi"
                     for p in POLLUTANTS)
    return (f"select '{name}' as shape, {text} as scope, cast({label} as varchar) as label, {cols} "
            f"from x where {label} is not null group by all")


def v1_sql() -> str:
    season = " ".join(f"when month(ts) in ({', '.join(map(str, m))}) then '{s}'" for s, m in SEASONS.items())
    shapes = " union all ".join(_shape_sql(*s) for level in SHAPES.values() for s in level)
    stats = {"mean": "case when {0}_n > 0 then cast({0}_s as double) / {0}_n end",
             "max": "cast({0}_hi as double)", "min": "cast({0}_lo as double)",
             "n": "cast({0}_n as double)"}
    flat = " union all ".join(
        f"select shape, scope, label, '{p}' as pollutant, '{s}' as stat, {stats[s].format(p)} as value from v"
        for p in POLLUTANTS for s in STATS)
    over = "row_number() over (partition by shape, scope, pollutant, stat order by value"
    return f"""
, x as (select *, year(ts) as year, month(ts) as month, case {season} end as season,
               dayofweek(ts) + 1 as weekday
      from (select ts, station, city, state, {", ".join(f"cast({p} as {EXACT}) as {p}" for p in POLLUTANTS)}
            from readings) y),
v as ({shapes}),
f as ({flat}),
r as (select *, {over} asc nulls last, label asc) as up, {over} desc nulls first, label desc) as down from f)
select shape, scope, pollutant, stat, cast(up - 1 as integer) as pos, label as answer, value from r where up <= {PLACES}
union all
select shape, scope, pollutant, stat, cast(-down as integer) as pos, label as answer, value from r where down <= {PLACES}
"""


def cube(readings: DataFrame) -> DataFrame:
    """Every grouping set of state, city, year and pollutant, from one table of partials.

    The sets are made of the finest partials, one row per state, city, year and
    pollutant, so what is copied per set does not grow with the readings of a cell,
    and a task holds as many cells as there are, whatever the number of stations.
    """
    parts = cells(dated(readings.drop("station")), ["state", "city", "year"])
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("pollutant"), F.col(f"{p}_n").alias("n"),
                                        F.col(f"{p}_s").alias("s"), F.col(f"{p}_hi").alias("hi"))
                               for p in POLLUTANTS]))
    return (parts.select("state", "city", "year", long.alias("l")).select("state", "city", "year", "l.*")
            .cube("state", "city", "year", "pollutant")
            .agg(F.grouping_id().cast("bigint").alias("gid"), F.sum("n").alias("n"), F.sum("s").alias("s"),
                 F.max("hi").alias("hi")))


def v2(t):
    c = cube(t.readings)
    return c.select("state", "city", "year", "pollutant", "gid", F.col("n").cast("bigint").alias("n"),
                    F.when(F.col("n") > 0, F.col("s").cast("double") / F.col("n")).alias("mean"),
                    F.col("hi").cast("double").alias("max"))


V2_SQL = f"""
select state, city, year, pollutant, cast(grouping(state, city, year, pollutant) as bigint) as gid,
       count(v) as n, case when count(v) > 0 then cast(sum(v) as double) / count(v) end as mean,
       cast(max(v) as double) as max
from (select state, city, cast(year(ts) as integer) as year, 'pm25' as pollutant, cast(pm25 as {EXACT}) as v
      from readings
      union all select state, city, cast(year(ts) as integer), 'pm10', cast(pm10 as {EXACT}) from readings) x
group by cube (state, city, year, pollutant)
"""


def registry():
    from airlens.plans.registry import Entry
    return {"V1": Entry(v1, v1_sql(), ("readings",)), "V2": Entry(v2, V2_SQL, ("readings",))}
