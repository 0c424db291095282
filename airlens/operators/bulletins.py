"""Bulletin ETL (B1-B19): daily bulletin tables -> clean city-day table.

Input: ``cells`` -- one row per extracted page table:
``(date string 'yyyy-MM-dd', page int, cells array<array<string>>)``; row 0 of
``cells`` is the header. Plan:

1. B1 route each table by its header signature (``to_json(cells[0])``) with a
   join to a small header dimension (broadcast, a literal of 19 rows);
2. B2-B7 parse every row of a table with array higher-order functions, the
   look-ahead to the next row included -- all row-local, no shuffle;
3. B9 a table with any bad row is dropped whole (quarantined with a reason);
4. B8 + B12 + B16 one aggregation per (date, raw city) keeps the last row of a
   table, then one per (date, canonical city) keeps the first by (page,
   position) -- two small shuffles on the date-city key;
5. B13/B14 drop the ambiguous city; city -> state lookup is a join against a
   dimension table, unmatched cities are quarantined instead of failing;
6. B17 densify: per city, the spine of bulletin dates (bounded by calendar
   days) is exploded and left-joined to the observations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.plans.registry import Entry
from airlens.sources.tables import ROWS_A_TASK, tasks_for

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's): header rows of each layout,
# legend headers, the city alias map and the excluded ambiguous city.
# ---------------------------------------------------------------------------
LAYOUT_1_HEADERS = [
    ["City", "Air Quality", None, None, "Index Value", "Prominent\nPollutant"],
]
LAYOUT_2_HEADERS = [
    ["City", "Air Quality", None, None, "Index Value", "Prominent\nPollutant",
     "Based on number of\nmonitoring stations"],
    ["City", "Air Quality", None, None, "Index Value", None, None, "Prominent\nPollutant",
     "Based on\nnumber of\nstations"],
    ["City", "Air Quality", None, None, "Index Value", "Prominent\nPollutant",
     "Based on\nnumber of\nmonitoring\nstations"],
    ["City", "Air Quality", None, None, None, None, "Index Value", None, None,
     "Prominent\nPollutant", "Based on number of\nstations"],
    ["City", "Air Quality", None, None, None, None, "Index Value", "Prominent\nPollutant",
     "Based on\nnumber of\nmonitoring\nstations"],
    ["City", "Air Quality", None, None, "Index\nValue", "Prominent\nPollutant",
     "Based on number of\nmonitoring stations"],
    ["City", "Air Quality", None, None, None, None, "Index Value", "Prominent\nPollutant",
     "Based on\nnumber of\nstations"],
]
LAYOUT_3_HEADERS = [
    ["City", "Air Quality", "Index Value", "Prominent\nPollutant",
     "Based on number of\nmonitoring stations"],
]
LAYOUT_4_HEADERS = [
    ["S.No", "City", "Air Quality", "Index Value", "Prominent Polluta\nnt",
     "Based on number\nof monitoring\nstations"],
    ["S.No", "City", "Air Quality", "Index Value", "Prominent Pollutant",
     "Based on Number\nof Monitoring\nStations"],
    ["S.No", "City", "Air Quality", "Index\nValue", "Prominent Pollutant",
     "No. of Stations\nParticipated/\nTotal Stations"],
]
LEGEND_HEADERS = [
    ["Good", "Minimal impact"],
    ["Good", "Minimal Impact"],
    ["AQI", "Category", "Color Code", "Possible Health Impacts"],
]
CITY_ALIASES = {
    "Amaravati": "Amravati",
    "Asanol": "Asansol",
    "Greater Noida": "Greater_Noida",
    "GandhiNagar": "Gandhinagar",
    "Gurgaon": "Gurugram",
    "Coimbatore": "Coimbtore",
    "Kalaburagi": "Kalaburgi",
    "Kurukshetra": "Kurushketra",
    "Loni_Dehat": "Loni_Ghaziabad",
    "Madikeri": "Medikeri",
    "Manglore": "Mangalore",
    "Pimpri Chinchwad": "Pimpri-Chinchwad",
    "Tumakuru": "Tumidih",
    "Tirumala": "Tirupati",
    "Tiruppur": "Tirupur",
    "Yamuna Nagar": "Yamunanagar",
    "vellore": "Vellore",
}
EXCLUDED_CITIES = ("Aurangabad",)

CELLS_SCHEMA = "date string, page int, cells array<array<string>>"


# ---------------------------------------------------------------------------
# B1: layout router
# ---------------------------------------------------------------------------

def header_dimension(spark) -> DataFrame:
    """Header signature -> layout (0 = legend table, skipped)."""
    rows = []
    for layout, headers in ((1, LAYOUT_1_HEADERS), (2, LAYOUT_2_HEADERS),
                            (3, LAYOUT_3_HEADERS), (4, LAYOUT_4_HEADERS), (0, LEGEND_HEADERS)):
        rows += [(h, layout) for h in headers]
    df = spark.createDataFrame(rows, "header array<string>, layout int")
    return df.select(F.to_json("header").alias("signature"), "layout").dropDuplicates(["signature"])


def route(cells: DataFrame) -> DataFrame:
    """Attach ``layout`` (NULL for an unknown header)."""
    dim = header_dimension(cells.sparkSession)
    sig = cells.withColumn("signature", F.to_json(F.get(F.col("cells"), 0)))
    return sig.join(F.broadcast(dim), "signature", "left").drop("signature")


# ---------------------------------------------------------------------------
# Per-layout row parsing (row-local array code)
# ---------------------------------------------------------------------------

def _valid(x: Column) -> Column:
    """A cell is valid when not NULL and not ''."""
    return x.isNotNull() & (x != "")


_INT = r"^\s*[+-]?\d+\s*$"


def _as_int(x: Column) -> Column:
    return F.when(x.rlike(_INT), F.trim(x).cast("int"))


def _cells_of(body: Column) -> Column:
    """Stage 1: per body row, its cells 0-6, its width, and the look-ahead
    row's cells 0 and 2 -- plain array accesses, computed once."""
    n = F.size(body)

    def one(row, i):
        nxt = F.get(body, i + 1)
        return F.struct(*[F.get(row, k).alias(f"c{k}") for k in range(7)],
                        F.size(row).alias("width"), (i + 1 < n).alias("has_next"),
                        F.get(nxt, 0).alias("n0"), F.get(nxt, 2).alias("n2"),
                        F.size(nxt).alias("nwidth"), i.alias("pos"))
    return F.transform(body, one)


def _layout_record(layout: int):
    """Stage 2: the record of one body row for one layout.

    Record: (first, ok, suspect, key, aqi, pollutant, quality, stations, pos).
    ``ok`` = false marks a row the reference fails on (bad AQI, short row,
    missing look-ahead row); such a row fails its whole table (B9).
    """
    def rec(x):
        first = _valid(x["c0"])
        nxt_cont = x["has_next"] & ~_valid(x["n0"])
        # look-ahead quality: the next row's cell 2 when it continues this
        # city; when it starts another city the reference stores a dict
        # there -- we keep NULL and flag the row (deviation D6).
        la_quality = F.when(nxt_cont, x["n2"])
        la_ok = x["has_next"] & (~nxt_cont | (x["nwidth"] > 2))
        la_suspect = x["has_next"] & ~nxt_cont
        null_s = F.lit(None).cast("string")
        if layout == 1:
            key, aqi_txt, pol, q, st, min_len, need_la = (
                x["c0"], x["c4"], x["c5"], null_s, null_s, 6, F.lit(True))
        elif layout == 2:
            key, aqi_txt, pol, q, st, min_len, need_la = (
                x["c0"], x["c4"], x["c5"], x["c1"], x["c6"], 7, ~_valid(x["c1"]))
        elif layout == 3:
            key, aqi_txt, pol, q, st, min_len, need_la = (
                x["c0"], x["c2"], x["c3"], x["c1"], x["c4"], 5, ~_valid(x["c1"]))
        else:
            key, aqi_txt, pol, q, st, min_len, need_la = (
                x["c1"], F.split_part(x["c3"], F.lit("\n"), F.lit(1)), x["c4"], x["c2"], x["c5"],
                6, F.lit(False))
        aqi = _as_int(aqi_txt)
        ok = (x["width"] >= min_len) & aqi.isNotNull() & key.isNotNull()
        ok = ok & F.when(need_la, la_ok).otherwise(F.lit(True))
        return F.struct(first.alias("first"), F.when(first, ok).otherwise(F.lit(True)).alias("ok"),
                        (need_la & la_suspect).alias("suspect"), key.alias("key"),
                        aqi.alias("aqi"), pol.alias("pollutant"),
                        F.when(need_la, la_quality).otherwise(q).alias("quality"),
                        st.alias("stations"), x["pos"].alias("pos"))
    return rec


def parse_tables(cells: DataFrame) -> DataFrame:
    """Route and parse each table; one row per table with its records
    (first lines only), ``status`` = ok / legend / unknown_header / bad_row."""
    r = route(cells)
    body = F.when(F.size("cells") > 1, F.slice("cells", 2, F.size("cells") - 1)) \
        .otherwise(F.array().cast("array<array<string>>"))
    # Stage 1 is projected as a column of its own; stage 2 picks one small
    # lambda per table (CASE is lazy, only the table's layout runs).
    r = r.select("date", "page", "layout", _cells_of(body).alias("rows"))
    lay = F.col("layout")
    recs = F.when(lay == 1, F.transform("rows", _layout_record(1))) \
        .when(lay == 2, F.transform("rows", _layout_record(2))) \
        .when(lay == 3, F.transform("rows", _layout_record(3))) \
        .when(lay == 4, F.transform("rows", _layout_record(4)))
    status = (F.when(lay.isNull(), "unknown_header")
              .when(lay == 0, "legend")
              .when(F.forall("recs", lambda x: x["ok"]), "ok")
              .otherwise("bad_row"))
    r = r.select("date", "page", "layout", recs.alias("recs"))
    return r.select("date", "page", "layout", status.alias("status"),
                    F.filter("recs", lambda x: x["first"]).alias("records"))


def quarantine(cells: DataFrame) -> DataFrame:
    """Tables dropped whole, with the reason."""
    p = parse_tables(cells)
    return p.where(F.col("status").isin("unknown_header", "bad_row")).select(
        "date", "page", "layout", "status")


def _exploded(parsed: DataFrame, recs: Column) -> DataFrame:
    """One row per record ``r`` of the good tables. The status is tested inside
    the generator: a filter on it would be pushed below the projection that
    parses, and every table would be parsed twice."""
    ok = F.when(F.col("status") == "ok", recs)
    return (parsed.select("date", "page", "layout", F.explode_outer(ok).alias("r"))
            .where(F.col("r").isNotNull()))


def records(cells: DataFrame) -> DataFrame:
    """Records of the good tables, one row each, with their date, page
    and position (the order the reference concatenates them in)."""
    e = _exploded(parse_tables(cells), F.col("records"))
    return e.select("date", "page", "layout", F.col("r.pos").alias("pos"),
                    F.col("r.key").alias("city_raw"), F.col("r.aqi").alias("aqi"),
                    F.col("r.pollutant").alias("pollutant"), F.col("r.quality").alias("quality"),
                    F.col("r.stations").alias("stations"), F.col("r.suspect").alias("suspect"))


def last_per_table_records(cells: DataFrame) -> DataFrame:
    """B8 + B10: per table, one record per raw city: the values of its last
    row, at the position of its first row (dict ``update`` semantics).
    Row-local: a page table is a short array, so its records are sorted by
    city and position inside it, and each is held against its neighbour only
    -- no shuffle, and no search of the whole page for every record."""
    ordered = F.array_sort(F.transform("records", lambda x, i: F.struct(
        x["key"].alias("key"), i.alias("i"), x.alias("rec"))))
    none = F.slice(F.array(F.lit(None).cast("string")), 1, 1)
    keys = F.transform("ordered", lambda x: x["key"])
    # the key one place before and after: a shifted copy, so the arrays meet by place
    n = F.size("records")
    before = F.concat(none, F.slice("keys", 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice("keys", 2, F.greatest(n - 1, F.lit(0))), none)
    mark = lambda shifted: F.filter(F.zip_with("ordered", F.slice(shifted, 1, n), lambda x, k: F.struct(
        x.alias("x"), (x["key"] != k).alias("differs"))), lambda z: F.coalesce(z["differs"], F.lit(True)))
    kept = F.zip_with(mark(before), mark(after),
                      lambda first, last: last["x"]["rec"].withField("pos", first["x"]["i"]))
    # columns of their own, so a page is sorted once
    parsed = parse_tables(cells).withColumn("ordered", ordered).withColumn("keys", keys)
    e = _exploded(parsed, kept)
    return e.select("date", "page", "layout", F.col("r.pos").alias("pos"),
                    F.col("r.key").alias("city_raw"), F.col("r.aqi").alias("aqi"),
                    F.col("r.pollutant").alias("pollutant"), F.col("r.quality").alias("quality"),
                    F.col("r.stations").alias("stations"), F.col("r.suspect").alias("suspect"))


# ---------------------------------------------------------------------------
# Canonicalisation, lookup, dedup, densify
# ---------------------------------------------------------------------------

def alias_table(spark) -> DataFrame:
    return spark.createDataFrame(list(CITY_ALIASES.items()), "raw string, canonical string")


def canonical_city(raw: Column) -> Column:
    """B12 (string part): strip surrounding whitespace and drop newlines."""
    return F.replace(F.regexp_replace(raw, r"^\s+|\s+$", ""), F.lit("\n"), F.lit(""))


def parse_stations(x: Column) -> Column:
    """The integer before '/', '#' or a newline ("12/15" -> 12)."""
    m = F.regexp_extract(x, r"^\s*([+-]?\d+)\s*(?:[/#\n][\s\S]*)?$", 1)
    return F.when(m != "", m.cast("int"))


def city_rows(cells: DataFrame) -> DataFrame:
    """Records under their canonical city and date.
    Row-local but for the literal alias table, so valid on a stream's batches."""
    spark = cells.sparkSession
    recs = last_per_table_records(cells)
    stripped = recs.withColumn("city0", canonical_city(F.col("city_raw")))
    al = alias_table(spark)
    c = (stripped.join(F.broadcast(al), stripped.city0 == al.raw, "left")
         .withColumn("city", F.coalesce("canonical", "city0")).drop("raw", "canonical", "city0"))
    c = c.where(~F.col("city").isin(*EXCLUDED_CITIES))                      # B13
    return c.withColumn("date", F.to_date("date"))                           # B15


def first_of_day(rows: DataFrame) -> DataFrame:
    """The first row, by (page, position), of each (date, city). Associative:
    the first of the firsts of parts is the first of all."""
    at = F.struct("page", "pos")
    g = rows.groupBy("date", "city").agg(F.min(at).alias("at"), F.min_by(
        F.struct("aqi", "pollutant", "quality", "stations", "suspect"), at).alias("v"))
    return g.select("date", "city", "at.*", "v.*")


def with_state(first: DataFrame, city_states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their state and station count, cities without a state)."""
    j = first.join(city_states.select("city", "state"), "city", "left")     # B14
    good = j.where(F.col("state").isNotNull()).select(
        "date", "city", "state", "aqi", "pollutant", "quality",
        parse_stations(F.col("stations")).alias("n_stations"), "suspect")
    bad = j.where(F.col("state").isNull()).select("date", "city")
    return good, bad


def city_day(cells: DataFrame, city_states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The clean city-day table and the unmatched-city quarantine.

    ``city_states``: (city, state) lookup, a dimension table.
    """
    return with_state(first_of_day(city_rows(cells)), city_states)


def densify(cd: DataFrame) -> DataFrame:
    """Full (bulletin date x city) grid, missing observations NULL.

    The date spine holds the distinct bulletin dates (bounded by calendar
    days in the span, not by data volume); each city row explodes it.
    """
    # cut the lineage once: the table is used three times below
    cd = cd.checkpoint(eager=True)
    spine = cd.select(F.array_sort(F.collect_set("date")).alias("dates")).scalar()
    cities = cd.select("city").distinct()
    grid = cities.select("city", F.explode(spine).alias("date"))
    return grid.join(cd, ["date", "city"], "left")


def pending_dates(spine: DataFrame, done: DataFrame) -> DataFrame:
    """Spine dates without output (anti-join)."""
    return spine.join(done.select("date").distinct(), "date", "left_anti")


# ---------------------------------------------------------------------------
# Bulletins derived from the readings (the registered end-to-end inputs)
# ---------------------------------------------------------------------------

PAGE_ROWS = 20
EPOCH = "1995-01-01"


def source_city_days(t, every: int = 1) -> DataFrame:
    """City-day aggregates the bulletins report (from readings), of every so many days from ``EPOCH``."""
    # dealt by the key before the stations are counted: a scan's task may have tens of millions
    # of readings, nearly as many (day, city, station), and would hold them all
    readings = t.readings
    if every > 1:
        # of the readings, as no condition on the day gets past the window below
        readings = readings.where(F.datediff(F.to_date("ts"), F.lit(EPOCH)) % every == 0)
    r = readings.select(F.to_date("ts").alias("d"), "city", "state", "station", "pm25", "pm10")
    g = r.repartition(tasks_for(t.readings, ROWS_A_TASK * every), "d", "city").groupBy("d", "city").agg(
        F.max("state").alias("state"), F.avg("pm25").alias("a25"), F.avg("pm10").alias("a10"),
        F.count_distinct("station").alias("n_st"))
    aqi = F.round(F.greatest(F.coalesce(F.col("a25") * 4, F.lit(0.0)),
                             F.coalesce(F.col("a10"), F.lit(0.0)))).cast("int")
    w = Window.partitionBy("d").orderBy("city")   # one bulletin: the cities of one day
    g = g.select("d", "city", "state", "n_st", aqi.alias("aqi"),
                 F.when(F.col("a25") * 2 >= F.col("a10"), "PM2.5").otherwise("PM10").alias("pollutant"),
                 F.datediff("d", F.lit(EPOCH)).alias("dn"),
                 (F.row_number().over(w) - 1).alias("r"))
    q = F.col("aqi")
    quality = (F.when(q <= 50, "Good").when(q <= 100, "Satisfactory").when(q <= 200, "Moderate")
               .when(q <= 300, "Poor").when(q <= 400, "Very Poor").otherwise("Severe"))
    return g.withColumn("quality", quality).withColumn(
        "layout", (F.col("dn") % 4 + 1).cast("int")).withColumn(
        "page", (F.floor(F.col("r") / PAGE_ROWS) + 1).cast("int")).withColumn(
        "bad", (F.col("dn") % 13 == 0) & (F.col("r") == 0))


def build_cells(t) -> DataFrame:
    """Bulletin page tables in the four layouts (plus a legend page per day)
    generated from ``source_city_days``: continuation rows, blank quality
    cells, padded city names and station fractions included; on every 13th
    day the first row of page 1 carries a non-integer AQI."""
    s = source_city_days(t)
    nl = "\n"
    city = F.when(F.col("r") % 5 == 0, F.concat(F.lit(" "), F.col("city"), F.lit(nl))) \
        .otherwise(F.col("city"))
    aqi = F.when(F.col("bad"), F.lit("NA")).otherwise(F.col("aqi").cast("string"))
    st = F.col("n_st").cast("string")
    N = F.lit(None).cast("string")
    E = F.lit("")

    def arr(*xs):
        return F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs])

    odd = F.col("r") % 2 == 1
    rows = (
        F.when(F.col("layout") == 1, F.array(arr(city, E, N, N, aqi, F.col("pollutant")),
                                              arr(N, N, F.col("quality"), N, N, N)))
        .when((F.col("layout") == 2) & odd, F.array(arr(city, E, N, N, aqi, F.col("pollutant"), st),
                                                    arr(N, N, F.col("quality"), N, N, N, N)))
        .when(F.col("layout") == 2, F.array(arr(city, F.col("quality"), N, N, aqi,
                                                F.col("pollutant"), st)))
        .when(F.col("layout") == 3, F.array(arr(city, F.col("quality"), aqi, F.col("pollutant"), st)))
        .otherwise(F.array(arr((F.col("r") + 1).cast("string"), city, F.col("quality"),
                               F.concat(aqi, F.lit(nl + "(PM)")), F.col("pollutant"),
                               F.concat(st, F.lit("/"), (F.col("n_st") + 1).cast("string"))),
                           arr(N, N, E, N, N, N))))
    per_row = s.select(F.col("d").cast("string").alias("date"), "page", "layout", "r",
                       rows.alias("rows"))
    # one page = at most PAGE_ROWS cities: the collected group is bounded
    pages = per_row.groupBy("date", "page", "layout").agg(
        F.array_sort(F.collect_list(F.struct("r", "rows"))).alias("rr"))
    headers = F.array(*[F.array(*[F.lit(h).cast("string") for h in hdr]) for hdr in (
        LAYOUT_1_HEADERS[0], LAYOUT_2_HEADERS[0], LAYOUT_3_HEADERS[0], LAYOUT_4_HEADERS[1])])
    header = F.get(headers, F.col("layout") - 1)
    tables = pages.select("date", "page", F.concat(F.array(header), F.flatten(
        F.transform("rr", lambda x: x["rows"]))).alias("cells"))
    # the legend page of each day: one per date, from the day's first row
    # (same lineage as the pages, so the planner reuses its exchange)
    legend = per_row.where(F.col("r") == 0).select(
        "date", F.lit(0).alias("page"),
        F.array(F.array(*[F.lit(h) for h in LEGEND_HEADERS[2]]),
                F.array(F.lit("0-50"), F.lit("Good"), F.lit("green"), F.lit("Minimal Impact"))
                ).alias("cells"))
    return tables.unionByName(legend).repartitionByRange("date").sortWithinPartitions("date", "page")


def derived_cells(t) -> DataFrame:
    """The stored bulletin page tables of this snapshot (see ``build_cells``)."""
    return t.bulletin_cells


def _city_states(t) -> DataFrame:
    return t.city_states


def b1(t):
    """B1: tables routed to each layout (0 = legend)."""
    return route(derived_cells(t)).groupBy("layout").agg(F.count(F.lit(1)).alias("n_tables"))


def b9(t):
    """Tables dropped whole and why."""
    return quarantine(derived_cells(t))


def b10(t):
    """The clean city-day table."""
    good, _ = city_day(derived_cells(t), _city_states(t))
    return good.select("date", "city", "state", "aqi", "pollutant", "quality", "n_stations")


def b11(t):
    """Days of the calendar span with no usable bulletin rows."""
    good, _ = city_day(derived_cells(t), _city_states(t))
    r = t.readings
    bounds = r.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    spine = bounds.select(F.explode(F.sequence("a", "b")).alias("date"))
    return pending_dates(spine, good)


def b14(t):
    """Cities without a state in the lookup (quarantine)."""
    lookup = _city_states(t).where(~F.col("city").endswith("/MACHINERY"))
    _, bad = city_day(derived_cells(t), lookup)
    return bad.groupBy("city").agg(F.count(F.lit(1)).alias("n_days"))


def b17(t):
    """Densified grid size and filled cells per city."""
    good, _ = city_day(derived_cells(t), _city_states(t))
    d = densify(good.select("date", "city", "aqi"))
    return d.groupBy("city").agg(F.count(F.lit(1)).alias("n_dates"),
                                 F.count("aqi").alias("n_observed"))


def b19(t):
    """Rows per state of the city-day table, with the sorted list of its cities
    (a dimension: one entry per city)."""
    good, _ = city_day(derived_cells(t), _city_states(t))
    per_city = good.groupBy("state", "city").agg(F.count(F.lit(1)).alias("n"))
    return per_city.groupBy("state").agg(
        F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list("city")), ",").alias("cities"))


# --- oracle SQL: the expected ETL output computed directly from readings ----

SQL_SOURCE = f"""
select d, city, state, n_st, aqi, pollutant, dn, r,
       case when aqi <= 50 then 'Good' when aqi <= 100 then 'Satisfactory'
            when aqi <= 200 then 'Moderate' when aqi <= 300 then 'Poor'
            when aqi <= 400 then 'Very Poor' else 'Severe' end as quality,
       cast(dn % 4 + 1 as integer) as layout,
       cast(floor(r / {PAGE_ROWS}) + 1 as integer) as page,
       (dn % 13 = 0 and r = 0) as bad
from (select d, city, state, n_st,
             cast(round(greatest(coalesce(a25 * 4, 0.0), coalesce(a10, 0.0))) as integer) as aqi,
             case when a25 * 2 >= a10 then 'PM2.5' else 'PM10' end as pollutant,
             date_diff('day', date '{EPOCH}', d) as dn,
             row_number() over (partition by d order by city) - 1 as r
      from (select cast(ts as date) as d, city, max(state) as state, avg(pm25) as a25,
                   avg(pm10) as a10, count(distinct station) as n_st
            from readings group by cast(ts as date), city) g) s
"""

SQL_GOOD = (f"select d as date, city, state, aqi, pollutant, quality, case when layout = 1 then "
            f"null else cast(n_st as integer) end as n_stations from ({SQL_SOURCE}) s where (d, page) not in "
            f"(select d, page from ({SQL_SOURCE}) b where bad)")

B1_SQL = (f"select layout, count(*) as n_tables from (select distinct d, page, layout from "
          f"({SQL_SOURCE}) s union all select distinct d, 0 as page, 0 as layout from "
          f"({SQL_SOURCE}) s2) t group by layout")
B9_SQL = (f"select cast(d as varchar) as date, page, layout, 'bad_row' as status from "
          f"({SQL_SOURCE}) s where bad")
B10_SQL = SQL_GOOD
B11_SQL = (f"select cast(x.date as date) as date from (select unnest(generate_series("
           f"(select min(cast(ts as date)) from readings), (select max(cast(ts as date)) from readings), "
           f"interval 1 day)) as date) x where cast(x.date as date) not in (select date from ({SQL_GOOD}) g)")
B14_SQL = (f"select city, count(*) as n_days from ({SQL_GOOD}) g where city like '%/MACHINERY' "
           f"group by city")
B17_SQL = (f"select c.city, count(*) as n_dates, count(g.aqi) as n_observed from "
           f"(select distinct city from ({SQL_GOOD}) a) c cross join (select distinct date from "
           f"({SQL_GOOD}) b) dd left join ({SQL_GOOD}) g on g.city = c.city and g.date = dd.date "
           f"group by c.city")
B19_SQL = (f"select state, count(*) as n, array_to_string(list_sort(list(distinct city)), ',') as cities "
           f"from ({SQL_GOOD}) g group by state")


def registry():
    rv = ("readings",)
    return {
        "B1": Entry(b1, B1_SQL, rv),
        "B9": Entry(b9, B9_SQL, rv),
        "B10": Entry(b10, B10_SQL, rv),
        "B11": Entry(b11, B11_SQL, rv),
        "B14": Entry(b14, B14_SQL, rv),
        "B17": Entry(b17, B17_SQL, rv),
        "B19": Entry(b19, B19_SQL, rv),
    } | more_registry() | dup_registry()


# --- per-step queries over the derived bulletins -------------------------------------------

def _layout_records(t, layout: int):
    recs = last_per_table_records(derived_cells(t)).where(F.col("layout") == layout)
    return recs.select(F.to_date("date").alias("date"),
                       canonical_city(F.col("city_raw")).alias("city"), "aqi", "pollutant",
                       "quality", "stations")


def _sql_layout_records(layout: int) -> str:
    stations = {1: "cast(null as varchar)", 2: "cast(n_st as varchar)", 3: "cast(n_st as varchar)",
                4: "cast(n_st as varchar) || '/' || cast(n_st + 1 as varchar)"}[layout]
    return (f"select d as date, city, aqi, pollutant, quality, {stations} as stations from "
            f"({SQL_SOURCE}) s where layout = {layout} and (d, page) not in "
            f"(select d, page from ({SQL_SOURCE}) b where bad)")


def b2(t):
    """B2: layout-1 records (quality from the next row, no station count)."""
    return _layout_records(t, 1)


def b3(t):
    """Layout-2 records (quality in the row or the next one)."""
    return _layout_records(t, 2)


def b4(t):
    """Layout-3 records."""
    return _layout_records(t, 3)


def b5(t):
    """Layout-4 records (AQI before a newline, S.No starts a row)."""
    return _layout_records(t, 4)


def _row_kinds(t):
    p = route(derived_cells(t)).where(F.col("layout") >= 1)
    rows = p.select("layout", F.explode(F.slice("cells", 2, F.size("cells") - 1)).alias("row"))
    first = _valid(F.get(F.col("row"), 0))
    return rows.groupBy("layout").agg(F.sum(first.cast("int")).alias("n_first"),
                                      F.sum((~first).cast("int")).alias("n_continuation"))


def b6(t):
    """Rows whose first cell is valid (a record starts) vs continuation rows."""
    return _row_kinds(t)


def b7(t):
    """The body rows of the good tables, the continuation rows among them and the
    records they give: a continuation row gives none, so the records are the others."""
    good = parse_tables(derived_cells(t)).select(
        "date", "page", "layout", F.when(F.col("status") == "ok", F.col("records")).alias("records"))
    cells = derived_cells(t).select("date", "page", F.slice("cells", 2, F.greatest(
        F.size("cells") - 1, F.lit(0))).alias("body"))
    both = cells.join(good, ["date", "page"]).where(F.col("records").isNotNull())
    continues = F.filter("body", lambda row: ~F.coalesce(_valid(F.get(row, 0)), F.lit(False)))
    starts = F.transform("records", lambda x: x["pos"])
    from_continuation = F.filter(starts, lambda i: ~F.coalesce(_valid(F.get(F.get("body", i), 0)), F.lit(False)))
    return both.groupBy("layout").agg(
        F.sum(F.size("body")).alias("n_rows"), F.sum(F.size(continues)).alias("n_continuation"),
        F.sum(F.size("records")).alias("n_records"),
        F.sum(F.size(from_continuation)).alias("n_from_continuation"))


_SQL_ROW_KINDS = (f"select layout, cast(count(*) as bigint) as n_first, cast(sum(case "
                  f"when layout in (1, 4) then 1 when layout = 2 and r % 2 = 1 then 1 else 0 end) "
                  f"as bigint) as n_continuation from ({SQL_SOURCE}) s group by layout")


B7_SQL = (f"select layout, cast(sum(1 + c) as bigint) as n_rows, cast(sum(c) as bigint) as n_continuation, "
          f"count(*) as n_records, cast(0 as bigint) as n_from_continuation from (select layout, case when "
          f"layout in (1, 4) then 1 when layout = 2 and r % 2 = 1 then 1 else 0 end as c from ({SQL_SOURCE}) s "
          f"where (d, page) not in (select d, page from ({SQL_SOURCE}) b where bad)) x group by layout")


def b12(t):
    """Raw city cells of all pages, late ones included, that needed stripping
    (padding, newlines), those under an alias, and the distinct canonical names."""
    recs = last_per_table_records(_all_cells(t)).select(
        "city_raw", canonical_city(F.col("city_raw")).alias("stripped"))
    al = alias_table(t.spark)
    named = recs.join(F.broadcast(al), recs.stripped == al.raw, "left")
    return named.agg(F.sum((F.col("city_raw") != F.col("stripped")).cast("int")).cast("bigint").alias("n_cleaned"),
                     F.count("canonical").alias("n_aliased"),
                     F.count_distinct(F.coalesce("canonical", "stripped")).alias("n_cities"))


_SQL_KEPT = (f"select city, r from ({SQL_SOURCE}) s where (d, page) not in "
             f"(select d, page from ({SQL_SOURCE}) b where bad)")
# the late page: the day's first three cities, the excluded one and one under an alias
_SQL_LATE_CITIES = (f"select case when x.i = 0 then city else x.name end as city, x.i from ({SQL_SOURCE}) s, "
                    f"(values (0, ''), (1, 'Aurangabad'), (2, 'Gurgaon')) x(i, name) where dn % 17 = 0 and "
                    f"((x.i = 0 and r < 3) or (x.i > 0 and r = 0))")
B12_SQL = (f"select (select cast(sum(case when r % 5 = 0 then 1 else 0 end) as bigint) from ({_SQL_KEPT}) k) as "
           f"n_cleaned, (select count(*) from ({_SQL_LATE_CITIES}) l where i = 2) as n_aliased, "
           f"(select count(distinct case when city = 'Gurgaon' then 'Gurugram' else city end) from "
           f"(select city from ({_SQL_KEPT}) a union all select city from ({_SQL_LATE_CITIES}) b) u) as n_cities")


def b15(t):
    """Bulletin dates cast to DATE, rows per year."""
    good, _ = city_day(derived_cells(t), _city_states(t))
    return good.groupBy(F.year("date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


def b18(t):
    """Station counts parsed from the cells, per layout."""
    recs = last_per_table_records(derived_cells(t))
    return recs.groupBy("layout").agg(F.sum(parse_stations(F.col("stations"))).alias("stations"),
                                      F.count(parse_stations(F.col("stations"))).alias("n_parsed"))


B18_SQL = (f"select layout, case when layout = 1 then null else cast(sum(n_st) as bigint) end as stations, "
           f"case when layout = 1 then 0 else count(*) end as n_parsed from ({SQL_SOURCE}) s "
           f"where (d, page) not in (select d, page from ({SQL_SOURCE}) b where bad) group by layout")


def more_registry():
    rv = ("readings",)
    return {
        "B2": Entry(b2, _sql_layout_records(1), rv),
        "B3": Entry(b3, _sql_layout_records(2), rv),
        "B4": Entry(b4, _sql_layout_records(3), rv),
        "B5": Entry(b5, _sql_layout_records(4), rv),
        "B6": Entry(b6, _SQL_ROW_KINDS, rv),
        "B12": Entry(b12, B12_SQL, rv),
        "B15": Entry(b15, f"select year(date) as year, count(*) as n from ({SQL_GOOD}) g group by year(date)", rv),
        "B18": Entry(b18, B18_SQL, rv),
    }


# --- duplicates: an extra page on every 17th day (B8, B13, B16) ----------------------------

EXTRA_PAGE = 99
LATE_EVERY = 17           # days


def extra_cells(t) -> DataFrame:
    """A late page (layout 3) on every 17th day repeating the day's first
    three cities -- first with altered values, then with the originals --
    plus an ``Aurangabad`` row and one under an alias. Last-row-wins (B8) keeps the originals, the
    exclusion (B13) drops Aurangabad, first-page-wins (B16) prefers the
    regular pages."""
    s = source_city_days(t, LATE_EVERY).where(F.col("r") < 3)
    row = lambda q, a: F.array(F.col("city"), q, a.cast("string"), F.col("pollutant"),
                               F.col("n_st").cast("string"))
    per_city = s.select(F.col("d").cast("string").alias("date"), "r",
                        F.array(row(F.lit("Severe"), F.col("aqi") + 500),
                                row(F.col("quality"), F.col("aqi"))).alias("rows"))
    pages = per_city.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("r", "rows"))).alias("rr"))
    first_half = F.transform("rr", lambda x: F.get(x["rows"], 0))
    second_half = F.transform("rr", lambda x: F.get(x["rows"], 1))
    header = F.array(*[F.lit(h).cast("string") for h in LAYOUT_3_HEADERS[0]])
    aur = F.array(*[F.array(*[F.lit(v) for v in row]) for row in (
        ("Aurangabad", "Good", "10", "PM10", "1"), ("Gurgaon", "Good", "20", "PM10", "2"))])
    return pages.select("date", F.lit(EXTRA_PAGE).alias("page"),
                        F.concat(F.array(header), first_half, second_half, aur).alias("cells"))


def _all_cells(t) -> DataFrame:
    return derived_cells(t).unionByName(extra_cells(t))


def _all_city_states(t) -> DataFrame:
    """The lookup with the late page's cities: the excluded one has a state too,
    so only the exclusion keeps it out; the alias is found by its canonical name."""
    return _city_states(t).unionByName(t.spark.createDataFrame(
        [("Aurangabad", "late"), ("Gurugram", "late")], "city string, state string"))


def b8(t):
    """The late page's records after last-row-wins."""
    recs = last_per_table_records(extra_cells(t))
    return recs.select(F.to_date("date").alias("date"), canonical_city(F.col("city_raw")).alias("city"),
                       "aqi", "quality")


B8_SQL = (f"select d as date, city, aqi, quality from ({SQL_SOURCE}) s where dn % 17 = 0 and r < 3 "
          f"union all select distinct d, x.city, x.aqi, 'Good' from ({SQL_SOURCE}) s2, "
          f"(values ('Aurangabad', 10), ('Gurgaon', 20)) x(city, aqi) where dn % 17 = 0")


def b13(t):
    """The ambiguous city never reaches the city-day table."""
    good, _ = city_day(_all_cells(t), _all_city_states(t))
    return good.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.sum((F.col("city") == "Aurangabad").cast("int")).cast("bigint").alias("n_excluded_city"))


def b16(t):
    """One row per (date, city): the regular page wins over the late one;
    a city whose regular page was dropped (B9) comes from the late page."""
    good, _ = city_day(_all_cells(t), _all_city_states(t))
    return good.select("date", "city", "aqi", "pollutant", "quality", "n_stations")


_SQL_LATE = (f"select d as date, city, state, aqi, pollutant, quality, cast(n_st as integer) as "
             f"n_stations from ({SQL_SOURCE}) s where dn % 17 = 0 and r < 3 and (d, page) in "
             f"(select d, page from ({SQL_SOURCE}) b where bad) union all "
             f"select distinct d, 'Gurugram', 'late', 20, 'PM10', 'Good', 2 from ({SQL_SOURCE}) a "
             f"where dn % 17 = 0")
_SQL_GOOD_ALL = f"select * from ({SQL_GOOD}) g union all {_SQL_LATE}"
B13_SQL = (f"select count(*) as n_rows, cast(0 as bigint) as n_excluded_city from ({_SQL_GOOD_ALL}) a")
B16_SQL = (f"select date, city, aqi, pollutant, quality, n_stations from ({_SQL_GOOD_ALL}) a")


def dup_registry():
    rv = ("readings",)
    return {
        "B7": Entry(b7, B7_SQL, rv),
        "B8": Entry(b8, B8_SQL, rv),
        "B13": Entry(b13, B13_SQL, rv),
        "B16": Entry(b16, B16_SQL, rv),
    }
