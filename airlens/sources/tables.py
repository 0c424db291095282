"""Base tables and the three reference tables (readings, states, funding).

``readings`` is the one large fact table. It is derived once per input
snapshot by a Spark job (4-way join) and written as parquet partitioned by
``year`` and range-clustered on ``ts`` under the shared store folder, so every
catalog query afterwards gets partition pruning, row-group skipping on ``ts``
and column pruning instead of re-running the join. ``states`` and ``funding``
are dimension tables (one row per state / funded city); they are materialised
the same way, which gives the planner exact file sizes, so it broadcasts them
only when they fit ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import hashlib
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.session import store_root

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
               "lineitem", "events", "documents", "embeddings", "pages",
               "benchmark", "labels", "conversations")

_LOCK = threading.RLock()
_CACHE: dict[tuple, "Tables"] = {}


def _hadoop_fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_fs(spark, path)
    return bool(fs.exists(p))


STORE_VERSION = "5"  # bump when a stored table's layout or derivation changes


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Identify an input snapshot by path, file sizes and modification times."""
    h = hashlib.sha1(f"{STORE_VERSION}:{sf_dir}".encode())
    for name in ("lineitem", "orders", "customer", "nation"):
        p, fs = _hadoop_fs(spark, f"{sf_dir}/{name}.parquet")
        if not fs.exists(p):
            continue
        files, found = fs.listFiles(p, True), []     # a table may be a folder of files
        while files.hasNext():
            st = files.next()
            found.append(f"{name}:{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
        h.update("|".join(sorted(found)).encode())
    return h.hexdigest()[:16]


def published(spark: SparkSession, marker: str, build) -> str:
    """The folder of a complete build, built once: ``build(folder)`` fills a new
    folder, and a marker written last names it. Nothing is renamed, so this holds
    on an object store; an interrupted build is never named, and if two sessions
    build at once, either's complete folder serves."""
    if not path_exists(spark, f"{marker}/_SUCCESS"):
        folder = f"{marker}-{uuid.uuid4().hex[:12]}"
        build(folder)
        spark.createDataFrame([(folder,)], "path string").coalesce(1) \
            .write.mode("overwrite").parquet(marker)
        return folder
    return spark.read.schema("path string").parquet(marker).first()["path"]


def ts_literal(value: str) -> Column:
    """A TIMESTAMP_NTZ literal (the readings clock is zone-free)."""
    return F.expr(f"timestamp_ntz'{value}'")


@dataclass
class Tables:
    """Lazily loaded tables of one input snapshot (an sf directory)."""

    spark: SparkSession
    sf_dir: str
    _frames: dict = field(default_factory=dict)
    _paths: dict = field(default_factory=dict)
    _years: tuple[int, ...] | None = None

    @classmethod
    def of(cls, spark: SparkSession, readings: DataFrame, states: DataFrame | None = None,
           funding: DataFrame | None = None, city_states: DataFrame | None = None) -> Tables:
        """The catalog's tables from the caller's own frames.

        ``readings`` has ts (timestamp), station, city, state, pm25 and pm10 (NaN is
        missing); further columns are kept and ``year`` is added if it is not there.
        ``states`` has state, population, area_km2, is_ut; ``funding`` state, city,
        rel_fy1..3, total_released, utilised; ``city_states`` city, state (default:
        as the readings have them). Queries that need a frame not given fail by name.
        """
        need = {"readings": (readings, ("ts", "station", "city", "state", "pm25", "pm10")),
                "states": (states, ("state", "population", "area_km2", "is_ut")),
                "funding": (funding, ("state", "city", "rel_fy1", "rel_fy2", "rel_fy3", "total_released", "utilised")),
                "city_states": (city_states, ("city", "state"))}
        frames = {}
        for name, (df, columns) in need.items():
            if df is not None:
                missing = [c for c in columns if c not in df.columns]
                if missing:
                    raise ValueError(f"{name} lacks the columns {missing}")
                frames[name] = df
        r = frames["readings"].withColumn("ts", F.col("ts").cast("timestamp_ntz"))
        for c in ("pm25", "pm10"):
            r = r.withColumn(c, F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")))
        if "year" not in r.columns:
            r = r.withColumn("year", F.year("ts"))
        frames["readings"] = r
        frames.setdefault("city_states", r.select("city", "state").distinct())
        return cls(spark, "", frames)

    # -- base tables ---------------------------------------------------------
    def base(self, name: str) -> DataFrame:
        if not self.sf_dir:
            raise ValueError(f"this query needs the base table {name}, which the caller's frames do not have")
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        raise AttributeError(name)

    # -- derived reference tables ---------------------------------------------
    @property
    def readings(self) -> DataFrame:
        return self._materialised("readings", build_readings, partition_by="year")

    @property
    def stored_years(self) -> tuple[int, ...]:
        """The years of the stored readings, by the names of their folders; none
        for the caller's own frames, whose layout is not known."""
        if "readings" in self._frames and "readings" not in self._paths:
            return ()
        self.readings
        if self._years is None:
            p, fs = _hadoop_fs(self.spark, self._paths["readings"])
            names = [st.getPath().getName() for st in fs.listStatus(p)]
            years = [n.removeprefix("year=") for n in names if n.startswith("year=")]
            # readings without a time are in no year, and no month holds them
            self._years = tuple(sorted(int(y) for y in years if y.isdigit()))
        return self._years

    @property
    def states(self) -> DataFrame:
        return self._materialised("states", build_states)

    @property
    def funding(self) -> DataFrame:
        return self._materialised("funding", build_funding)

    @property
    def city_states(self) -> DataFrame:
        """City -> state lookup (a dimension: one row per city)."""
        return self._materialised(
            "city_states", lambda t: t.readings.select("city", "state").distinct())

    @property
    def bulletin_cells(self) -> DataFrame:
        """Bulletin page tables derived from readings -- the ETL's input table
        (it stands for the cells extracted from the PDFs), stored once."""
        from airlens.operators.bulletins import build_cells
        return self._materialised("bulletin_cells", build_cells)

    @property
    def samples(self) -> DataFrame:
        return build_samples(self)

    @property
    def runs(self) -> DataFrame:
        return build_runs(self)

    def _materialised(self, name: str, builder, partition_by: str | None = None) -> DataFrame:
        if name in self._frames:
            return self._frames[name]
        if not self.sf_dir:
            raise ValueError(f"this query needs {name}, which was not given")
        root = f"{store_root(self.spark)}/{_fingerprint(self.spark, self.sf_dir)}"

        def build(folder: str) -> None:
            writer = builder(self).write.mode("error")
            if partition_by:
                writer = writer.partitionBy(partition_by)
            writer.parquet(folder)

        with _LOCK:
            path = published(self.spark, f"{root}/{name}", build)
        df = self.spark.read.parquet(path)
        self._frames[name] = df
        self._paths[name] = path
        return df


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables for ``sf_dir``, shared by every query of the session."""
    # an id may be used again after a session stops, an application's is not
    key = (spark.sparkContext.applicationId, id(spark), sf_dir.rstrip("/"))
    with _LOCK:
        t = _CACHE.get(key)
        if t is None:
            t = Tables(spark, sf_dir.rstrip("/"))
            _CACHE[key] = t
    return t


# ---------------------------------------------------------------------------
# Builders (Spark jobs that derive the reference tables from the base tables)
# ---------------------------------------------------------------------------

ROWS_A_TASK = 600_000     # readings that one task sorts (about 100 MB)


def tasks_for(rows: DataFrame, rows_a_task: int = ROWS_A_TASK) -> int:
    """Tasks of a shuffle of these rows: the session's number, more if they would get too many rows.

    Rows of stored tables are counted from the Parquet footers. With a fixed number the
    rows of a task grow with the input, and sorts spill as soon as they do not fit.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-rows.count() // rows_a_task))


def build_readings(t: Tables) -> DataFrame:
    """Daily station readings: lineitem x orders x customer x nation.

    The dimension side (customer x nation) is joined to orders first; the
    single lineitem shuffle is on ``l_orderkey``. The output is range-clustered
    on ``ts`` so files and row groups hold narrow time spans. What can be derived
    from other columns (city, year) is, after the last shuffle.
    """
    nation = t.nation.select("n_nationkey", "n_name")
    customer = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    orders = t.orders.select("o_orderkey", "o_custkey")
    # NaN means "missing" in the reference's float columns: store it as NULL.
    pm25 = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("l_quantity"))
    pm10 = F.col("l_extendedprice") / 1000
    lineitem = t.lineitem.select("l_orderkey", F.col("l_shipdate").alias("ts"), *[
        F.when(F.isnan(c), None).otherwise(c).alias(name) for name, c in (("pm25", pm25), ("pm10", pm10))])
    n = tasks_for(t.lineitem)
    more = n > int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    if more:
        lineitem = lineitem.repartition(n, "l_orderkey")
    if more and t.customer.count() > ROWS_A_TASK:
        orders, customer = orders.repartition(n, "o_custkey"), customer.repartition(n, "c_custkey")
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    ord_loc = orders.join(cust, orders.o_custkey == cust.c_custkey).select(
        "o_orderkey", "c_name", "c_mktsegment", "n_name")
    if more:
        ord_loc = ord_loc.repartition(n, "o_orderkey")
    rows = lineitem.join(ord_loc, lineitem.l_orderkey == ord_loc.o_orderkey).select(
        "ts", "c_name", "c_mktsegment", "n_name", "pm25", "pm10")
    # range-cluster on time; the row hash splits a hot day across partitions
    keys = (F.col("ts"), F.xxhash64("c_name", "n_name", "c_mktsegment", "pm25", "pm10"))
    dealt = rows.repartitionByRange(n, *keys) if more else rows.repartitionByRange(*keys)
    # in the order that the writer needs for its folders, so that it does not sort again
    return dealt.select(
        "ts", F.col("c_name").alias("station"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("city"),
        F.col("n_name").alias("state"), "pm25", "pm10", F.year("ts").alias("year"),
    ).sortWithinPartitions("year", "ts")


def build_states(t: Tables) -> DataFrame:
    """Demographics per state; customers are counted per nation key first."""
    per_nation = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    nation = t.nation.where(F.col("n_nationkey") != 23)
    j = per_nation.join(nation, per_nation.c_nationkey == nation.n_nationkey)
    g = j.groupBy("n_name").agg(
        F.sum("n").alias("cnt"),
        F.max("n_nationkey").alias("nk"),
        F.max("n_regionkey").alias("rk"),
    )
    return g.select(
        F.col("n_name").alias("state"),
        (F.col("cnt") * 1000000 + F.col("nk")).cast("bigint").alias("population"),
        F.when(F.col("rk") == 4, (F.col("nk") + 1) * 100)
         .otherwise((F.col("nk") + 1) * 4000).cast("bigint").alias("area_km2"),
        (F.col("rk") == 4).alias("is_ut"),
    )


def _in_fy(col: Column, start: str, end: str) -> Column:
    return (col >= ts_literal(start)) & (col < ts_literal(end))


def build_funding(t: Tables) -> DataFrame:
    """Funding per (state, city). Orders are pre-aggregated per customer so the
    join to the customer dimension sees one row per customer, not per order."""
    od = F.col("o_orderdate")
    price = F.col("o_totalprice")
    windows = {
        "rel_fy1": _in_fy(od, "1996-04-01 00:00:00", "1997-04-01 00:00:00"),
        "rel_fy2": _in_fy(od, "1997-04-01 00:00:00", "1998-04-01 00:00:00"),
        "rel_fy3": _in_fy(od, "1998-04-01 00:00:00", "1999-04-01 00:00:00"),
        "total_released": _in_fy(od, "1996-04-01 00:00:00", "1999-04-01 00:00:00"),
        "utilised": _in_fy(od, "1996-04-01 00:00:00", "1999-04-01 00:00:00")
        & (F.col("o_orderstatus") == "F"),
    }
    per_cust = t.orders.groupBy("o_custkey").agg(
        *[F.sum(F.when(cond, price)).alias(name) for name, cond in windows.items()])
    nation = t.nation.where(F.col("n_nationkey") % 4 != 0).select("n_nationkey", "n_name")
    customer = t.customer.where(F.col("c_mktsegment") != "MACHINERY") \
        .select("c_custkey", "c_nationkey", "c_mktsegment")
    cust = customer.join(nation, customer.c_nationkey == nation.n_nationkey)
    j = per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
    g = j.groupBy("n_name", "c_mktsegment").agg(
        *[F.coalesce(F.sum(name), F.lit(0.0)).alias(name) for name in windows])
    return g.select(
        F.col("n_name").alias("state"),
        F.concat(F.col("n_name"), F.lit("/"), F.col("c_mktsegment")).alias("city"),
        *windows.keys(),
    )


def build_samples(t: Tables) -> DataFrame:
    """Graded evaluation samples (one row per generated sample)."""
    qid = F.floor(F.col("event_id") / 5).cast("bigint")
    ok = F.col("event_type") != "error"
    passed = ok & (F.col("value") >= 20)
    u = F.col("user_id") % 4
    return t.events.select(
        qid.alias("question_id"),
        (F.col("event_id") % 5).alias("sample_idx"),
        F.when(qid % 2 == 0, "base").otherwise("tuned").alias("model"),
        F.concat(F.lit("cat_"), (qid % 7).cast("string")).alias("category"),
        ok.alias("executed"),
        passed.alias("passed"),
        F.when(passed, F.lit(None).cast("string"))
         .when(ok, "AssertionError")
         .when(u == 0, "KeyError")
         .when(u == 1, "SyntaxError")
         .when(u == 2, "NameError")
         .otherwise("TimeoutError").alias("error_type"),
    )


def build_runs(t: Tables) -> DataFrame:
    """Captured run logs of the samples: exit code, timeout flag, output text
    and the gold answer (shapes: pass, pass without marker, assertion after
    output, KeyError, SyntaxError, NameError, empty log, timeout)."""
    qid = F.floor(F.col("event_id") / 5).cast("bigint")
    ok = F.col("event_type") != "error"
    passed = ok & (F.col("value") >= 20)
    u = F.col("user_id") % 4
    v100 = F.round(F.col("value") * 100).cast("bigint").cast("string")
    nl = "\n"
    log = (F.when(passed & (F.col("user_id") % 10 == 9), v100)
           .when(passed, F.concat(F.lit("EXEC_OK: "), v100))
           .when(ok, F.concat(F.lit("EXEC_OK: "), v100, F.lit(
               nl + "Traceback (most recent call last):" + nl
               + '  File "<string>", line 9, in <module>' + nl + "AssertionError")))
           .when(u == 0, F.lit("Traceback (most recent call last):" + nl
                               + '  File "<string>", line 4, in get_response' + nl
                               + "KeyError: 'PM25'"))
           .when(u == 1, F.lit('  File "<string>", line 2' + nl + "SyntaxError: invalid syntax"))
           .when((u == 2) & (F.col("value") < 5), F.lit(""))
           .when(u == 2, F.lit("Traceback (most recent call last):" + nl
                               + "NameError: name 'pd' is not defined"))
           .otherwise(F.lit("")))
    e3 = F.col("event_id") % 3
    answer = (F.when(e3 == 0, v100)
              .when(e3 == 1, F.concat(v100, F.lit(".0000001")))
              .otherwise(F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string"))))
    return t.events.select(
        qid.alias("question_id"),
        (F.col("event_id") % 5).alias("sample_idx"),
        F.when(passed, 0).when(~ok & (u == 3), F.lit(None)).otherwise(1)
         .cast("int").alias("exit_code"),
        (~ok & (u == 3)).alias("timed_out"),
        log.alias("log"),
        answer.alias("answer"),
    )
