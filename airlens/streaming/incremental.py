"""The bulletin ETL and exceedance counts as streaming queries.

Both read files as they land (file source, ``maxFilesPerTrigger`` bounds each
micro-batch) with ``trigger(availableNow=True)``, so a run processes everything
new and stops. A micro-batch is reduced by its key and written as one folder
named by its batch id: a batch that is replayed after a failure overwrites its
own folder, so nothing counts twice. The reductions are associative, and the
reader finishes them over all batches. No watermark drops anything: a bulletin
or reading that arrives years late changes its day like any other.

A sink belongs to its caller: ``bulletin_stream`` and ``exceedance_stream`` on the
sink of an earlier run take up where it stood, or find nothing left to do. The
queries S1 and S2 stream the whole snapshot into a sink of their own each time, so
that a query is always the whole work, and sessions cannot meet in one checkpoint.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.operators import bulletins as b
from airlens.plans.registry import Entry
from airlens.session import store_root
from airlens.sources.tables import _fingerprint, published

_LOCK = threading.RLock()


def _dir(t, name: str) -> str:
    return f"{store_root(t.spark)}/{_fingerprint(t.spark, t.sf_dir)}/stream/{name}"


def run_stream(spark, schema: str, source: str, sink: str, reduce, files_per_batch: int) -> None:
    """Every new file of ``source`` through ``reduce`` into ``sink/out/batch=<id>``."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
           .parquet(source))

    def write(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{sink}/out/batch={batch_id}")

    q = (src.writeStream.foreachBatch(write).option("checkpointLocation", f"{sink}/ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def bulletin_stream(spark, cells_dir: str, sink: str, files_per_batch: int = 8) -> DataFrame:
    """Bulletin tables -> the first row of each (date, city), as in the batch ETL."""
    run_stream(spark, b.CELLS_SCHEMA, cells_dir, sink,
               lambda batch: b.first_of_day(b.city_rows(batch)), files_per_batch)
    return b.first_of_day(spark.read.parquet(f"{sink}/out"))


def exceedance_stream(spark, readings_dir: str, sink: str, limit: float = 15.0,
                      files_per_batch: int = 8) -> DataFrame:
    """Readings -> per day and city the number of readings above ``limit``."""
    schema = "ts timestamp_ntz, station string, city string, state string, pm25 double, pm10 double"
    run_stream(spark, schema, readings_dir, sink,
               lambda batch: batch.where(F.col("pm25") > limit).groupBy(
                   F.to_date("ts").alias("date"), "city").agg(F.count(F.lit(1)).alias("n")),
               files_per_batch)
    return (spark.read.parquet(f"{sink}/out").groupBy("date", "city")
            .agg(F.sum("n").alias("n_exceed")))


def fresh_sink(t, name: str) -> str:
    return _dir(t, f"{name}-{uuid.uuid4().hex[:12]}")


def landed(t, name: str, build, order: str) -> str:
    """The arrival folder of a stream input, landed once per snapshot by one write,
    each file a stretch of time. If two sessions land it at once there are two
    folders alike, and either serves. The caller's own frames have no snapshot to
    name them by, so they land anew each time."""
    if not t.sf_dir:
        folder = fresh_sink(t, name)
        build().repartitionByRange(order).write.parquet(folder)
        return folder
    return published(t.spark, _dir(t, name), lambda folder: build().repartitionByRange(order)
                     .write.parquet(folder))


def s1(t):
    """S1 over all bulletins, the late pages with duplicates, an alias and the
    excluded city included."""
    with _LOCK:
        cells_dir = landed(t, "s1_cells", lambda: b._all_cells(t), "date")
    first = bulletin_stream(t.spark, cells_dir, fresh_sink(t, "s1"))
    good, _ = b.with_state(first, b._all_city_states(t))
    return good.select("date", "city", "state", "aqi", "pollutant", "quality", "n_stations")


S1_SQL = b._SQL_GOOD_ALL


def s2(t):
    with _LOCK:
        src_dir = landed(t, "s2_readings", lambda: t.readings.select(
            "ts", "station", "city", "state", "pm25", "pm10"), "ts")
    return exceedance_stream(t.spark, src_dir, fresh_sink(t, "s2"))


S2_SQL = ("select cast(ts as date) as date, city, count(*) as n_exceed from readings "
          "where pm25 > 15 group by cast(ts as date), city")


def registry():
    return {
        "S1": Entry(s1, S1_SQL, ("readings",)),
        "S2": Entry(s2, S2_SQL, ("readings",)),
    }
