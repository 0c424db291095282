"""Generic relational building blocks shared by several operators.

``with_ordinal`` gives each row its 0-based position in a global order without
a single-partition window: the frame is range-partitioned and sorted on the
key, each row gets (partition id, index within partition) from
``monotonically_increasing_id``, the frame is checkpointed to the cluster's
checkpoint folder (fixing that numbering even if executors are lost), and
per-partition offsets -- a table with one row per partition -- are added back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.session import ensure_checkpoint_dir


def with_ordinal(df: DataFrame, order_col: str, name: str = "ordinal") -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    s = (df.repartitionByRange(order_col).sortWithinPartitions(order_col)
         .withColumn("_pid", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id()))
    s = s.checkpoint(eager=True)
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: a bounded broadcast
    j = s.join(F.broadcast(offs), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return j.withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")


def registry():
    return {}
