"""Operator 2: sharding by fixed virtual slots.

Every record is hashed into one of ``SLOTS`` virtual slots, for good. The bytes
of each slot are summed (at most ``SLOTS`` rows, whatever the input), and a
versioned map says which shard holds which slot. Rebalancing writes a new
version that edits the last one: it moves as few slots as the excess asks for.
Only the map, whose size is fixed, passes through the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlens.llm.common import copies, scratch
from airlens.session import ensure_checkpoint_dir

SLOTS = 8192
SHARDS = 40


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row (a null text: size 16, crc 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    # rows alike are counted, and numbered in the hash, so that they spread over the slots
    alike = base.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    return copies(alike, "n", "copy").withColumn("virtual_slot", F.pmod(
        F.xxhash64("doc_id", "text_crc32", "size", "copy"), F.lit(slots)).cast("int")).drop("n", "copy")


def slot_loads(recs: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of every slot; ``slots`` rows at most reach the driver."""
    rows = recs.groupBy("virtual_slot").agg(
        F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows:
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    return size, count


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> np.ndarray:
    """Version 0: the slots dealt round."""
    return np.arange(slots) % shards


def rebalance(size: np.ndarray, shard_of: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The map edited until no move or swap brings the fullest and emptiest shard closer.

    Shards above the mean release slots, largest first while they stay above it;
    the released slots go to the emptiest shards; then single moves and swaps
    between the fullest and the emptiest shard narrow what is left.
    """
    shard_of = shard_of.copy()
    load = np.bincount(shard_of, weights=size, minlength=shards)
    mean = size.sum() / shards
    pool = []
    for s in np.flatnonzero(load > mean):
        own = np.flatnonzero((shard_of == s) & (size > 0))
        for x in own[np.argsort(-size[own], kind="stable")]:
            if load[s] - size[x] >= mean:
                pool.append(x)
                load[s] -= size[x]
    for x in sorted(pool, key=lambda x: (-size[x], x)):
        s = int(np.argmin(load))
        shard_of[x] = s
        load[s] += size[x]
    for _ in range(len(size)):
        hi, lo = int(np.argmax(load)), int(np.argmin(load))
        gap = load[hi] - load[lo]
        a = np.flatnonzero((shard_of == hi) & (size > 0))
        b = np.flatnonzero((shard_of == lo) & (size > 0))
        give = size[a][:, None] - np.concatenate([[0], size[b]])[None, :]
        if not give.size:
            break
        cost = np.abs(gap - 2 * give)
        cost[give <= 0] = gap + 1
        k = int(np.argmin(cost))
        if cost.flat[k] >= gap:
            break
        i, j = divmod(k, give.shape[1])
        shard_of[a[i]] = lo
        if j:
            shard_of[b[j - 1]] = hi
        load[hi] -= give[i, j]
        load[lo] += give[i, j]
    return shard_of


def save_map(spark: SparkSession, path: str, version: int, shard_of: np.ndarray,
             size: np.ndarray, count: np.ndarray) -> DataFrame:
    """Write one version of the map: slot, shard, and the rows of the shard before the slot."""
    order = np.lexsort((np.arange(len(shard_of)), shard_of))
    before = np.zeros(len(shard_of), np.int64)
    run = np.cumsum(count[order]) - count[order]
    first = {}
    for pos, x in enumerate(order):
        before[x] = run[pos] - first.setdefault(shard_of[x], run[pos])
    rows = [(version, i, int(shard_of[i]), int(size[i]), int(count[i]), int(before[i]))
            for i in range(len(shard_of))]
    df = spark.createDataFrame(
        rows, "version int, virtual_slot int, shard int, slot_bytes long, slot_rows long, "
              "rows_before long").coalesce(1)
    df.write.mode("append").partitionBy("version").parquet(path)
    return spark.read.parquet(path).filter(F.col("version") == version)


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS,
           path: str | None = None) -> DataFrame:
    """One row per record with its shard and its place there (law ``bytes``).

    The map starts as version 0 (dealt round) and version 1 edits it by the
    measured bytes. ``slot`` numbers a shard's records from 0 without a gap:
    rows before the virtual slot plus the place in it, so the numbering needs
    thousands of small windows, not one per shard. Nulls: a null text has size
    16; a null doc_id is an ordinary value. Repeated rows each get a place; they are
    hashed with their number, so they spread over the slots like other rows. An empty table gives no rows. Other
    columns are not read. A row larger than a shard's share stays whole, so that
    shard is larger than the mean.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    recs = records(docs, slots).checkpoint()
    size, count = slot_loads(recs, slots)
    path = path or scratch(spark, "shard_map")
    start = first_map(slots, shards)
    save_map(spark, path, 0, start, size, count)
    slot_map = save_map(spark, path, 1, rebalance(size, start, shards), size, count)
    w = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # the map has ``slots`` rows, a fixed number
    m = F.broadcast(slot_map.select("virtual_slot", "shard", "rows_before", "version"))
    return (recs.withColumn("place", F.row_number().over(w).cast("long") - 1).join(m, "virtual_slot")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("rows_before") + F.col("place")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
                    F.col("version").cast("int").alias("map_version")))
