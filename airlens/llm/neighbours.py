"""Operator 7: approximate nearest neighbours by multi-index hashing.

A bounded sample learns the codes: principal axes, and ``ROTATIONS`` rotations
that iterative quantisation fits to them; the signs along the rotated axes are
the bits. The sample also bounds each query's k-th distance from above and says
how far apart in bits two vectors of a given distance are, which gives every
query its Hamming radius r.

Every row is indexed. A code falls into bytes, each with its own table from
value to rows. By the pigeonhole principle a code within r of the query is
within r // (number of bytes) of it in one byte at least, so probing those
values in every table retrieves each code within r; the full codes then drop
the rest and the original vectors rank what is left in double precision.

Equal vectors are one entry of the index with their smallest ids, so a vector
that very many rows share is neither a hot bucket nor a hot key. The queries
are taken in blocks of ``QUERY_BLOCK`` vectors, each block against all rows.

The radius is learned, so it may hold too few rows of a query that is unlike the
sample. Queries left with fewer rows than there are to give are probed again
with all bits, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 10
EVERY = 100
SAMPLE = 20_000           # rows that fit codes and radii
ROTATIONS = 2
QUERY_BLOCK = 20_000
SHARD = 100_000           # rows of one in-memory index
COVER = 0.99              # share of the sample's true neighbours inside the radius

_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Codes:
    """Rotated sign codes and the distance-to-radius rule, learned from a sample."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.mean = x.mean(axis=0)
        c = x - self.mean
        _, axes = np.linalg.eigh(c.T @ c)
        y = c @ axes
        rng = np.random.default_rng(seed)
        turns = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(y.shape[1], y.shape[1])))[0]
            for _ in range(20):
                u, _, vt = np.linalg.svd(np.where(y @ r > 0, 1.0, -1.0).T @ y)
                r = (u @ vt).T
            turns.append(r)
        self.turn = axes @ np.concatenate(turns, axis=1)
        self.sample = x
        self.code = self.encode(x)
        # Hamming distances of near pairs, against their distance
        pick = rng.choice(len(x), min(len(x), 200), replace=False)
        near_d, near_h = [], []
        for i in pick:
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            k = np.argsort(d, kind="stable")[1:2 * K + 1]
            near_d.append(d[k])
            near_h.append(_POP[self.code[k] ^ self.code[i]].sum(axis=1))
        d, h = np.concatenate(near_d), np.concatenate(near_h).astype(np.float64)
        if len(d) >= 20 and np.ptp(d) > 0:
            slope, base = np.polyfit(d, h, 1)
            slope = max(slope, 0.0)
            base = np.quantile(h - slope * d, COVER)
        else:
            slope, base = 0.0, float(self.code.shape[1] * 8)
        self.slope, self.base = slope, base

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)

    def limits(self, q: np.ndarray, k: int) -> np.ndarray:
        """An upper bound of each query's k-th smallest distance."""
        out = np.full(len(q), np.inf)
        if len(self.sample) >= k:
            for i in range(len(q)):
                d = np.sqrt(((self.sample - q[i]) ** 2).sum(axis=1))
                out[i] = np.partition(d, k - 1)[k - 1]
        return out

    def radii(self, limit: np.ndarray) -> np.ndarray:
        bits = self.code.shape[1] * 8
        r = np.where(np.isfinite(limit), self.base + self.slope * np.minimum(limit, 1e9), bits)
        return np.clip(np.ceil(r), 0, bits).astype(np.int64)


class Index:
    """Byte tables over the codes of one shard."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = np.argsort(codes, axis=0, kind="stable")
        self.bounds = [np.searchsorted(codes[self.order[:, j], j], np.arange(257))
                       for j in range(codes.shape[1])]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within the radius."""
        m = len(code)
        masks = np.flatnonzero(_POP <= radius // m)
        found = np.zeros(len(self.codes), bool)
        for j in range(m):
            if len(masks) == 256:
                found[:] = True
                break
            b = self.bounds[j]
            v = masks ^ int(code[j])
            lo, n = b[v], b[v + 1] - b[v]
            to = np.cumsum(n)
            found[self.order[np.repeat(lo - to + n, n) + np.arange(to[-1]), j]] = True
        rows = np.flatnonzero(found)
        return rows[_POP[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def _search(index_rows, queries, codes, limit, radius, keep):
    """(query, id, distance) of the nearest ``keep`` ids of one shard for each query."""
    x, ids, owner = index_rows
    index, qcode = Index(codes.encode(x)), codes.encode(queries)
    starts = np.searchsorted(owner, np.arange(len(x) + 1))
    out_q, out_id, out_d = [], [], []
    for i in range(len(queries)):
        rows = index.within(qcode[i], int(radius[i]))
        if not len(rows):
            continue
        d = np.sqrt(((x[rows] - queries[i]) ** 2).sum(axis=1))
        near = d <= limit[i]
        rows, d = rows[near], d[near]
        if len(rows) > keep:
            top = d <= np.partition(d, keep - 1)[keep - 1]
            rows, d = rows[top], d[top]
        n = starts[rows + 1] - starts[rows]
        to = np.cumsum(n)
        if not len(to):
            continue
        k = np.repeat(starts[rows] - to + n, n) + np.arange(to[-1])
        v, dd = ids[k], np.repeat(d, n)
        best = np.lexsort((v, dd))[:keep]
        out_q.append(np.full(len(best), i))
        out_id.append(v[best])
        out_d.append(dd[best])
    if not out_q:
        return None
    return np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_d)


def _shards(state, keep):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, keys, queries, limit, radius = state.value
        held, rows = [], 0

        def search():
            x = np.concatenate([h[0] for h in held])
            ids = np.concatenate([h[1] for h in held])
            n = np.concatenate([h[2] for h in held])
            got = _search((x, ids, np.repeat(np.arange(len(n)), n)), queries, codes, limit, radius, keep)
            if got is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[got[0]]), pa.array(got[1]), pa.array(got[2])],
                    names=["key", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            e, i = batch.column("embedding"), batch.column("ids")
            x = e.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            held.append((x.reshape(batch.num_rows, -1), i.flatten().to_numpy(zero_copy_only=False),
                         np.array([len(v) for v in i])))
            rows += batch.num_rows
            if rows >= SHARD:
                yield from search()
                held, rows = [], 0
        if held:
            yield from search()
    return run


def _finite(e: Column) -> Column:
    """No null or non-finite component, and not all zero."""
    top = F.lit(float("inf"))
    return (F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < top))
            & F.exists(e, lambda v: v != 0))


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, each pair once."""
    v = (vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
         .filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
                 & _finite(F.col("embedding"))))
    sizes = v.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return v.filter(F.size("embedding") == (sizes["n"] if sizes else 0)).dropDuplicates()


def search(vectors: DataFrame, k: int = K, every: int = EVERY, sample: int = SAMPLE,
           query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest found of each query (vec_id divisible by ``every``), nearest first.

    A null id, or a vector that is null, zero, holds a null or non-finite component
    or is not of the commonest length, takes no part. A row that comes again counts
    once; a query's own row is no candidate; an id with two vectors is two queries, and
    each of the two a candidate of the other. Equal distances go by vec_id. Fewer
    candidates than k give all that were found. An empty table gives no rows;
    other columns are not read.
    """
    spark = vectors.sparkSession
    v = valid(vectors).checkpoint()
    schema = "query_id long, rank int, vec_id long, score double"
    fit = v.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(sample).toPandas()
    if not len(fit):
        return spark.createDataFrame([], schema)
    codes = Codes(np.stack(fit["embedding"].to_numpy()).astype(np.float64))
    keep = k + 1                                    # the query's own row is among them
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    # the limit applies before the shuffle; then at most k + 1 ids a vector
    entries = (v.withColumn("r", first).filter(F.col("r") <= keep).groupBy("embedding")
               .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    q = v.filter(F.col("vec_id") % every == 0).withColumn("key", F.xxhash64("embedding"))
    wanted = q.select("key", "embedding").dropDuplicates(["key"])
    best = Window.partitionBy("key").orderBy("score", "vec_id")

    def probed(wanted: DataFrame, every_bit: bool) -> DataFrame | None:
        """(key, vec_id, score, r) of the nearest ``keep`` within each radius, or of all rows."""
        blocks = max(1, -(-wanted.count() // query_block))
        found = None
        for b in range(blocks):
            own = wanted if blocks == 1 else wanted.filter(F.pmod("key", F.lit(blocks)) == b)
            own = own.toPandas()                    # about query_block vectors
            if not len(own):
                continue
            x = np.stack(own["embedding"].to_numpy()).astype(np.float64)
            limit = codes.limits(x, keep)
            radius = codes.radii(np.full(len(x), np.inf) if every_bit else limit)
            state = spark.sparkContext.broadcast((codes, own["key"].to_numpy(np.int64), x, limit, radius))
            hits = entries.mapInArrow(_shards(state, keep), "key long, vec_id long, score double")
            found = hits if found is None else found.unionAll(hits)
        if found is not None:
            found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= keep)
        return found

    top = probed(wanted, False)
    if top is None:
        return spark.createDataFrame([], schema)
    top = top.checkpoint()
    full = top.groupBy("key").count().filter(F.col("count") >= min(keep, v.count())).select("key")
    short = wanted.join(full, "key", "left_anti").checkpoint()
    again = probed(short, True)
    if again is not None:
        top = top.join(short.select("key"), "key", "left_anti").unionAll(again)
    near = (q.select(F.col("vec_id").alias("query_id"), "key").join(top, "key")
            .filter("query_id <> vec_id or score > 0"))      # all but the query's own row
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return (near.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
