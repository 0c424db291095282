"""Helpers shared by the operators of this subpackage.

* ``scratch``: a fresh folder below the cluster's ``spark.checkpoint.dir``.
* ``utf8``: the bytes and offsets of an Arrow string column, without Python strings.
* ``word_hashes``: a 64-bit hash of every word of many texts, in numpy.
* ``components``: connected components of an edge table, by DataFrame rounds.
"""

from __future__ import annotations

import ctypes
import gc
import io
import os
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.session import ensure_checkpoint_dir, store_root

# bytes [\x20\x09-\x0D] separate words
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
# a-z, 0-9 and every byte of a non-ASCII character (after A-Z is lowered)
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BLOCK = 1 << 18          # bytes that words are looked for in at a time
_TAIL = 16                # most bytes that are cut off a word's end


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for one run, in the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{store_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where their path does not hold it already."""
    root = Path(__file__).resolve().parents[2]
    seen = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if str(root) in map(os.path.realpath, filter(None, seen)) or app in _shipped:
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in (root / "airlens").rglob("*.py"):
            z.write(f, f.relative_to(root))
    file = scratch(spark, "code") + "/airlens.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(data.getvalue())
    out.close()
    spark.sparkContext.addPyFile(file)
    _shipped.add(app)


def copies(df: DataFrame, n: str, at: str, most: int = 4096) -> DataFrame:
    """Every row as often as its column ``n`` says, numbered from 0 in ``at``.

    A row that comes more than ``most`` times is dealt out to all tasks in between,
    so no task makes more than its share. ``df`` is read twice.
    """
    few = df.filter(F.col(n) <= most).withColumn(at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / most)))
    many = df.filter(F.col(n) > most).withColumn(at, part).repartition(partitions(df.sparkSession), F.xxhash64(n, at))
    many = many.withColumn(at, F.explode(F.sequence(
        F.col(at) * most, F.least(F.col(n), (F.col(at) + 1) * most) - 1)))
    return few.filter(F.col(n) > 0).unionAll(many)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of finished steps removed.

    Spark's cleaner removes them when the driver's collector finds that no plan uses
    them any more; left alone, that is long after, as the driver makes little garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have in any case, made from ``names``."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1]
    o = o.astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0]:o[-1]], o - o[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            _powers[name] = np.multiply.accumulate(t)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE,
                ) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): a 64-bit hash per word (A-Z lowered), and where each text begins."""
    return find_words(data, offs, is_word)[:2]


def _tails(d: np.ndarray, start: np.ndarray, end: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """Where the last bytes of words that are in ``tail`` begin, if a letter or digit stands before them."""
    k = np.flatnonzero(tail[d[end - 1]])
    first, k = start[k], end[k] - 1
    for _ in range(_TAIL):
        more = (k > first) & tail[d[k - 1]]
        if not more.any():
            break
        k = k - more
    k = k[k > first]
    last = d[k - 1]
    ascii_ = ALNUM[last] & (last < 0x80)
    latin = (last >= 0x80) & (d[np.maximum(k - 2, 0)] == 0xC3) & (last != 0x97) & (last != 0xB7)
    return k[ascii_ | latin]


def find_words(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = NOT_SPACE,
               fold: np.ndarray = LOWER, tail: np.ndarray | None = None,
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets of the texts, first byte, length) of every word, its bytes by ``fold`` (A-Z lowered).

    Equal words have equal hashes, different words different ones but for a chance
    of about 2**-64 a pair. Bytes are worked on in blocks of about 256 kB that
    end between words, so memory does not follow the longest text. Up to ``_TAIL``
    bytes of the table ``tail`` at a word's end are a word of their own if an ASCII
    letter or digit or a Latin-1 letter stands before them.
    """
    total = len(data)
    hashes, where, size = [], [], []
    a = 0
    while a < total:
        b = min(total, a + _BLOCK)
        if b < total:
            inside = ~is_word[fold[data[a:b]]]
            cut = np.flatnonzero(inside)
            if len(cut):
                b = a + int(cut[-1]) + 1
            else:
                while b < total and is_word[fold[data[b]]]:
                    b += 1
        d = fold[data[a:b]]
        w = is_word[d]
        first = np.zeros(b - a + 1, bool)
        lo, hi = np.searchsorted(offs, a), np.searchsorted(offs, b)
        first[offs[lo:hi] - a] = True
        first[0] = first[-1] = True
        prev = np.empty_like(w)
        prev[0], prev[1:] = False, w[:-1]
        start = np.flatnonzero(w & (~prev | first[:-1]))
        nxt = np.empty_like(w)
        nxt[-1], nxt[:-1] = False, w[1:]
        end = np.flatnonzero(w & (~nxt | first[1:])) + 1
        if tail is not None and len(start):
            cut = _tails(d, start, end, tail)
            start, end = np.sort(np.r_[start, cut]), np.sort(np.r_[end, cut])
        if len(start):
            up, down = _power_tables(b - a)
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(_BYTE[d] * up[:b - a], out=sums[1:])
            h = (sums[end] - sums[start]) * down[start]
            hashes.append(mix64(h + (end - start).astype(np.uint64)))
            where.append(start + a)
            size.append(end - start)
        a = b
    if not hashes:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(offs), np.int64), none, none
    at = np.concatenate(where)
    return (np.concatenate(hashes), np.searchsorted(at, offs).astype(np.int64), at,
            np.concatenate(size))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 8 << 20):
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    _, offs = utf8(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield batch.slice(i, min(j, n) - i)
        i = min(j, n)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc only
_kept: dict[str, object] = {}


def kept(name: str, make):
    """What a worker keeps from task to task under this name (an encoder and its caches), made when it is missing."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def returning(parts, keep: str | None = None):
    """The parts of a batch; after each, memory that the worker has freed goes back to the system.

    Arrow's pool and the C heap keep it otherwise, for as long as the worker is used,
    so that an executor holds the peaks of all its workers' earlier steps at once. For
    the same reason what other steps have ``kept`` is let go first, all but ``keep``.
    """
    for name in [k for k in _kept if k != keep]:
        del _kept[name]
    for part in parts:
        yield part
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def _are_stars(e: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    nodes = (e.select("u", F.lit(1).alias("up"), F.lit(0).alias("down"))
             .unionAll(e.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    n = nodes.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return n.filter("up > 1 or (up > 0 and down > 0)").count() == 0


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, label): the smallest id that each node of the edges reaches.

    Large-star / small-star rounds: every round is two aggregations over a table
    of at most the edges' size, written to the shared checkpoint folder, and the
    number of rounds grows with the logarithm of the longest path. Nothing but
    one count a round reaches the driver. Null ids and self-links are ignored.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    x, y = F.col(src), F.col(dst)
    e = (edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
         .filter("u is not null and v is not null and u <> v").distinct().checkpoint())
    while not _are_stars(e):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u links to the smallest around u
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: the smaller neighbours of u, and u, link to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u")
        e = (star.select(F.col("v").alias("u"), F.col("m").alias("v"))
             .unionAll(least.select("u", F.col("m").alias("v")))
             .filter("u <> v").distinct().checkpoint())
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("label")).unionAll(roots)
