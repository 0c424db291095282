"""Operator 13: spelling variants by blocked Gram matrices of letter counts.

Words of a vocabulary lie in cells: the number of their letters in each of
``CLASSES`` classes of letters, so a cell holds words of one length. One edit
moves one letter from a class to another (a neighbouring cell of the length) or
adds one (a neighbouring cell of the next length); all other pairs of cells are
left out. A cell is dealt into blocks of bounded size, and a task gets two blocks
of neighbouring cells: a NumPy product of their letter-count matrices gives the
squared distances of all their words. An edit changes the counts by a squared
distance of 1 (a letter more) or 2 (one replaced), so pairs at most two apart
stay, and their code points are compared.

Near pairs then give each word its form, and forms are followed to the root by
pointer jumping: every form has at least twice its word's count, so a chain has
at most 63 links and takes at most 7 rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import partitions
from airlens.session import ensure_checkpoint_dir

RUN = "[A-Za-zÀ-ÿ]+"
CUT = 97                  # one run of so many loses a letter
LENGTH = 5
COUNT = 3
RATIO = 2                 # a form occurs so many times as often as its word
CLASSES = 4
PIECE = 4096              # letters of a row of words
BLOCK = 16                # rows of a block
ROWS = 1024               # words on one side of a product at a time
LETTERS = 26 + 64

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_counts(docs: DataFrame, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(word, n): the words of all texts, A-Z lowered, some with a letter deleted by their hash.

    Counts are aggregated before the shuffle. A null text has no words, a null
    doc_id is hashed as an empty one, repeated rows count each time.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
                       F.explode(F.regexp_extract_all(F.col("text"), F.lit(RUN), F.lit(0))).alias("run"))
    low = runs.select("d", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    h = low.select("run", F.crc32(F.concat("d", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = h.select(F.when(F.col("h") % CUT == 0, cut).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= count))


def letter_classes(words: DataFrame) -> list[str]:
    """The letters in ``CLASSES`` classes of about equal weight; only the speed depends on them.

    At most ``LETTERS`` counts reach the driver.
    """
    per = (words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''")
           .groupBy("c").count().collect())
    out, weight = [""] * CLASSES, [0] * CLASSES
    for r in sorted(per, key=lambda r: (-r["count"], r["c"])):
        i = weight.index(min(weight))
        out[i] += r["c"]
        weight[i] += r["count"]
    return out


def _name(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def _neighbours(cells: DataFrame) -> DataFrame:
    """(cell, other, m, side): its neighbouring cells, their blocks, and on which side it lies of them."""
    c = [F.col(f"c{i}") for i in range(CLASSES)]
    steps = [({}, 0)]
    for i in range(CLASSES):
        steps += [({i: 1}, 0), ({i: -1}, 1)]
        for j in range(i + 1, CLASSES):
            steps += [({i: 1, j: -1}, 0), ({i: -1, j: 1}, 1)]
    other = F.explode(F.array(*[F.struct(
        _name([c[k] + d.get(k, 0) for k in range(CLASSES)]).alias("other"), F.lit(side).alias("side"))
        for d, side in steps]))
    n = cells.select("cell", other.alias("o")).select("cell", "o.*")
    return n.join(cells.select(F.col("cell").alias("other"), "m"), "other")


def block_pairs(words: DataFrame) -> DataFrame:
    """Rows of words (pair, same, side, words, ns), dealt and sorted by pairs of blocks of neighbouring cells."""
    groups = letter_classes(words)
    counts = {f"c{i}": F.length("word") - F.length(F.translate("word", g, "")) if g else F.lit(0)
              for i, g in enumerate(groups)}
    w = words.select("word", "n", F.length("word").alias("len"), *[v.alias(k) for k, v in counts.items()])
    w = w.withColumn("cell", _name([F.col(k) for k in counts]))
    per = F.greatest(F.floor(F.lit(PIECE) / F.first("len")), F.lit(1))
    cells = w.groupBy("cell", *counts).agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias("rows"))
    cells = cells.withColumn("m", F.ceil(F.col("rows") / BLOCK).cast("int")).checkpoint()
    pieces = (w.join(cells.select("cell", "rows"), "cell")
              .groupBy("cell", F.pmod(F.xxhash64("word"), F.col("rows")).cast("int").alias("piece"))
              .agg(F.collect_list(F.struct("word", "n")).alias("ws")))
    pieces = pieces.select("cell", F.floor(F.col("piece") / BLOCK).cast("int").alias("i"),
                           F.col("ws.word").alias("words"), F.col("ws.n").alias("ns"))
    both = (pieces.join(_neighbours(cells), "cell")
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
            .withColumn("same", F.col("cell") == F.col("other"))
            .withColumn("side", F.when(F.col("same"), (F.col("i") > F.col("j")).cast("int")).otherwise(F.col("side"))))
    here, there = F.struct("cell", "i"), F.struct(F.col("other").alias("cell"), F.col("j").alias("i"))
    first = F.when(F.col("side") == 0, here).otherwise(there)
    last = F.when(F.col("side") == 0, there).otherwise(here)
    pair = F.concat_ws("|", first["cell"], first["i"].cast("string"), last["cell"], last["i"].cast("string"))
    return (both.select(pair.alias("pair"), (F.col("same") & (F.col("i") == F.col("j"))).alias("same"), "side",
                        "words", "ns")
            .repartition(partitions(words.sparkSession), "pair").sortWithinPartitions("pair"))


def _points(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _letter_counts(points: np.ndarray) -> np.ndarray:
    at = np.where(points >= 0xC0, points.astype(np.int64) - 0xC0 + 26, points.astype(np.int64) - ord("a"))
    n = len(points)
    at += np.arange(n)[:, None] * LETTERS
    out = np.bincount(at.ravel(), minlength=n * LETTERS).reshape(n, LETTERS)
    # up to this length the products are whole numbers that a float32 holds
    return out.astype(np.float32 if points.shape[1] < 2000 else np.float64)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: whether b is a with exactly one code point replaced, or inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    before = np.logical_and.accumulate(a == b[:, :n], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return before + behind >= n


def near_pairs(a: list[str], b: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the words one edit apart; a's words are of one length, b's too."""
    pa_, pb = _points(a), _points(b)
    x, y = _letter_counts(pa_), _letter_counts(pb)
    # |x - y|^2 = |x|^2 + |y|^2 - 2 xy as one product
    one = np.ones((len(x), 1), x.dtype)
    left = np.hstack([x, (x * x).sum(axis=1, keepdims=True), one])
    right = np.hstack([-2 * y, np.ones((len(y), 1), y.dtype), (y * y).sum(axis=1, keepdims=True)]).T
    most = max(1, (1 << 22) // pa_.shape[1])
    i_out, j_out = [], []
    for lo in range(0, len(a), ROWS):
        for at in range(lo if same else 0, len(b), ROWS):
            d = left[lo:lo + ROWS] @ right[:, at:at + ROWS]
            hit = np.flatnonzero((d < 2.5).ravel())
            hit = hit[d.ravel()[hit] > 0.5]
            i, j = lo + hit // d.shape[1], at + hit % d.shape[1]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), most):
                u, v = i[k:k + most], j[k:k + most]
                ok = one_edit(pa_[u], pb[v])
                i_out.append(u[ok])
                j_out.append(v[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *i_out]), np.concatenate([none, *j_out])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, na, b, nb) of the near words of every pair of blocks; a pair's rows follow one another."""
    pair, words, ns, same = None, ([], []), ([], []), False

    def found():
        i, j = near_pairs(words[0], words[0] if same else words[1], same)
        o = 0 if same else 1
        return pa.RecordBatch.from_arrays(
            [pa.array([words[0][k] for k in i], pa.string()), pa.array([ns[0][k] for k in i], pa.int64()),
             pa.array([words[o][k] for k in j], pa.string()), pa.array([ns[o][k] for k in j], pa.int64())],
            names=["a", "na", "b", "nb"])

    for batch in batches:
        for p, s, side, w, n in zip(*(batch.column(c).to_pylist() for c in ("pair", "same", "side")),
                                    batch.column("words"), batch.column("ns"), strict=True):
            if p != pair:
                if words[0] and (same or words[1]):
                    yield found()
                pair, same, words, ns = p, s, ([], []), ([], [])
            words[side].extend(w.as_py())
            ns[side].extend(n.as_py())
    if words[0] and (same or words[1]):
        yield found()


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) of a-z and À-ÿ.

    Words are distinct and not empty. The form is the near word of largest n
    (ties: smallest), if that is ``RATIO`` times the word's n or more. A word
    without near words has n_near 0 and is its own root; an empty vocabulary
    gives no rows.
    """
    ensure_checkpoint_dir(words.sparkSession)
    words = words.select("word", "n").checkpoint()
    pairs = block_pairs(words).mapInArrow(_near, "a string, na long, b string, nb long")
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("o"), "near")).alias("b"))
    enough = -F.col("b.o") >= RATIO * F.col("n")
    out = (words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.o")).alias("form_n")).checkpoint())
    roots = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(up, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")).checkpoint()
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return (out.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def query(docs: DataFrame) -> DataFrame:
    """Spelling variants of the words of all texts; an empty table, and one of null texts, gives no rows."""
    return group_variants(word_counts(docs))
