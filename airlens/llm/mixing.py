"""Operator 6: mixing sources to target weights by pivotal dependent rounding.

Each source's target words over its words give the same expected number of
copies q for all its documents: floor(q) copies for sure, and one more with
probability p. (Rows alike in doc_id, source and text are one unit with n q copies.) Pivotal rounding settles the p's: two documents meet, probability
mass (in words) moves from one to the other, in a direction drawn so that
neither is favoured, until one of them is 0 or 1; the other goes on. The words
taken by a pair never change, so a source's total ends within half of one
document of its target.

The pairing is a reduction tree: documents are hashed into blocks of about
``BLOCK``, a block is folded by ``aggregate`` into one unsettled document, and
the survivors of all blocks meet in the next level, until one is left per
source. All of it is DataFrame functions; a source that holds most rows has
correspondingly many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm.common import copies, unused
from airlens.session import ensure_checkpoint_dir

BLOCK = 128
WORD = r"[^\x20\x09-\x0D]+"
CAP = 3


def units(docs: DataFrame) -> DataFrame:
    """Rows alike in doc_id, source and text are one unit with their number."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("h"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"))
    return rows.groupBy("doc_id", "source", "h", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(u: DataFrame) -> DataFrame:
    """One row per source: its words and its target.

    Sources in code point order (null last) weigh 1, 2, 3, repeating, and share
    all words by weight, at most ``CAP`` times their own. With sources sorted by
    cap / weight, the share per weight is the largest value of (words left) /
    (weight left) along that order, so resharing needs no loop. The windows run
    over one row per source.
    """
    per = u.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("units"))
    w = ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    per = per.withColumn("w", w).withColumn("cap", (F.col("source_size") * CAP).cast("double"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("lam", (
        F.sum("source_size").over(whole)
        - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    lam = F.max("lam").over(whole)
    return per.select("source", "source_size", "units",
                      F.least(F.col("cap"), F.col("w") * lam).alias("target"))


def _draw(level: int, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "h", F.lit(level), F.lit(seed)), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def _meet(acc: Column, e: Column) -> Column:
    """Fold one document into the unsettled one; the settled one joins ``done``."""
    i = acc["c"]
    pi, si, pj, sj = i["p"], i["mass"], e["p"], e["mass"]
    room_i, room_j, has_i, has_j = (1 - pi) * si, (1 - pj) * sj, pi * si, pj * sj
    to_i, to_j = F.least(room_i, has_j), F.least(room_j, has_i)
    settled = (pi <= 0) | (pi >= 1)
    towards_i = e["draw"] * (to_i + to_j) < to_j
    new_i = (F.when(settled, pi)
             .when(towards_i, F.when(room_i <= has_j, 1.0).otherwise(pi + has_j / si))
             .otherwise(F.when(has_i <= room_j, 0.0).otherwise(pi - room_j / si)))
    new_j = (F.when(settled, pj)
             .when(towards_i, F.when(has_j <= room_i, 0.0).otherwise(pj - room_i / sj))
             .otherwise(F.when(room_j <= has_i, 1.0).otherwise(pj + has_i / sj)))
    i_out = settled | F.when(towards_i, room_i <= has_j).otherwise(has_i <= room_j)
    one, two = i.withField("p", new_i), e.withField("p", new_j)
    return F.struct(F.when(i_out, two).otherwise(one).alias("c"),
                    F.concat(acc["done"], F.array(F.when(i_out, one).otherwise(two))).alias("done"))


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 6) -> DataFrame:
    """One row per document (rows alike: one, with their number n): source, size, source_size, target, copies, taken.

    The number of levels follows from the largest source's number of documents.
    What each level settles is written to the shared checkpoint folder. The one
    document left per source is rounded to the nearer side. Draws are hashes of
    doc_id, text and level, so reruns agree. A null source is a source of its
    own (last in order); a null or empty text, and a source without words, take
    nothing; n rows alike get n times the copies for sure, and one fraction is
    rounded for all of them; an empty table gives no rows;
    other columns are not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    u = units(docs).checkpoint()
    src = targets(u).checkpoint()
    s = src.withColumnRenamed("source", "s0")
    q = F.col("target") / F.col("source_size")
    r = (u.join(s, F.col("source").eqNullSafe(F.col("s0"))).drop("s0")
         .withColumn("q", F.col("n") * q)              # copies of the unit
         .withColumn("base", F.when(F.col("size") > 0, F.floor(F.col("q") + 1e-12)).otherwise(0))
         .withColumn("p", F.when(F.col("size") > 0, F.greatest(F.col("q") - F.col("base"), F.lit(0.0)))
                     .otherwise(0.0))
         .withColumn("p", F.when(F.col("p") < 1e-9, 0.0).otherwise(F.col("p")))
         .withColumn("mass", F.col("size").cast("double")))
    keep = ["doc_id", "source", "h", "size", "n", "source_size", "target", "base", "p"]
    parts = [r.filter("p <= 0").select(*keep)]
    left = r.filter("p > 0")
    most = src.agg(F.max("units")).first()[0] or 0
    level, scale = 0, 1
    while True:
        scale *= block
        fields = ["mass", "doc_id", "h", "size", "n", "source_size", "target", "units", "base", "p",
                  "draw"]
        # the largest meet first, so that what stays unsettled tends to be small
        e = left.withColumn("draw", _draw(level, seed)).select(
            "source", F.pmod(F.xxhash64("doc_id", "h", F.lit(level + 101)),
                             F.ceil(F.col("units") / scale)).alias("block"),
            F.struct((-F.col("mass")).alias("order"), *fields).alias("e"))
        g = e.groupBy("source", "block").agg(F.sort_array(F.collect_list("e")).alias("es"))
        none = F.slice("es", 1, 0)
        folded = F.aggregate(
            F.slice("es", 2, F.size("es")),
            F.struct(F.get("es", F.lit(0)).alias("c"), none.alias("done")), _meet)
        g = g.select("source", folded.alias("f")).checkpoint()
        parts.append(g.select("source", F.explode("f.done").alias("e"))
                     .select("source", "e.*").select(*keep))
        left = g.select("source", "f.c.*")
        level += 1
        if scale >= most:
            break
    parts.append(left.withColumn("p", F.round("p")).select(*keep))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionAll(x)
    total = (F.col("base") + F.col("p")).cast("long")
    return out.select("doc_id", "source", "h", "size", "source_size", "target", "n",
                      total.alias("copies"), (total * F.col("size")).alias("taken"))


def documents_taken(docs: DataFrame) -> DataFrame:
    """``docs``, each row as often as the mix takes it.

    Other columns are kept and may have any names; rows alike in doc_id, source and
    text are repeated as one of them.
    """
    c_id, c_source, c_h, c_n, c_times, c_copy = unused(docs, "id", "source_of", "h", "n", "times", "copy")
    m = mix(docs).filter("copies > 0").select(
        F.col("doc_id").alias(c_id), F.col("source").alias(c_source), F.col("h").alias(c_h),
        F.col("n").alias(c_n), F.col("copies").alias(c_times))
    # an inner join on the whole unit; the small side is the one without texts
    on = (docs["doc_id"].eqNullSafe(F.col(c_id)) & docs["source"].eqNullSafe(F.col(c_source))
          & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(c_h)))
    once = docs.join(m.filter(F.col(c_n) == 1).hint("shuffle_hash"), on)
    alike = docs.join(m.filter(F.col(c_n) > 1).hint("shuffle_hash"), on).dropDuplicates([c_id, c_source, c_h])
    out = (once.withColumn(c_copy, F.explode(F.sequence(F.lit(1), F.col(c_times).cast("int")))).drop(c_copy)
           .unionAll(copies(alike, c_times, c_copy).drop(c_copy)))
    return out.drop(c_id, c_source, c_h, c_n, c_times)


def query(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``; a unit's copies are dealt to its rows as evenly as can be."""
    rows = copies(mix(docs), "n", "row")
    own = F.floor(F.col("copies") / F.col("n")) + (F.col("row") < F.col("copies") % F.col("n")).cast("long")
    return (rows.withColumn("copies", own)
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"),
                    "source", "copies"))
