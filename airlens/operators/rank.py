"""Positional ranking (R1-R7): ``sort_values(...).iloc[p]`` as Spark plans.

Semantics (the only place they live):

* A frame is sorted by its keys; each key ascending or descending, NULL
  (pandas NaN) always **last** in the sorted list, as pandas does.
* Ties are broken by the remaining keys (callers pass the output label last),
  so the result is deterministic.
* Position ``p >= 0`` is the p-th row of that list, ``p < 0`` counts from its
  end (``-1`` is the last row, ``len(df)-k`` is written ``-k``). Positions past
  the end give no row.

Plan: one ``ORDER BY ... LIMIT k`` per direction, which Spark runs as
``TakeOrderedAndProject`` -- a per-partition top-k followed by a merge of at
most k rows per partition. No global sort, no single-partition window over
the input; the row numbering runs on the k survivors only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = tuple  # (column name, ascending: bool)


def _fwd(keys: Sequence[Key]) -> list[Column]:
    return [F.col(c).asc_nulls_last() if a else F.col(c).desc_nulls_last() for c, a in keys]


def _rev(keys: Sequence[Key]) -> list[Column]:
    return [F.col(c).desc_nulls_first() if a else F.col(c).asc_nulls_first() for c, a in keys]


def nth(df: DataFrame, keys: Sequence[Key], positions: Sequence[int],
        out: Sequence[str | Column]) -> DataFrame:
    """Rows at ``positions`` of ``df`` sorted by ``keys``; adds column ``pos``."""
    parts = []
    fwd = sorted({p for p in positions if p >= 0})
    bwd = sorted({-p for p in positions if p < 0})
    for wanted, order, sign in ((fwd, _fwd(keys), 1), (bwd, _rev(keys), -1)):
        if not wanted:
            continue
        k = max(wanted) + (1 if sign > 0 else 0)
        top = df.orderBy(*order).limit(k)
        rn = F.row_number().over(Window.orderBy(*order))
        idx = (rn - 1) if sign > 0 else -rn
        top = top.withColumn("pos", idx.cast("int"))
        wanted_pos = [w if sign > 0 else -w for w in wanted]
        parts.append(top.where(F.col("pos").isin(wanted_pos)).select("pos", *out))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def nth_of_counts(df: DataFrame, keys: Sequence[Key], positions: Sequence[int],
                  out: Sequence[str | Column], times: str | None = None) -> DataFrame:
    """``nth`` where rows alike in ``keys`` are interchangeable: they are counted
    first (map-side, then by one shuffle that both directions read), so ``df`` is
    read once. The ends of a ranking need at most as many counts as positions; a
    count stands for that many places. ``times``: a column of counts that ``df``
    already has. ``out`` uses the columns of ``keys``."""
    names = [c for c, _ in keys]
    n = F.count(F.lit(1)) if times is None else F.sum(times)
    counts = df.groupBy(*names).agg(n.alias("times"))
    parts = []
    for wanted, order, forward in ((sorted({p for p in positions if p >= 0}), _fwd(keys), True),
                                   (sorted({-p for p in positions if p < 0}), _rev(keys), False)):
        if not wanted:
            continue
        top = counts.orderBy(*order).limit(max(wanted) + forward)
        end = F.sum("times").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        # places from this end, counted from 0 forward and from 1 backward
        places = F.array(*[F.lit(w) for w in wanted])
        first = F.col("end") - F.col("times") + (0 if forward else 1)
        top = top.withColumn("end", end).withColumn("place", F.explode(F.filter(
            places, lambda w: (w >= first) & (w < first + F.col("times")))))
        parts.append(top.select((F.col("place") if forward else -F.col("place")).cast("int").alias("pos"), *out))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def top_k(df: DataFrame, keys: Sequence[Key], k: int) -> DataFrame:
    """``sort_values(...).head(k)`` -- the first k rows of the sorted list."""
    return df.orderBy(*_fwd(keys)).limit(k)


# --- SQL forms for the DuckDB oracle -----------------------------------------

def _sql_order(keys: Sequence[Key], reverse: bool) -> str:
    items = []
    for c, a in keys:
        if not reverse:
            items.append(f"{c} {'asc' if a else 'desc'} nulls last")
        else:
            items.append(f"{c} {'desc' if a else 'asc'} nulls first")
    return ", ".join(items)


def sql_nth(base: str, keys: Sequence[Key], positions: Sequence[int], out: Sequence[str]) -> str:
    """The same selection in SQL, written with ``row_number`` (oracle only)."""
    cols = ", ".join(out)
    parts = []
    fwd = sorted({p for p in positions if p >= 0})
    bwd = sorted({-p for p in positions if p < 0})
    if fwd:
        parts.append(
            f"select cast(rn - 1 as integer) as pos, {cols} from (select *, row_number() over "
            f"(order by {_sql_order(keys, False)}) as rn from ({base}) b0) f "
            f"where rn - 1 in ({', '.join(map(str, fwd))})")
    if bwd:
        parts.append(
            f"select cast(-rn as integer) as pos, {cols} from (select *, row_number() over "
            f"(order by {_sql_order(keys, True)}) as rn from ({base}) b1) r "
            f"where rn in ({', '.join(map(str, bwd))})")
    return "\nunion all\n".join(parts)


def sql_top_k(base: str, keys: Sequence[Key], k: int) -> str:
    return f"select * from ({base}) tk order by {_sql_order(keys, False)} limit {k}"
