"""Registry of every implemented query, keyed by its SURVEY section 2 id.

Each entry is a Spark builder ``(Tables) -> DataFrame`` and, where the
computation is expressible in SQL, the DuckDB oracle text. Fixture views
(readings, states, funding, samples) are prefixed to the oracle as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from airlens.sources.fixture_sql import with_views
from airlens.sources.tables import Tables, tables


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    views: tuple[str, ...] = ("readings", "states", "funding")

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return with_views(self.sql, *self.views)


def _catalog() -> dict[str, Entry]:
    from airlens.operators import catalog as c
    out = {}
    for n in c.TEMPLATE_IDS:
        fn = getattr(c, f"t{n}")
        sql = getattr(c, f"t{n}_sql")()
        out[f"T{n}"] = Entry(fn, sql)
    return out


def _modules() -> list[dict[str, Entry]]:
    regs = [_catalog()]
    from airlens.operators import (blocks, bulletins, changes, corpus, evaluation, examples, lattice, relational, sketches,
                                   temporal)
    from airlens.sources import files
    from airlens.streaming import incremental
    for mod in (examples, evaluation, corpus, bulletins, relational, blocks, files, incremental,
                temporal, lattice, changes, sketches):
        regs.append(mod.registry())
    return regs


_REGISTRY: dict[str, Entry] | None = None


def registry() -> dict[str, Entry]:
    global _REGISTRY
    if _REGISTRY is None:
        reg: dict[str, Entry] = {}
        for part in _modules():
            dup = set(reg) & set(part)
            assert not dup, dup
            reg.update(part)
        _REGISTRY = reg
    return _REGISTRY


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(e: Entry):
        return lambda spark, sf_dir: e.build(tables(spark, sf_dir))
    return {k: bind(e) for k, e in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.oracle() for k, e in registry().items() if e.sql is not None}
