"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from airlens.llm import (binary, chat, decontaminate, jaccard, langid, lm, mixing, neighbours, periods,
                         secrets, sharding, spelling, tokens)
from airlens.llm.common import ship

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _over(name: str, run: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: run(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_secret_ledger": _over("documents", secrets.query),
        "op2_virtual_slots": _over("documents", sharding.assign),
        "op3_token_store": _over("documents", binary.query),
        "op4_jaccard_tiles": _over("documents", jaccard.join_documents),
        "op5_gru_scores": _over("documents", lm.score_documents),
        "op6_pivotal_mix": _over("documents", mixing.query),
        "op7_multi_index_hashing": _over("embeddings", neighbours.search),
        "op8_winnowing": lambda spark, sf_dir: decontaminate.decontaminate(
            table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op9_token_counts": _over("documents", tokens.count_tokens),
        "op10_language": _over("documents", langid.identify),
        "op11_periodic_runs": _over("documents", periods.query),
        "op12_chat_format": _over("conversations", chat.query),
        "op13_spelling_variants": _over("documents", spelling.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_ledger": secrets.ORACLE, "op8_winnowing": decontaminate.ORACLE,
            "op12_chat_format": chat.ORACLE}
