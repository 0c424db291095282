from collections import Counter

import duckdb
import pytest

import __spark_entry__ as se
from airlens.llm import queries as Q
from tests.conftest import SF_SMALL
from tests.llm import helpers as H
from tests.llm.test_neighbours import SCHEMA

COLUMNS = {
    "op1": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op2": "doc_id size text_crc32 law shard slot grown_shard",
    "op3": "doc_id start n_tokens ids_crc32",
    "op4": "doc_id n_shingles component_id",
    "op5": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6": "doc_id size source_size target taken",
    "op7": "query_id rank vec_id score",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id n_bytes n_tokens over_limit",
    "op10": "doc_id held_out lang_pred score",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op13": "word form root n n_near form_n"}


def test_one_query_of_each_operator_and_the_pipeline():
    names = list(se.queries())
    for op in COLUMNS:
        assert len([n for n in names if n.startswith(op + "_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("kind", ["awkward", "empty"])
def test_every_query_on_awkward_and_empty_tables(spark, tmp_path, kind):
    docs = H.awkward(spark) if kind == "awkward" else H.empty(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench = spark.createDataFrame([(1, "one two three"), (None, None)], "item_id long, text string")
    (bench if kind == "awkward" else bench.limit(0)).write.parquet(f"{tmp_path}/benchmark.parquet")
    vec = spark.createDataFrame([(0, [1.0, 0.0], 1, "r", 0.5), (None, None, None, None, None),
                                 (7, [0.5, None], 1, None, None), (9, [0.5, 0.5], 1, None, None)], SCHEMA)
    (vec if kind == "awkward" else vec.limit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    chats = spark.createDataFrame([(1, 0, "user", "hi", 2.0), (None, None, None, None, None)],
                                  "conv_id long, turn long, role string, text string, body double")
    (chats if kind == "awkward" else chats.limit(0)).write.parquet(f"{tmp_path}/conversations.parquet")
    for name, build in Q.queries().items():
        df = build(spark, str(tmp_path))
        assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns), name
        n = df.count()
        if name.startswith("op7_"):
            assert n == (1 if kind == "awkward" else 0)
        elif name.startswith("op12_"):
            assert n == (3 if kind == "awkward" else 1)      # conversation -1 too
        elif name.startswith("op13_"):
            assert (n > 0) == (kind == "awkward")
        else:
            assert n == (len(H.awkward_rows()) if kind == "awkward" else 0), name


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.sql(Q.oracle_sql()[name])
    got = Q.queries()[name](spark, SF_SMALL)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(tuple(str(r[c]) for c in cols) for r in got.collect()) == Counter(
        tuple(str(r[want.columns.index(c)]) for c in cols) for r in want.fetchall())
