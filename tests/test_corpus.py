"""C1/C2 on literal templates; C5 ordinal split on a small frame."""

from pyspark.sql import functions as F

from airlens.operators import corpus as c
from airlens.operators.relational import with_ordinal


def test_expand_and_lint(spark):
    tmpl = spark.createDataFrame(
        [(1, "Which {location} had the {stats} value?", "loc={code_location}; pos={code_stats}"),
         (2, "Odd {a} and {b}", "{a}{b}")],
        "template_id int, question string, code string")
    vals = spark.createDataFrame(
        [(1, "location", "code_location", 0, "state", "state"),
         (1, "location", "code_location", 1, "city", "city"),
         (1, "location", "code_location", 2, "station", "station"),
         (1, "stats", "code_stats", 0, "highest", "-1"), (1, "stats", "code_stats", 1, "lowest", "0"),
         (2, "a", "c", 0, "x", "1"), (2, "a", "c", 1, "y", None)],
        "template_id int, var string, code_var string, idx int, q_value string, c_value string")
    out = c.expand_template(tmpl.where("template_id = 1"), vals.where("template_id = 1"))
    rows = out.collect()
    assert len(rows) == 6
    assert {r["question"] for r in rows} >= {"Which city had the lowest value?"}
    assert {r["code"] for r in rows} >= {"loc=station; pos=-1"}
    assert not any("{" in r["question"] + r["code"] for r in rows)
    lint = {r["template_id"]: r for r in c.lint_templates(tmpl, vals).collect()}
    assert lint[1]["unequal_lists"] == [] and lint[1]["undeclared"] == []
    assert lint[2]["unequal_lists"] == ["a"] and lint[2]["undeclared"] == ["b"]
    assert lint[1]["code_undeclared"] == [] and lint[1]["code_unused"] == []
    assert lint[2]["code_undeclared"] == ["a", "b"] and lint[2]["code_unused"] == ["c"]


def test_ordinal_and_split(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "k").repartition(7)
    o = with_ordinal(df, "k").collect()
    assert sorted(r["ordinal"] for r in o) == list(range(len(o)))
    assert all(r["ordinal"] == r["k"] // 3 for r in o)
    s = c.ordered_split(df, "k", 0.9)
    n = df.count()
    train = s.where("split = 'train'").agg(F.max("k")).first()[0]
    assert s.where("split = 'train'").count() == int(n * 0.9)
    assert s.where("split = 'validation'").agg(F.min("k")).first()[0] > train
