"""Evaluation analytics (E1-E22): from generated samples to model comparison.

Inputs are tables, not files: ``samples`` (one graded row per generated
sample), ``runs`` (captured exit code / log / gold answer per sample) and
``conversations`` (generated text). Plans: question metrics are one
``groupBy(model, question_id)`` with partial aggregation; category and model
summaries aggregate those again (tiny); comparisons join per-model summaries
whose size is bounded by the number of categories / error types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.functions.arith import rnd
from airlens.functions.stats import sem
from airlens.functions.text import (ERROR_CLASSES, SQL_ERROR_CLASS, answer_match, clean_sample,
                                    error_class, parse_run, pass_at_k, sql_answer_match,
                                    sql_clean_sample, sql_parse_run, sql_pass_at_k)
from airlens.plans.registry import Entry

SAMPLE_SIZE = 5
METRICS = ("pass_at_1", "pass_at_2", "exec_at_1")


# --- E1: sample cleanup ------------------------------------------------------

def wrapped_samples(t) -> DataFrame:
    """Generated texts: each conversation turn wrapped in one of the shapes a
    model emits, chosen by ``turn % 4`` (think + fenced code, code tags,
    open think, bare fence)."""
    c = t.conversations
    txt = F.col("text")
    nl = "\n"
    shape = F.col("turn") % 4
    raw = (F.when(shape == 0, F.concat(F.lit("<think>plan</think>```python" + nl), txt,
                                       F.lit(nl + "``` trailing words")))
           .when(shape == 1, F.concat(F.lit("<code>"), txt, F.lit("</code> explanation")))
           .when(shape == 2, F.concat(F.lit("<think>"), txt))
           .otherwise(F.concat(txt, F.lit(nl + "```" + nl + "rest"))))
    return c.select("conv_id", "turn", raw.alias("raw"))


SQL_WRAPPED = ("select conv_id, turn, case turn % 4 "
               "when 0 then '<think>plan</think>```python' || chr(10) || text || chr(10) || '``` trailing words' "
               "when 1 then '<code>' || text || '</code> explanation' "
               "when 2 then '<think>' || text "
               "else text || chr(10) || '```' || chr(10) || 'rest' end as raw from conversations")


def e1(t):
    """Cleaned program text of every generated sample."""
    w = wrapped_samples(t)
    return w.select("conv_id", "turn", clean_sample(F.col("raw")).alias("code"))


E1_SQL = f"select conv_id, turn, {sql_clean_sample('raw')} as code from ({SQL_WRAPPED}) w"


# --- E2: first five samples --------------------------------------------------

def e2(t, n=SAMPLE_SIZE):
    """The first n generated samples of each conversation, one row each
    (``generated_samples[:5]`` exploded). A row-number window per conversation
    -- no array of a whole group is built."""
    c = t.conversations.where(F.col("role") == "assistant")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (c.select("conv_id", "turn", "text", F.row_number().over(w).alias("rn"))
            .where(F.col("rn") <= n)
            .select("conv_id", (F.col("rn") - 1).cast("int").alias("sample_idx"),
                    F.length("text").cast("bigint").alias("n_chars")))


E2_SQL = ("select conv_id, cast(rn - 1 as integer) as sample_idx, length(text) as n_chars from "
          "(select conv_id, text, row_number() over (partition by conv_id order by turn) as rn "
          "from conversations where role = 'assistant') c where rn <= 5")


# --- E3-E5: grading captured runs --------------------------------------------

def graded_runs(t) -> DataFrame:
    r = t.runs
    p = parse_run(F.col("exit_code"), F.col("timed_out"), F.col("log"))
    return r.select("question_id", "sample_idx", "answer", p.alias("p")).select(
        "question_id", "sample_idx", "answer", "p.*")


def _sql_graded_runs() -> str:
    p = sql_parse_run("exit_code", "timed_out", "log")
    return (f"select question_id, sample_idx, answer, {p['executed']} as executed, "
            f"{p['passed']} as passed, {p['output']} as output, {p['error_type']} as error_type "
            f"from runs")


def e3(t):
    """Executed flag, pass flag and printed output parsed from each log."""
    return graded_runs(t).select("question_id", "sample_idx", "executed", "passed", "output")


E3_SQL = (f"select question_id, sample_idx, executed, passed, output from ({_sql_graded_runs()}) g")


def e4(t):
    """Error type per failed run, counted."""
    g = graded_runs(t).where(F.col("error_type").isNotNull())
    return g.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


E4_SQL = (f"select error_type, count(*) as n from ({_sql_graded_runs()}) g "
          f"where error_type is not null group by error_type")


def e5(t):
    """E5: does the printed output match the gold answer (isclose or equal)?"""
    g = graded_runs(t)
    m = answer_match(F.col("output"), F.col("answer"))
    return g.select("question_id", "sample_idx", m.alias("matched"))


E5_SQL = (f"select question_id, sample_idx, {sql_answer_match('output', 'answer')} as matched "
          f"from ({_sql_graded_runs()}) g")


# --- E6-E8: per-question metrics ---------------------------------------------

def question_metrics(samples: DataFrame) -> DataFrame:
    """pass@1, pass@2 and exec@1 per (model, question); ``n`` samples and
    ``n_err`` failures ride along so sample-grain summaries can be computed
    from this (pre-aggregated) table."""
    q = samples.groupBy("model", "category", "question_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("passed").cast("int")).alias("c"),
        F.avg(F.col("executed").cast("double")).alias("exec_at_1"),
        F.count("error_type").alias("n_err"))
    return q.select("model", "category", "question_id", "n", "c",
                    pass_at_k(F.col("n"), F.col("c"), 1).alias("pass_at_1"),
                    pass_at_k(F.col("n"), F.col("c"), 2).alias("pass_at_2"),
                    "exec_at_1", "n_err")


def _w_mean(x: str):
    """Mean over sample rows of a per-question value (each question weighs n)."""
    return F.sum(F.col("n") * F.col(x)) / F.sum("n")


def _w_sem(x: str):
    """SEM over sample rows of a per-question value repeated n times:
    sqrt(var_samp / N) from weighted sums (NULL for N = 1)."""
    n = F.sum("n")
    s1 = F.sum(F.col("n") * F.col(x))
    s2 = F.sum(F.col("n") * F.col(x) * F.col(x))
    var = F.greatest(F.lit(0.0), (s2 - s1 * s1 / n)) / (n - 1)
    return F.when(n > 1, F.sqrt(var / n))


SQL_QUESTION_METRICS = (
    "select model, category, question_id, n, c, "
    f"{sql_pass_at_k('n', 'c', 1)} as pass_at_1, {sql_pass_at_k('n', 'c', 2)} as pass_at_2, "
    "exec_at_1 from (select model, category, question_id, count(*) as n, "
    "cast(sum(cast(passed as integer)) as bigint) as c, avg(cast(executed as double)) as exec_at_1 "
    "from samples group by model, category, question_id) q")


def e6(t):
    """pass@k per question."""
    q = question_metrics(t.samples)
    return q.select("model", "question_id", "n", "c", rnd(F.col("pass_at_1"), 9).alias("pass_at_1"),
                    rnd(F.col("pass_at_2"), 9).alias("pass_at_2"))


E6_SQL = ("select model, question_id, n, c, round(pass_at_1, 9) as pass_at_1, "
          f"round(pass_at_2, 9) as pass_at_2 from ({SQL_QUESTION_METRICS}) q")


def e7(t):
    """exec@1 per question."""
    q = question_metrics(t.samples)
    return q.select("model", "question_id", rnd(F.col("exec_at_1"), 9).alias("exec_at_1"))


E7_SQL = f"select model, question_id, round(exec_at_1, 9) as exec_at_1 from ({SQL_QUESTION_METRICS}) q"


def sample_metrics(samples: DataFrame) -> DataFrame:
    """Question metrics repeated on each of its sample rows.

    The metrics are aggregated first (partial aggregation), then joined back
    on (model, question): a question holding a large share of the rows is a
    skewed join key that AQE splits, where a window would put it in one task.
    """
    q = question_metrics(samples).select("model", "question_id", *METRICS)
    s = samples.select("model", "category", "question_id", "sample_idx", "executed", "passed",
                       "error_type")
    return s.join(q, ["model", "question_id"])


SQL_SAMPLE_METRICS = (
    "select s.model, s.category, s.question_id, s.sample_idx, s.executed, s.passed, s.error_type, "
    "q.pass_at_1, q.pass_at_2, q.exec_at_1 from samples s join "
    f"({SQL_QUESTION_METRICS}) q on s.model = q.model and s.question_id = q.question_id")


def e8(t):
    """Sample rows carrying their question's metrics."""
    m = sample_metrics(t.samples)
    return m.select("model", "question_id", "sample_idx", *[rnd(F.col(x), 9).alias(x) for x in METRICS])


E8_SQL = (f"select model, question_id, sample_idx, "
          + ", ".join(f"round({x}, 9) as {x}" for x in METRICS)
          + f" from ({SQL_SAMPLE_METRICS}) m")


# --- E9-E13: category and error summaries --------------------------------------

def e9(t):
    """Category means of pass@1, pass@2, exec@1 at sample grain (as the
    reference: each question weighs its number of samples), computed from
    the per-question aggregate -- raw samples are shuffled only once."""
    q = question_metrics(t.samples)
    return q.groupBy("model", "category").agg(
        *[rnd(_w_mean(x), 9).alias(f"mean_{x}") for x in METRICS])


E9_SQL = ("select model, category, "
          + ", ".join(f"round(avg({x}), 9) as mean_{x}" for x in METRICS)
          + f" from ({SQL_SAMPLE_METRICS}) m group by model, category")


def e10(t):
    """Category SEM (std ddof 1 / sqrt n) at sample and question grain."""
    q = question_metrics(t.samples)
    by_sample = q.groupBy("model", "category").agg(
        *[rnd(_w_sem(x), 9).alias(f"sem_{x}") for x in METRICS]).withColumn("grain", F.lit("sample"))
    by_q = q.groupBy("model", "category").agg(
        *[rnd(sem(x), 9).alias(f"sem_{x}") for x in METRICS]).withColumn("grain", F.lit("question"))
    return by_sample.unionByName(by_q)


def _sql_sem(x):
    return f"round(stddev_samp({x}) / sqrt(count({x})), 9) as sem_{x}"


E10_SQL = ("select model, category, " + ", ".join(_sql_sem(x) for x in METRICS)
           + f", 'sample' as grain from ({SQL_SAMPLE_METRICS}) m group by model, category "
           "union all select model, category, " + ", ".join(_sql_sem(x) for x in METRICS)
           + f", 'question' as grain from ({SQL_QUESTION_METRICS}) q group by model, category")


def e11(t):
    """Error class of every non-executed sample, counted per model."""
    s = t.samples.where(~F.col("executed"))
    return s.groupBy("model", error_class(F.col("error_type")).alias("error_class")).agg(
        F.count(F.lit(1)).alias("n"))


E11_SQL = (f"select model, {SQL_ERROR_CLASS} as error_class, count(*) as n from samples "
           f"where not executed group by model, {SQL_ERROR_CLASS}")


def e12(t):
    """Error-class rates per model (class count / all samples), pivoted;
    ``error_rate`` = 1 - exec@1."""
    s = t.samples
    cls = F.when(~F.col("executed"), error_class(F.col("error_type")))
    cols = [rnd(F.avg(F.when(cls == c, 1.0).otherwise(0.0)), 9).alias(f"{c.lower()}_rate")
            for c in ERROR_CLASSES]
    return s.groupBy("model").agg(*cols, rnd(1 - F.avg(F.col("executed").cast("double")), 9)
                                  .alias("error_rate"))


E12_SQL = ("select model, " + ", ".join(
    f"round(avg(case when not executed and {SQL_ERROR_CLASS} = '{c}' then 1.0 else 0.0 end), 9) "
    f"as {c.lower()}_rate" for c in ERROR_CLASSES)
    + ", round(1 - avg(cast(executed as double)), 9) as error_rate from samples group by model")


def e13(t):
    """Share of each error type among failures, most common first."""
    s = t.samples.where(F.col("error_type").isNotNull())
    g = s.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # spans the error types only (a handful of rows)
    return g.select("error_type", "n", rnd(F.col("n") / F.sum("n").over(w), 9).alias("share"),
                    F.row_number().over(Window.orderBy(F.desc("n"), "error_type")).cast("bigint").alias("rank"))


E13_SQL = ("select error_type, n, round(n / sum(n) over (), 9) as share, "
           "row_number() over (order by n desc, error_type) as rank from "
           "(select error_type, count(*) as n from samples where error_type is not null "
           "group by error_type) g")


# --- E14-E20: model comparison ------------------------------------------------

def model_summary(t) -> DataFrame:
    q = question_metrics(t.samples)
    return q.groupBy("model").agg(
        *[F.coalesce(_w_mean(x), F.lit(0.0)).alias(x) for x in METRICS],
        F.sum("n").alias("total_samples"),
        F.sum("n_err").alias("n_errors"))


def e14(t):
    """Per-model means (missing metric = 0), error count and sample total."""
    s = model_summary(t)
    return s.select("model", *[rnd(F.col(x), 9).alias(x) for x in METRICS],
                    "total_samples", "n_errors")


E14_SQL = ("select model, " + ", ".join(f"round(coalesce(avg({x}), 0), 9) as {x}" for x in METRICS)
           + f", count(*) as total_samples, count(error_type) as n_errors from "
           f"({SQL_SAMPLE_METRICS}) m group by model")


def category_summary(t) -> DataFrame:
    q = question_metrics(t.samples).withColumn(
        "category", F.coalesce(F.col("category"), F.lit("unknown")))
    return q.groupBy("model", "category").agg(
        *[_w_mean(x).alias(x) for x in METRICS], F.sum("n").alias("count"))


SQL_CATEGORY_SUMMARY = (
    "select model, coalesce(category, 'unknown') as category, "
    + ", ".join(f"avg({x}) as {x}" for x in METRICS)
    + f", count(*) as count from ({SQL_SAMPLE_METRICS}) m "
    "group by model, coalesce(category, 'unknown')")


def e15(t):
    """Per-category summary with sample count; missing category = unknown."""
    c = category_summary(t)
    return c.select("model", "category", *[rnd(F.col(x), 9).alias(x) for x in METRICS], "count")


E15_SQL = ("select model, category, " + ", ".join(f"round({x}, 9) as {x}" for x in METRICS)
           + f", count from ({SQL_CATEGORY_SUMMARY}) c")


def _improvement(base, tuned):
    return F.when(base > 0, (tuned - base) / base * 100).otherwise(F.lit(0.0))


def _sql_improvement(base, tuned):
    return f"(case when {base} > 0 then ({tuned} - {base}) / {base} * 100 else 0.0 end)"


def compare(t, base="base", tuned="tuned") -> DataFrame:
    """Both models side by side per category and metric, in one pass: the two rows
    of a category meet in one aggregation (categories of one model only drop out)."""
    c = category_summary(t)
    of = {"base": F.col("model") == base, "tuned": F.col("model") == tuned}
    g = c.groupBy("category").agg(
        *[F.max(F.when(cond, F.col(x))).alias(f"{side}_{x}") for side, cond in of.items() for x in METRICS],
        *[F.max(cond).alias(side) for side, cond in of.items()]).where("base and tuned")
    j = g.select("category", F.explode(F.array(*[
        F.struct(F.lit(x).alias("metric"), F.col(f"base_{x}").alias("base"), F.col(f"tuned_{x}").alias("tuned"))
        for x in METRICS])).alias("m")).select("category", "m.*")
    return j.select("category", "metric", "base", "tuned",
                    (F.col("tuned") - F.col("base")).alias("change"),
                    _improvement(F.col("base"), F.col("tuned")).alias("improvement_pct"))


def _sql_compare(base="base", tuned="tuned"):
    long = " union all ".join(
        f"select model, category, '{x}' as metric, {x} as v from ({SQL_CATEGORY_SUMMARY}) c{i}"
        for i, x in enumerate(METRICS))
    return (f"select b.category, b.metric, b.v as base, f.v as tuned, f.v - b.v as change, "
            f"{_sql_improvement('b.v', 'f.v')} as improvement_pct from "
            f"(select * from ({long}) l where model = '{base}') b join "
            f"(select * from ({long}) l where model = '{tuned}') f "
            f"on b.category = f.category and b.metric = f.metric")


def e16(t):
    """Base vs tuned per category and metric: change and improvement %
    (0 when the base is not positive)."""
    c = compare(t)
    return c.select("category", "metric", *[rnd(F.col(x), 9).alias(x) for x in
                                            ("base", "tuned", "change", "improvement_pct")])


E16_SQL = ("select category, metric, round(base, 9) as base, round(tuned, 9) as tuned, "
           f"round(change, 9) as change, round(improvement_pct, 9) as improvement_pct "
           f"from ({_sql_compare()}) c")


def e17(t, base="base", tuned="tuned"):
    """Error counts per type for both models, full outer aligned, missing = 0."""
    s = t.samples.where(F.col("error_type").isNotNull())
    cnt = s.groupBy("model", "error_type").agg(F.count(F.lit(1)).alias("n"))
    b = cnt.where(F.col("model") == base).select("error_type", F.col("n").alias("base"))
    f = cnt.where(F.col("model") == tuned).select("error_type", F.col("n").alias("tuned"))
    j = b.join(f, "error_type", "full_outer")
    return j.select("error_type", F.coalesce("base", F.lit(0)).alias("base"),
                    F.coalesce("tuned", F.lit(0)).alias("tuned"),
                    (F.coalesce("tuned", F.lit(0)) - F.coalesce("base", F.lit(0))).alias("change"))


E17_SQL = ("select coalesce(b.error_type, f.error_type) as error_type, coalesce(b.n, 0) as base, "
           "coalesce(f.n, 0) as tuned, coalesce(f.n, 0) - coalesce(b.n, 0) as change from "
           "(select error_type, count(*) as n from samples where error_type is not null and "
           "model = 'base' group by error_type) b full outer join "
           "(select error_type, count(*) as n from samples where error_type is not null and "
           "model = 'tuned' group by error_type) f on b.error_type = f.error_type")


def e18(t, k=3):
    """Categories by pass@1 improvement, top k and bottom k."""
    c = compare(t).where(F.col("metric") == "pass_at_1").select("category", "improvement_pct")
    top = c.orderBy(F.desc("improvement_pct"), F.asc("category")).limit(k)
    bottom = c.orderBy(F.asc("improvement_pct"), F.desc("category")).limit(k)
    return (top.withColumn("side", F.lit("top")).unionByName(bottom.withColumn("side", F.lit("bottom")))
            .select("side", "category", rnd(F.col("improvement_pct"), 9).alias("improvement_pct")))


E18_SQL = (f"select * from (select 'top' as side, category, round(improvement_pct, 9) as "
           f"improvement_pct from ({_sql_compare()}) c where metric = 'pass_at_1' "
           f"order by improvement_pct desc, category asc limit 3) "
           f"union all select * from (select 'bottom' as side, category, round(improvement_pct, 9) "
           f"as improvement_pct from ({_sql_compare()}) c where metric = 'pass_at_1' "
           f"order by improvement_pct asc, category desc limit 3)")


def e19(t):
    """Questions per category and share of the corpus."""
    q = t.samples.select("question_id", "category").distinct()
    g = q.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return g.select("category", "n", rnd(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()),
                                        9).alias("pct"))


E19_SQL = ("select category, n, round(n * 100.0 / sum(n) over (), 9) as pct from "
           "(select category, count(*) as n from (select distinct question_id, category from "
           "samples) q group by category) g")


def e20(t):
    """Best model per category by mean pass@1 (ties -> larger model name)."""
    c = category_summary(t)
    best = c.groupBy("category").agg(F.max(F.struct("pass_at_1", "model")).alias("b"))
    return best.select("category", F.col("b.model").alias("model"),
                       rnd(F.col("b.pass_at_1"), 9).alias("pass_at_1"))


E20_SQL = ("select category, model, round(pass_at_1, 9) as pass_at_1 from (select category, "
           "model, pass_at_1, row_number() over (partition by category order by pass_at_1 desc, "
           f"model desc) as rk from ({SQL_CATEGORY_SUMMARY}) c) x where rk = 1")


def e21(t):
    """Resume -- documents still to grade (no label yet): anti-join."""
    return t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")


E21_SQL = "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"


def e22(t, start=101, end=400):
    """One chunk of questions (inclusive 1-based id range) with metrics."""
    s = t.samples.where(F.col("question_id").between(start, end))
    q = question_metrics(s)
    return q.select("model", "question_id", rnd(F.col("pass_at_1"), 9).alias("pass_at_1"),
                    rnd(F.col("exec_at_1"), 9).alias("exec_at_1"))


E22_SQL = (f"select model, question_id, round(pass_at_1, 9) as pass_at_1, round(exec_at_1, 9) as "
           f"exec_at_1 from ({SQL_QUESTION_METRICS.replace('from samples group', 'from samples where question_id between 101 and 400 group')}) q")


# --- the whole chain, from response files to category means --------------------

def evaluate(responses: DataFrame, runs: DataFrame, n: int = SAMPLE_SIZE) -> DataFrame:
    """Graded samples of response records: the first ``n`` of each, cleaned (E1,
    E2), joined by (question, sample) with the log of its run, which is parsed
    (E3, E4) and matched with the gold answer (E5). A sample without a run has
    not been executed.

    ``responses``: (model, category, question_id, generated_samples); ``runs``:
    (question_id, sample_idx, exit_code, timed_out, log, answer).
    """
    s = responses.select("model", "category", "question_id", F.posexplode(
        F.slice("generated_samples", 1, n)).alias("sample_idx", "raw"))
    parsed = parse_run(F.col("exit_code"), F.col("timed_out"), F.col("log"))
    r = runs.select("question_id", F.col("sample_idx").cast("int").alias("sample_idx"), "answer",
                    parsed.alias("p"))
    j = s.join(r, ["question_id", "sample_idx"], "left")
    return j.select("model", "category", "question_id", "sample_idx",
                    clean_sample(F.col("raw")).alias("code"),
                    F.coalesce("p.executed", F.lit(False)).alias("executed"),
                    F.coalesce("p.passed", F.lit(False)).alias("passed"),
                    F.col("p.output").alias("output"), F.col("p.error_type").alias("error_type"),
                    answer_match(F.col("p.output"), F.col("answer")).alias("matched"))


def e_chain(t):
    """E1-E9 in one path: response files written and scanned (A5, A11), sliced,
    cleaned, joined with the run logs, graded, pass@k per question, category means."""
    from airlens.sources.files import read_responses, write_responses
    graded = evaluate(read_responses(t.spark, write_responses(t)), t.runs)
    q = question_metrics(graded)
    means = q.groupBy("model", "category").agg(
        *[rnd(_w_mean(x), 9).alias(f"mean_{x}") for x in METRICS])
    seen = graded.groupBy("model", "category").agg(
        F.sum(F.col("matched").cast("int")).alias("n_matched"),
        F.sum(F.length("code")).alias("code_chars"))
    return means.join(seen, ["model", "category"])


def _e_chain_sql() -> str:
    code = "chr(10) || 'answer = ' || g.question_id || ' + ' || g.sample_idx || chr(10)"
    graded = (f"(select s.model, s.category, g.question_id, g.sample_idx, g.executed, g.passed, g.error_type, "
              f"{sql_answer_match('g.output', 'g.answer')} as matched, length({code}) as code_len "
              f"from ({_sql_graded_runs()}) g join samples s on s.question_id = g.question_id "
              f"and s.sample_idx = g.sample_idx where g.sample_idx < {SAMPLE_SIZE})")
    metrics = SQL_QUESTION_METRICS.replace("from samples", f"from {graded} gs")
    return (f"select m.model, m.category, "
            + ", ".join(f"round(sum(m.n * m.{x}) / sum(m.n), 9) as mean_{x}" for x in METRICS)
            + ", any_value(k.n_matched) as n_matched, any_value(k.code_chars) as code_chars "
            f"from ({metrics}) m join (select model, category, sum(cast(matched as integer)) as n_matched, "
            f"sum(code_len) as code_chars from {graded} g2 group by model, category) k "
            "on m.model = k.model and m.category = k.category group by m.model, m.category")


def registry():
    sv = ("samples",)
    return {
        "E_chain": Entry(e_chain, _e_chain_sql(), ("samples", "runs")),
        "E1": Entry(e1, E1_SQL, ()),
        "E2": Entry(e2, E2_SQL, ()),
        "E3": Entry(e3, E3_SQL, ("runs",)),
        "E4": Entry(e4, E4_SQL, ("runs",)),
        "E5": Entry(e5, E5_SQL, ("runs",)),
        "E6": Entry(e6, E6_SQL, sv),
        "E7": Entry(e7, E7_SQL, sv),
        "E8": Entry(e8, E8_SQL, sv),
        "E9": Entry(e9, E9_SQL, sv),
        "E10": Entry(e10, E10_SQL, sv),
        "E11": Entry(e11, E11_SQL, sv),
        "E12": Entry(e12, E12_SQL, sv),
        "E13": Entry(e13, E13_SQL, sv),
        "E14": Entry(e14, E14_SQL, sv),
        "E15": Entry(e15, E15_SQL, sv),
        "E16": Entry(e16, E16_SQL, sv),
        "E17": Entry(e17, E17_SQL, sv),
        "E18": Entry(e18, E18_SQL, sv),
        "E19": Entry(e19, E19_SQL, sv),
        "E20": Entry(e20, E20_SQL, sv),
        "E21": Entry(e21, E21_SQL, ()),
        "E22": Entry(e22, E22_SQL, sv),
    }
