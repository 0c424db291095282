"""Corpus building (C1-C8): template expansion, sampling, chat records, split.

Questions are represented by ``documents`` (doc_id, text, lang) and chat
records by ``conversations``, as in the fixtures. Sampling is seeded and
deterministic: every row gets a pseudo-random key from a multiplicative hash
of its id (the same integer arithmetic in Spark and in the SQL oracle), and
samples are top-k by that key -- ``TakeOrderedAndProject`` or a
per-group ``row_number`` limit that Spark pushes below the shuffle
(``WindowGroupLimit``), so no group is gathered whole.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.operators.evaluation import SQL_QUESTION_METRICS, question_metrics
from airlens.operators.relational import with_ordinal
from airlens.plans.registry import Entry

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's):
# canonical category labels, the aliases other files use for them, and the
# category weights of the weighted-training recipe.
# ---------------------------------------------------------------------------
CATEGORIES = ("spatial_aggregation", "temporal_aggregation", "spatio_temporal_aggregation",
              "population_based", "area_based", "funding_based", "specific_pattern")
CATEGORY_ALIASES = {
    "spatial_temporal_aggregation": "spatio_temporal_aggregation",
    "spatio_temporal": "spatio_temporal_aggregation",
    "temporal_trends": "temporal_aggregation",
    "specific_patterns": "specific_pattern",
}
CATEGORY_WEIGHTS = {
    "spatial_aggregation": 1.0,
    "spatio_temporal": 2.0,
    "funding_based": 2.5,
    "temporal_trends": 1.5,
    "population_based": 1.8,
    "area_based": 1.3,
    "specific_patterns": 1.7,
}

SYSTEM_PROMPT = ("You are an air-quality data analyst. Write a Python function "
                 "get_response(data, states_data, funding_data) that returns one value.")

HASH_MUL = 2654435761
HASH_MOD = 4294967296


def hash_key(id_col: Column, seed: int) -> Column:
    """Deterministic pseudo-random integer in [0, 2^32) from an id."""
    return F.pmod(id_col.cast("bigint") * F.lit(HASH_MUL) + F.lit(seed), F.lit(HASH_MOD))


def sql_hash_key(id_col: str, seed: int) -> str:
    return f"(({id_col} * {HASH_MUL} + {seed}) % {HASH_MOD})"


def canonical_category(spark) -> DataFrame:
    """Alias -> canonical label table (literal, a few rows), including the
    canonical names themselves and the fixture's ``cat_<i>`` labels."""
    rows = [(c, c) for c in CATEGORIES]
    rows += list(CATEGORY_ALIASES.items())
    rows += [(f"cat_{i}", c) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "label string, category string")


def _sql_canonical() -> str:
    rows = [(c, c) for c in CATEGORIES] + list(CATEGORY_ALIASES.items())
    rows += [(f"cat_{i}", c) for i, c in enumerate(CATEGORIES)]
    vals = ", ".join(f"('{a}', '{b}')" for a, b in rows)
    return f"(select col0 as label, col1 as category from (values {vals}) v(col0, col1))"


def _weights(spark) -> DataFrame:
    alias = dict(CATEGORY_ALIASES)
    rows = [(alias.get(k, k), float(w)) for k, w in CATEGORY_WEIGHTS.items()]
    return spark.createDataFrame(rows, "category string, weight double")


def _sql_weights() -> str:
    alias = dict(CATEGORY_ALIASES)
    vals = ", ".join(f"('{alias.get(k, k)}', {float(w)})" for k, w in CATEGORY_WEIGHTS.items())
    return f"(select col0 as category, cast(col1 as double) as weight from (values {vals}) w(col0, col1))"


# --- C1 / C2: template expansion and lint ------------------------------------

def expand_template(templates: DataFrame, values: DataFrame) -> DataFrame:
    """Expand templates into questions.

    ``templates``: (template_id, question, code).
    ``values``: (template_id, var, code_var, idx, q_value, c_value) -- the j-th
    question value of a variable is paired with its j-th code value (lists zipped
    by index, to the shorter one); the question holds ``{var}``, the code
    ``{code_var}``. Variables combine as a cartesian product, built by one join
    per variable in the plan, so a template's variants are produced in parallel.
    """
    values = values.where(F.col("q_value").isNotNull() & F.col("c_value").isNotNull())
    vars_ = values.select("template_id", "var").distinct()
    n_vars = vars_.groupBy("template_id").agg(F.count(F.lit(1)).alias("n_vars"))
    # Each combination is the set of (var, idx) choices; build it by folding
    # variables in name order with a join per step (var_rank 1..n).
    ranked = vars_.withColumn("var_rank", F.dense_rank().over(
        Window.partitionBy("template_id").orderBy("var")))
    v = values.join(ranked, ["template_id", "var"])
    base = templates.join(n_vars, "template_id", "left").withColumn(
        "combo", F.array().cast("array<struct<var:string,code_var:string,q:string,c:string>>")).withColumn(
        "step", F.lit(0))
    # One join per variable position; the count is a one-number aggregate of
    # the (small) variable table.
    max_vars = ranked.agg(F.max("var_rank")).first()[0] or 0
    cur = base
    for step in range(1, max_vars + 1):
        choice = v.where(F.col("var_rank") == step).select(
            "template_id", F.struct("var", "code_var", F.col("q_value").alias("q"),
                                    F.col("c_value").alias("c")).alias("choice"))
        nxt = cur.join(choice, "template_id", "left")
        cur = nxt.withColumn("combo", F.when(F.col("choice").isNotNull(),
                                             F.array_append("combo", F.col("choice")))
                             .otherwise(F.col("combo"))).drop("choice")

    def fill(text_col: str, name: str, field: str) -> Column:
        return F.aggregate("combo", F.col(text_col),
                           lambda acc, x: F.replace(acc, F.concat(F.lit("{"), x[name], F.lit("}")),
                                                    x[field]))
    return cur.select("template_id", fill("question", "var", "q").alias("question"),
                      fill("code", "code_var", "c").alias("code"))


def lint_templates(templates: DataFrame, values: DataFrame) -> DataFrame:
    """Per template, variables whose question and code lists differ in
    length, and for each of the two texts the placeholders without a variable
    and the variables without a placeholder, by that text's own names."""
    none = F.array().cast("array<string>")
    lens = values.groupBy("template_id", "var", "code_var").agg(
        F.count("q_value").alias("nq"), F.count("c_value").alias("nc"))
    declared = lens.groupBy("template_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("nq") != F.col("nc"), F.col("var")))).alias("unequal_lists"),
        F.collect_set("var").alias("vars"), F.collect_set("code_var").alias("code_vars"))
    held = lambda text: F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{(\w+)\}"), 1))
    j = templates.select("template_id", held("question").alias("q"), held("code").alias("c")).join(
        declared, "template_id", "left")
    vars_, code_vars = F.coalesce("vars", none), F.coalesce("code_vars", none)
    diff = lambda a, b: F.sort_array(F.array_except(a, b))
    return j.select(
        "template_id", F.coalesce("unequal_lists", none).alias("unequal_lists"),
        diff(F.col("q"), vars_).alias("undeclared"), diff(vars_, F.col("q")).alias("unused"),
        diff(F.col("c"), code_vars).alias("code_undeclared"),
        diff(code_vars, F.col("c")).alias("code_unused"))


def c1(t):
    """The template documents built from the tables (A4), expanded."""
    from airlens.sources.files import template_values, write_templates
    return expand_template(*template_values(t.spark, write_templates(t)))


C1_SQL = ("select cast(r.r_regionkey as integer) as template_id, "
          "'Which ' || n.n_name || ' of ' || r.r_name || ' was worst in ' || y.yr || '?' as question, "
          "'state == ''' || n.n_name || ''' and year == ' || y.yr as code from nation n "
          "join region r on n.n_regionkey = r.r_regionkey, "
          "(select distinct cast(year(ts) as varchar) as yr from readings) y")


# --- C3: stratified seeded sample -------------------------------------------------

def stratified_sample(df: DataFrame, group_col: str, id_col: str, per_group: int,
                      seed: int = 42) -> DataFrame:
    """Up to ``per_group`` rows of each group, chosen by a seeded hash.
    The literal limit lets Spark run a partial per-group limit before the
    shuffle, so a hot group sends only ``per_group`` rows per map task."""
    key = hash_key(F.col(id_col), seed)
    w = Window.partitionBy(group_col).orderBy(key, F.col(id_col))
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= per_group).drop("_rk")


def c3(t, per_group=50, seed=42):
    """A diversity sample of questions, stratified by language."""
    d = t.documents.select("doc_id", "lang")
    return stratified_sample(d, "lang", "doc_id", per_group, seed)


C3_SQL = (f"select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang "
          f"order by {sql_hash_key('doc_id', 42)}, doc_id) as rk from documents) s where rk <= 50")


# --- C4: chat triples --------------------------------------------------------------

def c4(t, system_prompt: str = SYSTEM_PROMPT):
    """C4: (system, user, assistant) records: each user turn paired with the
    next turn of the same conversation when that turn is the assistant's.
    ``system_prompt`` is the text of the deployment's prompt file."""
    c = t.conversations.select("conv_id", "turn", "role", "text")
    u = c.where(F.col("role") == "user").alias("u")
    a = c.where(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("u.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    msg = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(msg("system", F.lit(system_prompt)), msg("user", F.col("u.text")),
                       msg("assistant", F.col("a.text")))
    return j.select(F.col("u.conv_id").alias("conv_id"), F.col("u.turn").alias("turn"),
                    F.to_json(messages).alias("messages"))


C4_SQL = ("select u.conv_id, u.turn, '[{\"role\":\"system\",\"content\":' || "
          f"to_json('{SYSTEM_PROMPT}'::varchar) || '}},{{\"role\":\"user\",\"content\":' || "
          "to_json(u.text) || '},{\"role\":\"assistant\",\"content\":' || to_json(a.text) || '}]' "
          "as messages from conversations u join conversations a on u.conv_id = a.conv_id and "
          "a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'").replace("}},{{", "},{")


# --- C5: ordered split ----------------------------------------------------------------

def ordered_split(df: DataFrame, order_col: str, train_fraction: float = 0.9) -> DataFrame:
    """The first ``int(n * fraction)`` rows in ``order_col`` order are
    train, the rest validation -- no shuffling of the order."""
    n = df.count()
    cut = int(n * train_fraction)
    o = with_ordinal(df, order_col)
    return o.withColumn("split", F.when(F.col("ordinal") < cut, "train").otherwise("validation"))


def c5(t):
    """90/10 ordered split of the questions by id."""
    s = ordered_split(t.documents.select("doc_id"), "doc_id", 0.9)
    return s.select("doc_id", "split")


C5_SQL = ("select doc_id, case when rn <= floor((select count(*) from documents) * 0.9) "
          "then 'train' else 'validation' end as split from "
          "(select doc_id, row_number() over (order by doc_id) as rn from documents) d")


# --- C6 / C7 / C8: weighting and mixing -----------------------------------------------------

def _questions(t) -> DataFrame:
    q = t.samples.select("question_id", "category").distinct()
    alias = canonical_category(q.sparkSession)
    return q.join(F.broadcast(alias), q.category == alias.label, "left").select(
        "question_id", F.coalesce(alias.category, q.category).alias("category"))


def c6(t, n=100, seed=7):
    """Category-weighted sample without replacement: keys -ln(u)/w
    (Efraimidis-Spirakis), n smallest keys taken."""
    q = _questions(t)
    w = _weights(q.sparkSession)
    j = q.join(F.broadcast(w), "category", "left").fillna({"weight": 1.0})
    u = (hash_key(F.col("question_id"), seed) + F.lit(1)) / F.lit(float(HASH_MOD + 1))
    keyed = j.withColumn("k", -F.ln(u) / F.col("weight"))
    return keyed.orderBy("k", "question_id").limit(n).select("question_id", "category", "weight")


C6_SQL = ("select question_id, category, weight from (select q.question_id, q.category, "
          "coalesce(w.weight, 1.0) as weight, -ln((" + sql_hash_key("q.question_id", 7)
          + " + 1) / 4294967297.0) / coalesce(w.weight, 1.0) as k from "
          f"(select distinct s.question_id, coalesce(c.category, s.category) as category from "
          f"samples s left join {_sql_canonical()} c on s.category = c.label) q "
          f"left join {_sql_weights()} w on q.category = w.category) x order by k, question_id limit 100")


def c7(t, model="base", copies=4):
    """Error-focused mix: questions the model failed (exec@1 = 0 or
    pass@1 = 0) repeated ``copies`` times, plus the full set once."""
    q = question_metrics(t.samples.where(F.col("model") == model))
    failed = q.where((F.col("exec_at_1") == 0) | (F.col("pass_at_1") == 0)).select("question_id")
    rep = failed.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    full = q.select("question_id", F.lit(-1).alias("copy"))
    return rep.unionByName(full)


C7_SQL = ("select question_id, cast(copy as integer) as copy from (select question_id, unnest(range(0, 4)) "
          f"as copy from ({SQL_QUESTION_METRICS}) q where model = 'base' and (exec_at_1 = 0 or "
          f"pass_at_1 = 0)) f union all select question_id, -1 as copy from ({SQL_QUESTION_METRICS}) "
          "q where model = 'base'")


def c8(t):
    """Questions per canonical category after alias resolution, with weight."""
    q = _questions(t)
    w = _weights(q.sparkSession)
    g = q.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(w), "category", "left").select(
        "category", "n", F.coalesce("weight", F.lit(1.0)).alias("weight"))


C8_SQL = ("select q.category, count(*) as n, coalesce(max(w.weight), 1.0) as weight from "
          f"(select distinct s.question_id, coalesce(c.category, s.category) as category from "
          f"samples s left join {_sql_canonical()} c on s.category = c.label) q "
          f"left join {_sql_weights()} w on q.category = w.category group by q.category")


def registry():
    return {
        "C1": Entry(c1, C1_SQL, ("readings",)),
        "C3": Entry(c3, C3_SQL, ()),
        "C4": Entry(c4, C4_SQL, ()),
        "C5": Entry(c5, C5_SQL, ()),
        "C6": Entry(c6, C6_SQL, ("samples",)),
        "C7": Entry(c7, C7_SQL, ("samples",)),
        "C8": Entry(c8, C8_SQL, ("samples",)),
    }
