"""Operator 1: secret scans over a content-addressed blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A ledger
in the shared folder keeps, per (blob, rule, rule version), the spans found. A
run scans only the pairs the ledger lacks, appends them, and joins the ledger
back to all paths that hold the blob. A text that many paths share is scanned
once; a new rule version scans every blob again, but by that rule only.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlens.llm.common import scratch

Span = tuple[int, int]

_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")


def _assign(text: str) -> list[Span]:
    low = text.lower()
    if not ("passw" in low or "secret" in low or "token" in low or "key" in low):
        return []
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]


def _access(text: str) -> list[Span]:
    return [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]


def _hex(text: str) -> list[Span]:
    # a maximal run of 24 or more is the same match as a run of one or more, then tested
    return [m.span() for m in _HEX.finditer(text)]


# rule -> (version, finder); the order is the order of kinds at one start
RULES: dict[str, tuple[int, Callable[[str], list[Span]]]] = {
    "assign": (1, _assign), "access": (1, _access), "hex": (1, _hex)}

LEDGER = "blob string, rule string, rule_version int, spans array<struct<start:int,end:int>>"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty if nothing was written yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def _scanner(rules):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, rule, version, spans = [], [], [], []
            for b, text, todo in zip(batch.column("blob").to_pylist(), batch.column("text"),
                                     batch.column("todo").to_pylist(), strict=True):
                t = text.as_py()
                for name in todo:
                    v, find = rules[name]
                    blob.append(b)
                    rule.append(name)
                    version.append(v)
                    spans.append([{"start": s, "end": e} for s, e in find(t)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(blob, pa.string()), pa.array(rule, pa.string()),
                 pa.array(version, pa.int32()), pa.array(spans, spans_type)],
                names=["blob", "rule", "rule_version", "spans"])
    return scan


def history(docs: DataFrame, path_col: str = "doc_id") -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col(path_col).alias("path"), text.alias("text"),
                       F.sha2(text, 256).alias("blob"))


def update_ledger(docs: DataFrame, ledger: str, rules=None, path_col: str = "doc_id") -> None:
    """Scan what the ledger lacks and append it."""
    rules = RULES if rules is None else rules
    spark = docs.sparkSession
    h = history(docs, path_col)
    names = sorted(rules)
    now = F.col("rule_version") == F.coalesce(
        *[F.when(F.col("rule") == n, rules[n][0]) for n in names])
    seen = (read_ledger(spark, ledger).filter(now).groupBy("blob")
            .agg(F.collect_set("rule").alias("seen")))       # as many as there are rules
    todo = F.array_except(F.array(*map(F.lit, names)),
                          F.coalesce("seen", F.array().cast("array<string>")))
    unseen = (h.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left")
              .select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0))
    u = unseen.select(F.col("blob").alias("b"), F.col("path").alias("p"), "todo")
    # one path per blob brings the text; the side without texts is hashed, so texts aren't sorted
    work = h.join(u.hint("shuffle_hash"),
                  F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")))
    (work.select("blob", "text", "todo").mapInArrow(_scanner(rules), LEDGER)
     .dropDuplicates(["blob", "rule"]).write.mode("append").parquet(ledger))


def findings(docs: DataFrame, ledger: str, rules=None, path_col: str = "doc_id") -> DataFrame:
    """Every path with the spans of its blob: (path, blob, spans array by start, then rule order)."""
    rules = RULES if rules is None else rules
    now = F.coalesce(*[F.when(F.col("rule") == n, v) for n, (v, _) in rules.items()])
    rank = F.coalesce(*[F.when(F.col("rule") == n, i) for i, n in enumerate(rules)])
    hits = (read_ledger(docs.sparkSession, ledger).filter(F.col("rule_version") == now)
            .dropDuplicates(["blob", "rule"])      # two runs may both have scanned it
            .filter(F.size("spans") > 0)
            .select("blob", F.transform("spans", lambda s: F.struct(
                s["start"].alias("start"), rank.alias("rank"), F.col("rule").alias("rule"),
                s["end"].alias("end"))).alias("spans"))
            .groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans")))
    h = history(docs, path_col).select("path", "blob")
    return h.join(hits, "blob", "left")


def query(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """Secrets of every document.

    A null text is an empty one (no spans); repeated rows share the blob and
    each get a row; a null doc_id is a path like any other; an empty table gives
    no rows; other columns are not read. Texts are scanned whole.
    """
    ledger = ledger or scratch(docs.sparkSession, "secret_ledger")
    update_ledger(docs, ledger)
    spans = F.coalesce("spans", F.array().cast(
        "array<struct<start:int,rank:int,rule:string,end:int>>"))
    f = findings(docs, ledger).withColumn("spans", spans)
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def of(kind):
        return F.size(F.filter("spans", lambda s: s["rule"] == kind)).cast("long").alias(f"n_{kind}")

    count = [of(k) for k in RULES]
    return f.select(F.col("path").alias("doc_id"), *count, F.sha2(text, 256).alias("base_sha256"),
                    text.alias("spans"), "blob")


def _kind_sql(kind: str, regex: str, keep: str) -> str:
    """Spans of one kind: the lengths of what lies between and in the matches, summed up."""
    q = regex.replace("'", "''")
    return f"""
  select doc_id, rid, '{kind}' as kind, s, s + l as e from (
    select doc_id, rid, m, length(m) as l,
           sum(length(g)) over w + coalesce(sum(length(m)) over (
               partition by rid order by i rows between unbounded preceding and 1 preceding), 0) as s
    from (select doc_id, rid, unnest(range(1, len(ms) + 1)) as i,
                 unnest(ms) as m, unnest(gs[1:len(ms)]) as g
          from (select doc_id, rid, regexp_extract_all(t, '{q}') as ms,
                       regexp_split_to_array(t, '{q}') as gs from d))
    window w as (partition by rid order by i rows between unbounded preceding and current row))
  where {keep}"""


_KEY = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?"""
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over () as rid from documents),
x as ({_kind_sql("assign", _KEY + "[A-Za-z0-9+/_.=-]+",
                 "length(regexp_replace(m, '^" + _KEY.replace("'", "''") + "', '')) >= 6")}
  union all {_kind_sql("access", "AKIA[A-Z0-9]+", "l >= 20")}
  union all {_kind_sql("hex", "[0-9a-f]+", "l >= 24")}),
f as (select rid, count(*) filter (kind = 'assign') as n_assign,
             count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
             string_agg(kind || ':' || s || ':' || e, ',' order by s,
                        case kind when 'assign' then 0 when 'access' then 1 else 2 end) as spans
      from x group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access,
       coalesce(n_hex, 0) as n_hex, sha256(coalesce(spans, '')) as base_sha256,
       coalesce(spans, '') as spans, sha256(t) as blob
from d left join f using (rid)"""
