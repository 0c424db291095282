"""Text expressions of the evaluation pipeline.

All are built-in string / array / higher-order functions, so they run inside
whole-stage codegen; no Python UDF touches a row. Whitespace stripping follows
Python's ``str.strip`` for ASCII whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARKER = "EXEC_OK:"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _after_first(c: Column, delim: str) -> Column:
    """Text after the first ``delim`` (NULL when absent)."""
    pos = F.instr(c, delim)
    return F.when(pos > 0, c.substr(pos + F.lit(len(delim)), F.lit(2 ** 31 - 1)))


def _before_first(c: Column, delim: str) -> Column:
    return F.split_part(c, F.lit(delim), F.lit(1))


def clean_sample(c: Column) -> Column:
    """Reasoning and fences stripped from a generated program.

    1. with ``<think>``: keep what follows the first ``</think>``, or '' when
       there is none or it is blank;
    2. cut at the first ``</code>``; 3. delete every fenced-python opener;
    4. cut at the next fence; 5. delete ``<code>``.
    """
    tail = _after_first(c, "</think>")
    s = F.when(F.instr(c, "<think>") > 0,
               F.when(tail.isNotNull() & tail.rlike(r"\S"), tail).otherwise(F.lit(""))
               ).otherwise(c)
    s = _before_first(s, "</code>")
    s = F.replace(s, F.lit("```python"), F.lit(""))
    s = _before_first(s, "```")
    return F.replace(s, F.lit("<code>"), F.lit(""))


def sql_clean_sample(c: str) -> str:
    tail = f"(case when strpos({c}, '</think>') > 0 then substr({c}, strpos({c}, '</think>') + 8) end)"
    s = (f"(case when strpos({c}, '<think>') > 0 then (case when {tail} is not null and "
         f"regexp_matches({tail}, '\\S') then {tail} else '' end) else {c} end)")
    s = f"split_part({s}, '</code>', 1)"
    s = f"replace({s}, '```python', '')"
    s = f"split_part({s}, '```', 1)"
    return f"replace({s}, '<code>', '')"


def parse_run(exit_code: Column, timed_out: Column, log: Column) -> Column:
    """(executed, passed, output, error_type) of one captured run."""
    out = strip(log)
    lines = F.split(out, "\n")
    has_marker = F.instr(out, MARKER) > 0
    ok = exit_code == 0
    success_output = strip(F.split_part(out, F.lit(MARKER), F.lit(2)))
    marked = F.filter(lines, lambda ln: F.instr(ln, MARKER) > 0)
    fail_output = strip(F.split_part(F.get(marked, 0), F.lit(MARKER), F.lit(2)))
    last_type = strip(F.split_part(F.element_at(lines, -1), F.lit(":"), F.lit(1)))
    fail_type = F.when(out == "", F.lit("UnknownError")).otherwise(last_type)
    null_s = F.lit(None).cast("string")
    executed = (F.when(timed_out, False).when(ok, has_marker).otherwise(has_marker))
    passed = F.when(timed_out, False).when(ok, has_marker).otherwise(False)
    output = (F.when(timed_out, null_s).when(ok, F.when(has_marker, success_output))
              .otherwise(F.when(has_marker, fail_output)))
    etype = (F.when(timed_out, F.lit("TimeoutError"))
             .when(ok, F.when(has_marker, null_s).otherwise(F.lit("IndexError")))
             .otherwise(fail_type))
    return F.struct(executed.alias("executed"), passed.alias("passed"),
                    output.alias("output"), etype.alias("error_type"))


def sql_parse_run(exit_code: str, timed_out: str, log: str) -> dict[str, str]:
    out = f"regexp_replace({log}, '^\\s+|\\s+$', '', 'g')"
    strip = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
    has = f"(strpos({out}, 'EXEC_OK:') > 0)"
    lines = f"string_split({out}, chr(10))"
    succ = strip.format(f"split_part({out}, 'EXEC_OK:', 2)")
    marked = f"list_filter({lines}, lambda ln: strpos(ln, 'EXEC_OK:') > 0)[1]"
    fail_out = strip.format(f"split_part({marked}, 'EXEC_OK:', 2)")
    last_type = strip.format(f"split_part({lines}[-1], ':', 1)")
    fail_type = f"(case when {out} = '' then 'UnknownError' else {last_type} end)"
    ok = f"({exit_code} = 0)"
    return {
        "executed": f"(case when {timed_out} then false else {has} end)",
        "passed": f"(case when {timed_out} then false when {ok} then {has} else false end)",
        "output": (f"(case when {timed_out} then null when {ok} then (case when {has} then {succ} end) "
                   f"else (case when {has} then {fail_out} end) end)"),
        "error_type": (f"(case when {timed_out} then 'TimeoutError' when {ok} then "
                       f"(case when {has} then null else 'IndexError' end) else {fail_type} end)"),
    }


# the texts that float() of a text reads: no type letters, no hexadecimal
_NUMBER = (r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?"
           r"|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$")


def _as_number(text: Column) -> Column:
    """The number a text reads as, or NULL ('5d' and '1f' are no numbers)."""
    return F.when(text.rlike(_NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def answer_match(output: Column, answer: Column) -> Column:
    """E5: numeric texts compare with numpy.isclose defaults, others by equality.

    NaN never matches; infinities match only when equal.
    """
    od, ad = _as_number(output), _as_number(answer)
    numeric = od.isNotNull() & ad.isNotNull()
    close = F.abs(od - ad) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(ad)
    inf = F.lit(float("inf"))
    num_match = (F.when(F.isnan(od) | F.isnan(ad), False)
                 .when((F.abs(od) == inf) | (F.abs(ad) == inf), od == ad)
                 .otherwise(close))
    return F.when(output.isNull(), False).when(numeric, num_match).otherwise(output == answer)


def sql_answer_match(output: str, answer: str) -> str:
    od = f"try_cast({output} as double)"
    ad = f"try_cast({answer} as double)"
    return (f"(case when {output} is null then false "
            f"when {od} is not null and {ad} is not null then (case "
            f"when isnan({od}) or isnan({ad}) then false "
            f"when isinf({od}) or isinf({ad}) then {od} = {ad} "
            f"else abs({od} - {ad}) <= 1e-8 + 1e-5 * abs({ad}) end) "
            f"else {output} = {answer} end)")


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k, 1 - prod_{i=n-c+1..n} (1 - k/i).

    Branch order matters: ``n - c < k`` first, then ``c = 0`` (Spark's
    ``sequence`` would run backwards where NumPy's range is empty).
    """
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0),
                       lambda acc, i: acc * (F.lit(1.0) - F.lit(float(k)) / i))
    return (F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod))


def sql_pass_at_k(n: str, c: str, k: int) -> str:
    return (f"(case when {n} - {c} < {k} then 1.0 when {c} = 0 then 0.0 else 1.0 - "
            f"list_product(list_transform(range(cast({n} - {c} + 1 as bigint), cast({n} + 1 as bigint)), "
            f"lambda i: 1.0 - {float(k)} / i)) end)")


ERROR_CLASSES = ("Column", "Syntax", "Name", "Other")


def error_class(error_type: Column) -> Column:
    """KeyError -> Column; Syntax/Indentation/Tab -> Syntax;
    NameError/ImportError -> Name; everything else -> Other."""
    return (F.when(error_type == "KeyError", "Column")
            .when(error_type.isin("SyntaxError", "IndentationError", "TabError"), "Syntax")
            .when(error_type.isin("NameError", "ImportError"), "Name")
            .otherwise("Other"))


SQL_ERROR_CLASS = ("(case when error_type = 'KeyError' then 'Column' "
                   "when error_type in ('SyntaxError', 'IndentationError', 'TabError') then 'Syntax' "
                   "when error_type in ('NameError', 'ImportError') then 'Name' else 'Other' end)")
