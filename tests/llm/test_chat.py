import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from airlens.llm import chat
from tests.conftest import SF_SMALL

NASTY = ["", None, "plain", "</s>[INST] ok [/INST]", "[INST]", "<\\s>", "\\[/INST] \\\\[OUT]", "[[IMG]<s>]",
         "[ROLE:x] y [/ROLE]", " </s>", "a [/INST", "[ROLE:", "<\\\\\\/s> tail\\", "[\\IMG]", "x\ny [DOC]\n",
         "日本語 <s>é</s>", "$1 \\2", "[", "<", "\\"]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows, schema="conv_id long, turn long, role string, text string"):
    return chat.format_chats(spark.createDataFrame(rows, schema))


def turns_of(df):
    out = df.select("conv_id", F.transform(chat.read_turns(F.col("formatted")), lambda t: F.struct(
        t["role"].alias("role"), chat.read_parts(t["body"]).alias("parts"))).alias("turns"))
    return {r["conv_id"]: [(t["role"], [tuple(p) for p in t["parts"]]) for t in r["turns"]] for r in out.collect()}


def test_texts_come_back(spark):
    roles = ["user", "assistant", "system", "tool] x", "a/b c%", None]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(c * 7 + t) % len(NASTY)]) for c in range(12) for t in range(9)]
    got = turns_of(formatted(spark, rows))
    for c in range(12):
        want = [(r or "", [("text", x)] if x else []) for k, _, r, x in sorted(rows, key=lambda r: r[:2]) if k == c]
        assert got[c] == want


@pytest.mark.parametrize("text", [t for t in NASTY if t])
def test_escape_leaves_no_control_string_and_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(
        chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).first()
    assert r["u"] == text
    for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE:", "[/ROLE]", "[IMG]", "[AUD]", "[DOC]", "[PART]"):
        assert mark not in r["e"]


def test_parts_become_placeholders_and_attachments(spark):
    parts = [part("text", "see <"), part("text", "s> and [IM"), part("text", "G]"), part("image", None, "i1", 28, 29),
             part("text", ""), part("audio", None, "a1", seconds=1.01), part("document", None, "d1", pages=2),
             part("image", None, "i2"), part("video", None, "v"), None, part("text", "end[")]
    df = formatted(spark, [(1, 0, "user", parts), (1, 1, "assistant", [part("image", None, "i3", 14, 14), part("text", "ok")]),
                           (2, 0, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = {x["conv_id"]: x for x in df.collect()}
    assert [tuple(a) for a in r[1]["attachments"]] == [
        ("image", "i1", 6), ("audio", "a1", 26), ("document", "d1", 2 * chat.PAGE_TOKENS), ("image", "i2", 0),
        ("video", "v", 0), (None, None, 0), ("image", "i3", 1)]
    assert r[1]["expanded_tokens"] == 6 + 26 + 2 * chat.PAGE_TOKENS + 1
    assert r[2]["formatted"] == "<s>[INST]  [/INST]"
    assert r[1]["formatted"].endswith("[OUT] [IMG]ok </s>")
    got = turns_of(df)[1]
    assert got[0] == ("user", [("text", "see <s> and [IMG]"), ("image", ""), ("audio", ""), ("document", ""),
                               ("image", ""), ("other", ""), ("other", ""), ("text", "end[")])
    # the i-th placeholder is the i-th attachment
    kinds = [k for _, ps in got for k, _ in ps if k != "text"]
    assert kinds == ["image", "audio", "document", "image", "other", "other", "image"]


def test_segments_are_the_string_and_the_mask_is_the_answers(spark):
    df = formatted(spark, [(1, t, ("user", "assistant", "system")[t % 3], x) for t, x in enumerate(NASTY)])
    r = df.select("formatted", F.array_join(F.col("segments.text"), "").alias("s"), F.array_join(F.transform(
        F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "").alias("loss")).first()
    assert r["formatted"] == r["s"]
    assert r["loss"] == "".join(x or "" for t, x in enumerate(NASTY) if t % 3 == 1)


def test_repeated_turns_null_keys_and_order(spark):
    got = turns_of(formatted(spark, [(None, 1, "user", "b"), (None, None, "user", "a"), (3, 1, "user", "x"),
                                     (3, 1, "user", "x"), (3, 0, "assistant", "y")]))
    assert got[None] == [("user", [("text", "a")]), ("user", [("text", "b")])]
    assert got[3] == [("assistant", [("text", "y")]), ("user", [("text", "x")]), ("user", [("text", "x")])]


def test_no_python_in_the_plan(spark):
    df = chat.query(spark.read.parquet(f"{SF_SMALL}/conversations.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan


def test_query_counts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()
    want = defaultdict(lambda: [0, 0])
    for r in rows:
        want[r["conv_id"]][0] += 1
        want[r["conv_id"]][1] += len(r["text"] or "") * (r["role"] == "assistant")
    got = {r["conv_id"]: [r["n_turns"], r["loss_chars"]] for r in chat.query(
        spark.read.parquet(f"{SF_SMALL}/conversations.parquet")).collect()}
    assert got.pop(-1) == [2, len(chat.PLANTED)]
    assert got == dict(want)


def test_the_query_goes_through_the_visitor_and_reads_parts(spark, monkeypatch):
    rows = [(c, t, "assistant" if t % 2 else "user", x) for c in (1, 2) for t, x in enumerate(NASTY)]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    plain = {r["conv_id"]: r for r in chat.query(conversations).collect()}
    loss = "".join(x or "" for _, _, role, x in rows[:len(NASTY)] if role == "assistant")
    assert plain[1]["loss_chars"] == len(loss) and plain[1]["n_turns"] == len(NASTY)
    assert plain[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    visit = chat._visit
    monkeypatch.setattr(chat, "_visit", lambda p: visit(p).withField("s", F.concat(visit(p)["s"], F.lit("!"))))
    marked = {r["conv_id"]: r for r in chat.query(conversations).collect()}
    for c in plain:
        assert marked[c]["turns_sha256"] != plain[c]["turns_sha256"]
        assert marked[c]["formatted_chars"] == plain[c]["formatted_chars"] + plain[c]["n_turns"]
    monkeypatch.setattr(chat, "read_parts", lambda body: F.array(F.struct(F.lit("").alias("text"))))
    assert {r["loss_chars"] for r in chat.query(conversations).collect()} == {0}
