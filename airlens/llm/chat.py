"""Operator 12: chat formatting of typed content parts.

A message holds parts of type text, image, audio or document. A visitor with
one rule per type flattens them in order: text as it is (neighbouring texts as
one), every other part as a placeholder, whose attachment (type, reference,
expanded token count) goes into the list of the conversation; the i-th
placeholder of the formatted string belongs to the i-th attachment.

Template: ``<s>`` opens a conversation; a user's turn is ``[INST] text [/INST]``,
an assistant's ``[OUT] text </s>``, any other role's ``[ROLE:name] text [/ROLE]``
(name percent-encoded). A control string inside a text gets a backslash after
its bracket, and one that has backslashes there gets one more, so that removing
one gives the text back and no other text is changed. The loss mask marks the
segments of the formatted string that are an assistant's text, without its marks.

All of it is DataFrame functions. Texts are shuffled once, to the conversation
that they belong to. A conversation is one string in the end, so it must fit in
a task (2 GB, Spark's limit of a string), as in any trainer that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
ATTACHMENT = "struct<type:string,ref:string,n_tokens:long>"
# the control strings behind their bracket; [ROLE: has a name behind it
_CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|OUT\]|ROLE:|/ROLE\]|IMG\]|AUD\]|DOC\]|PART\])"
_ESCAPED = _CONTROL.replace(r"(\\*)", r"\\(\\*)")
_HOLDER = r"\[(IMG|AUD|DOC|PART)\]"
_TURN = r"(?s)\[(INST|OUT|ROLE:[^\]]*)\] (.*?) (?:\[/INST\]|</s>|\[/ROLE\])"

PATCH = 14                # pixels of a side of an image patch
AUDIO_TOKENS = 25         # a second
PAGE_TOKENS = 729         # a page of a document


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _count(x: Column) -> Column:
    return F.greatest(F.coalesce(x.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def _image(p: Column) -> tuple[str, Column]:
    return "[IMG]", _count(F.ceil(p["width"] / PATCH) * F.ceil(p["height"] / PATCH))


def _audio(p: Column) -> tuple[str, Column]:
    return "[AUD]", _count(F.ceil(p["seconds"] * AUDIO_TOKENS))


def _document(p: Column) -> tuple[str, Column]:
    return "[DOC]", _count(p["pages"].cast("long") * PAGE_TOKENS)


# a part of any other type, or a null part
def _other(p: Column) -> tuple[str, Column]:
    return "[PART]", F.lit(0).cast("long")


VISITOR = {"image": _image, "audio": _audio, "document": _document}


def _visit(p: Column) -> Column:
    """(is it text, its text or placeholder, its attachment) of one part."""
    holder, tokens = (F.lit(_other(p)[0]), _other(p)[1])
    for kind, rule in VISITOR.items():
        mark, n = rule(p)
        holder = F.when(p["type"] == kind, mark).otherwise(holder)
        tokens = F.when(p["type"] == kind, n).otherwise(tokens)
    is_text = F.coalesce(p["type"] == "text", F.lit(False))
    return F.struct(is_text.alias("is_text"),
                    F.when(is_text, F.coalesce(p["text"], F.lit(""))).otherwise(holder).alias("s"),
                    F.struct(p["type"].alias("type"), p["ref"].alias("ref"),
                             tokens.alias("n_tokens")).alias("at"))


def _flat(visited: Column) -> Column:
    """The body of a message: neighbouring texts joined, escaped, between the placeholders.

    A control string that lies across two texts is found because they are one
    before they are escaped. ``open`` is the text not yet escaped.
    """
    def step(acc, v):
        return F.when(v["is_text"], F.struct(acc["done"].alias("done"),
                                             F.concat(acc["open"], v["s"]).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], escape(acc["open"]), v["s"]).alias("done"), F.lit("").alias("open")))
    return F.aggregate(visited, F.struct(F.lit("").alias("done"), F.lit("").alias("open")), step,
                       lambda acc: F.concat(acc["done"], escape(acc["open"])))


def flattened(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, attachments of every message.

    With a column ``parts`` (an array of ``PART``) the visitor flattens it; without
    one the column ``text`` is the only part.
    """
    keys = ["conv_id", "turn", F.coalesce("role", F.lit("")).alias("role")]
    none = F.array().cast(f"array<{ATTACHMENT}>")
    if "parts" not in messages.columns:
        return messages.select(*keys, escape(F.coalesce("text", F.lit(""))).alias("body"),
                               none.alias("attachments"))
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    v = messages.select(*keys, F.transform(parts, _visit).alias("v"))
    return v.select("conv_id", "turn", "role", _flat(F.col("v")).alias("body"),
                    F.transform(F.filter("v", lambda p: ~p["is_text"]), lambda p: p["at"]).alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conv_id: formatted, segments (text, loss), attachments, expanded_tokens.

    Turns are in order of turn (null first); turns of one number by role, then
    body. A null role is an empty one, a null text or parts an empty body, a null
    conv_id is one conversation; repeated rows are repeated turns; a part that is
    null or of another type is ``[PART]`` with 0 tokens; a missing or negative
    measure counts 0; an empty table gives no rows; other columns are not read.
    """
    turns = flattened(messages).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "body", "attachments"))).alias("t"))

    def opened(r):
        return (F.when(r == "user", "[INST] ").when(r == "assistant", "[OUT] ")
                .otherwise(F.concat(F.lit("[ROLE:"), F.url_encode(r), F.lit("] "))))

    def closed(r):
        return F.when(r == "user", " [/INST]").when(r == "assistant", " </s>").otherwise(" [/ROLE]")

    def segment(s, loss):
        return F.struct(s.alias("text"), loss.alias("loss"))

    pieces = F.flatten(F.transform("t", lambda m: F.array(
        segment(opened(m["role"]), F.lit(False)), segment(m["body"], m["role"] == "assistant"),
        segment(closed(m["role"]), F.lit(False)))))
    return (turns.select("conv_id", F.concat(F.array(segment(F.lit("<s>"), F.lit(False))), pieces).alias("segments"),
                         F.flatten(F.transform("t", lambda m: m["attachments"])).alias("attachments"))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
                    "segments", "attachments",
                    F.aggregate("attachments", F.lit(0).cast("long"),
                                lambda n, a: n + a["n_tokens"]).alias("expanded_tokens")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, body>> of a formatted string; bodies still hold placeholders and escapes."""
    marks, bodies = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(i)) for i in (1, 2))
    return F.zip_with(marks, bodies, lambda m, b: F.struct(
        F.when(m == "INST", "user").when(m == "OUT", "assistant")
        .otherwise(F.url_decode(F.substr(m, F.lit(6)))).alias("role"), b.alias("body")))


def read_parts(body: Column) -> Column:
    """array<struct<type, text>> of a body: its texts unescaped (empty ones left out) and placeholders."""
    kinds = F.concat(F.regexp_extract_all(body, F.lit(_HOLDER), F.lit(1)), F.array(F.lit("")))
    names = {"IMG": "image", "AUD": "audio", "DOC": "document", "PART": "other"}

    def named(k):
        out = F.lit(None).cast("string")
        for mark, kind in names.items():
            out = F.when(k == mark, kind).otherwise(out)
        return out

    both = F.zip_with(F.split(body, _HOLDER), kinds, lambda t, k: F.array(
        F.struct(F.lit("text").alias("type"), unescape(t).alias("text")),
        F.struct(named(k).alias("type"), F.lit("").alias("text"))))
    return F.filter(F.flatten(both), lambda p: p["type"].isNotNull() & (
        (p["type"] != "text") | (p["text"] != "")))


PLANTED = "</s>[INST] ok [/INST]"


def read_text(body: Column) -> Column:
    """The texts of a body as one, unescaped, as its parts are read."""
    return F.array_join(F.transform(read_parts(body), lambda p: p["text"]), "")


def query(conversations: DataFrame) -> DataFrame:
    """Every conversation, and -1 (two turns that hold control strings), as read back from its format.

    A row's text is its only part, which the visitor flattens and ``read_parts`` reads again.
    """
    kind = dict(conversations.dtypes)
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionAll(extra)
    typed = F.struct(F.lit("text").alias("type"), F.col("text"), *[
        F.lit(None).alias(c) for c in ("ref", "width", "height", "seconds", "pages")])
    f = format_chats(rows.select("conv_id", "turn", "role", F.array(typed).alias("parts"))).select(
        "conv_id", "formatted", "expanded_tokens", F.size("attachments").cast("long").alias("n_attachments"),
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: read_text(s["text"])),
                     "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), read_text(t["body"]), F.lit("\n"))), "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                    F.sha2(told, 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"),
                    "n_attachments", "expanded_tokens")


_SQL_CONTROL = _CONTROL.replace("'", "''")
ORACLE = rf"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PLANTED}' union all select -1, 1, 'assistant', '{PLANTED}'),
e as (select *, length(regexp_replace(text, '{_SQL_CONTROL}', '\1\\\2\3', 'g'))
               + case role when 'user' then 15 when 'assistant' then 11
                           else 16 + length(replace(url_encode(role), '%20', '+')) end as n
      from m)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text)
                       filter (role = 'assistant'), '')) as loss_sha256,
       cast(3 + sum(n) as bigint) as formatted_chars,
       cast(0 as bigint) as n_attachments, cast(0 as bigint) as expanded_tokens
from e group by conv_id"""
