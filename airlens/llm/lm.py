"""Operator 5: language-model scores of whole documents.

Words are counted over all training documents (a distributed sum). The
``VOCABULARY`` commonest are the outcomes of a gated recurrent model beside the
end of a text and "another word"; another word's probability is the model's for
that outcome times the word's smoothed share among such words. Every partition
trains a copy of the model on all its training documents and the copies are
averaged by their tokens, in a tree; scoring is one pass over all documents.

A word's count is looked up in a broadcast table of the words that come most
often, at most ``TABLE`` of them; the counts of rarer words are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import slices, utf8, word_hashes
from airlens.llm.gru import Gru
from airlens.session import ensure_checkpoint_dir

VOCABULARY = 1022
TABLE = 1 << 20           # most entries of the broadcast table of counts
BUFFER = 4_000_000        # tokens that a task holds at once
FAN_IN = 16
END = np.uint64(1)        # the end of a text, among the hashes of words


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 7, is 2 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of each text and its end."""
    h, at = word_hashes(*utf8(batch.column("text")))
    return np.insert(h, at[1:], END), at + np.arange(len(at))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = (np.empty(0, np.uint64), np.empty(0, np.int64))

    def out(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)],
                                          names=["h", "c"])

    for batch in batches:
        for part in slices(batch):
            h, _ = tokens_of(part)
            code, keys = pd.factorize(h)
            keys = np.concatenate([held[0], keys])
            counts = np.concatenate([held[1], np.bincount(code)])
            code, keys = pd.factorize(keys)
            held = keys, np.bincount(code, weights=counts).astype(np.int64)
            if len(keys) > 2_000_000:
                yield out(*held)
                held = (np.empty(0, np.uint64), np.empty(0, np.int64))
    if len(held[0]):
        yield out(*held)


def count_words(train: DataFrame) -> DataFrame:
    """(h, c) of every distinct token of the training texts."""
    return (train.select("text").mapInArrow(_count, "h long, c long")
            .groupBy("h").agg(F.sum("c").alias("c")))


class Counts:
    """The broadcast part of the counts, and the model's vocabulary."""

    def __init__(self, keys, counts, total, distinct, vocabulary):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        self.total, self.distinct = int(total), int(distinct)
        words = np.flatnonzero(self.keys != END)
        top = words[np.lexsort((self.keys[words], -self.counts[words]))[:vocabulary]]
        self.v = len(top) + 2
        self.number = np.full(len(self.keys) + 1, self.v - 1, np.int32)   # the last: not found
        self.number[top] = np.arange(len(top))
        end = np.flatnonzero(self.keys == END)
        self.number[end] = self.v - 2
        ends = int(self.counts[end].sum())
        inside = int(self.counts[top].sum()) + ends
        self.rest_tokens = self.total - inside
        self.rest_distinct = self.distinct - len(top) - len(end)
        self.freq = np.r_[self.counts[top], ends, self.rest_tokens].astype(np.float64)
        self.logs = np.r_[np.log10(self.counts + 1.0), 0.0]

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each token, or the row after the last; token number in the model)."""
        code, distinct = pd.factorize(h)
        n = len(self.keys)
        at = np.searchsorted(self.keys, distinct)
        at[at == n] = 0
        row = np.where(self.keys[at] == distinct, at, n) if n else np.full(len(distinct), 0)
        number = self.number[row]
        number[distinct == END] = self.v - 2
        return row[code], number[code]


def table_of(counts: DataFrame, most: int = TABLE, vocabulary: int = VOCABULARY) -> tuple[Counts, int]:
    """(the bounded table, the smallest count it holds): all words from that count on."""
    by = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    # one row per distinct count: their number grows as the square root of the tokens
    by = sorted(((r["c"], r["n"]) for r in by.collect()), reverse=True)
    total, distinct = sum(c * n for c, n in by), sum(n for _, n in by)
    least, size = (by[0][0] + 1 if by else 1), 0
    for c, n in by:
        if size + n > most:
            break
        least, size = c, size + n
    got = counts.filter(F.col("c") >= least).toArrow()       # ``most`` rows at most
    keys = got.column("h").to_numpy().astype(np.int64).view(np.uint64)
    end = counts.filter(F.col("h") == int(END)).toArrow()    # the end is always in the table
    if end.num_rows and int(END) not in keys:
        keys = np.append(keys, END)
        got = pa.concat_tables([got, end])
    return Counts(keys, got.column("c").to_numpy().astype(np.int64), total, distinct, vocabulary), least


def _buffers(batches, columns):
    """(columns' values, hashes, offsets) of as many rows as have ``BUFFER`` tokens."""
    vals, hs, n = {c: [] for c in columns}, [], []
    for batch in batches:
        for part in slices(batch):
            h, at = tokens_of(part)
            for c in columns:
                vals[c].append(part.column(c))
            hs.append(h)
            n.append(np.diff(at))
            if sum(map(len, hs)) >= BUFFER:
                yield vals, np.concatenate(hs), np.concatenate(n)
                vals, hs, n = {c: [] for c in columns}, [], []
    if hs:
        yield vals, np.concatenate(hs), np.concatenate(n)


def _offsets(n: np.ndarray) -> np.ndarray:
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=out[1:])
    return out


def _trainer(counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        g, seen = Gru(table.freq), 0
        for _, h, n in _buffers(batches, []):
            g.run(table.look(h)[1], _offsets(n), train=True)
            seen += len(h)
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([(g.vector().astype(np.float64) * seen).tobytes()], pa.binary()),
                 pa.array([float(seen)])], names=["w", "n"])
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    w, n = None, 0.0
    for batch in batches:
        for x, m in zip(batch.column("w"), batch.column("n").to_pylist()):
            v = np.frombuffer(x.as_py(), np.float64)
            w, n = (v.copy() if w is None else w + v), n + m
    if w is not None:
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([n])],
                                         names=["w", "n"])


def train_model(train: DataFrame, counts) -> np.ndarray | None:
    """The averaged weights: sums of weights times tokens, ``FAN_IN`` to one until few are left."""
    schema = "w binary, n double"
    parts = train.select("text").mapInArrow(_trainer(counts), schema).checkpoint()
    n = parts.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_add, schema)
    w, total = None, 0.0
    for r in parts.toLocalIterator():
        v = np.frombuffer(r["w"], np.float64)
        w, total = (v if w is None else w + v), total + r["n"]
    return None if w is None else (w / total).astype(np.float32)


_SCORED = ("doc_id {kind}, held_out boolean, n_tokens long, known long, local double, other long, "
           "lm double, other_local double, rare array<struct<h:long,tf:long>>")


def _scorer(counts, weights):
    rare_type = pa.list_(pa.struct([("h", pa.int64()), ("tf", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        g = Gru(table.freq)
        if weights.value is not None:
            g.load(weights.value)
        none = len(table.keys)
        for vals, h, n in _buffers(batches, ["doc_id", "held_out"]):
            offs = _offsets(n)
            row, number = table.look(h)
            doc = np.repeat(np.arange(len(n)), n)
            lm = g.run(number, offs) / np.log(10)
            logs, found = table.logs[row], row < none
            other = number == table.v - 1
            missing = np.flatnonzero(~found & (h != END))
            # the distinct words outside the table, text by text
            pair = np.lexsort((h[missing], doc[missing]))
            m = missing[pair]
            new = np.flatnonzero(np.r_[True, (doc[m][1:] != doc[m][:-1]) | (h[m][1:] != h[m][:-1])]) \
                if len(m) else np.empty(0, np.int64)
            tf = np.diff(np.r_[new, len(m)])
            each = pa.StructArray.from_arrays([pa.array(h[m[new]].view(np.int64)), pa.array(tf)],
                                              names=["h", "tf"])
            at = np.searchsorted(doc[m[new]], np.arange(len(n) + 1)).astype(np.int32)
            size = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(vals["doc_id"]), pa.concat_arrays(vals["held_out"]), pa.array(n),
                 pa.array(np.bincount(doc, weights=found, minlength=size).astype(np.int64)),
                 pa.array(np.bincount(doc, weights=logs, minlength=size)),
                 pa.array(np.bincount(doc, weights=other, minlength=size).astype(np.int64)),
                 pa.array(lm), pa.array(np.bincount(doc, weights=logs * other, minlength=size)),
                 pa.ListArray.from_arrays(pa.array(at), each).cast(rare_type)],
                names=["doc_id", "held_out", "n_tokens", "known", "local", "other", "lm",
                       "other_local", "rare"])
    return run


def score_documents(docs: DataFrame, vocabulary: int = VOCABULARY, most: int = TABLE) -> DataFrame:
    """One row per document: the base (add-one unigram) and the model's log10 probability.

    ``n_known`` counts tokens that training holds. A null or empty text is the end
    alone. A null doc_id is a training document. Without any training document the
    counts are 0 and the model is untrained. Repeated rows each get a row; an empty
    table gives none; other columns are not read. Texts are learned from and scored
    whole, whatever their length.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                       F.coalesce("text", F.lit("")).alias("text"))
    train = rows.filter(~F.col("held_out"))
    counts = count_words(train).checkpoint()
    table, least = table_of(counts, most, vocabulary)
    shared = spark.sparkContext.broadcast(table)
    weights = spark.sparkContext.broadcast(train_model(train, shared))
    scored = rows.mapInArrow(_scorer(shared, weights), _SCORED.format(kind=kind)).checkpoint()
    scored = scored.withColumn("row", F.monotonically_increasing_id())
    rare = (scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.tf")
            .join(counts.filter(F.col("c") < least), "h")
            .groupBy("row").agg(F.sum("tf").alias("more"),
                                F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs")))
    n, v = table.total, table.distinct
    more_logs, known = F.coalesce("more_logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    base = F.col("local") + more_logs - F.col("n_tokens") * float(np.log10(n + v + 1))
    rest = float(np.log10(table.rest_tokens + table.rest_distinct + 1))
    lm = F.col("lm") + F.col("other_local") + more_logs - F.col("other") * rest
    return (scored.drop("rare").join(rare, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + known).alias("n_known"),
                    F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
                    lm.alias("score")))

