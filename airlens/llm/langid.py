"""Operator 10: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character
n-grams (1 to 3 characters, ASCII and other letters lowered), trained with
follow-the-regularised-leader and elastic-net penalties, then calibrated by one
temperature. Document frequencies are counted over all training documents; the
regression is fitted on at most ``PER_LANG`` distinct training texts of each
language (those of smallest hash; fewer if there are more than ``TOTAL //
PER_LANG`` languages), of which every fifth calibrates. Prediction
is one pass over whole texts: the logits are sums of per-gram weights.

A text is in a language if it is made of known n-grams (those in at least
``COMMON`` of the fitting texts of some language): their share must reach ``KNOWN`` of the median share that the
calibration texts of the predicted language have. No confidence tells that: the
softmax of a text of unknown n-grams is as sharp as any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm.common import returning, slices
from airlens.session import ensure_checkpoint_dir

BUCKETS = 1 << 15
GRAMS = (1, 2, 3)
PER_LANG = 600            # bound of the fitting sample, per language
TOTAL = 24_000            # bound of the fitting sample over all languages, but FEWEST of each stay
FEWEST = 5
KNOWN = 0.8               # share of known n-grams, against the calibration texts' median, below which a text is of no language
COMMON = 0.005            # share of a language's fitting texts that hold a known n-gram
ENOUGH = 10               # calibration texts in all below which nothing is known well enough to reject by it
LEAST = 0.0               # least confidence; none is asked for, as it depends on the number of languages
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.01, 0.01
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))


def grams_of(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, offsets, texts): the n-gram buckets of pieces of texts, about ``most`` characters at once.

    Row r of the offsets is a piece of text number ``texts[r]``; a longer text
    comes in several pieces, each n-gram in the one where it begins. A place past
    the end of a text has bucket ``BUCKETS``, whose weight is 0.
    """
    reach = max(GRAMS) - 1
    held, own, size = [], [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        for a in range(0, max(len(low), 1), most):
            held.append((low[a:a + most + reach], min(most, len(low) - a)))
            own.append(i)
            size += held[-1][1]
            if size >= most:
                yield *_hashed(held), np.array(own)
                held, own, size = [], [], 0
    if held:
        yield *_hashed(held), np.array(own)


def _hashed(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that begin in the first ``n`` characters of each (piece, n)."""
    code = np.frombuffer("".join(p for p, _ in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(p) for p, _ in pieces], np.int64)
    begins = np.array([n for _, n in pieces], np.int64)
    stop = np.cumsum(size)
    end = np.repeat(stop, size)
    place = np.arange(len(code))
    out = np.empty((len(code), len(GRAMS)), np.int32)
    acc = np.zeros(len(code), np.uint32)
    for j, f in zip(range(max(GRAMS)), _FACTORS):
        acc = acc.copy()
        m = len(code) - j
        acc[:max(m, 0)] = (acc[:max(m, 0)] + code[j:]) * f
        x = acc ^ (acc >> np.uint32(15))
        out[:, j] = (x * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 15)
        out[place + j >= end, j] = BUCKETS
    if (begins < size).any():
        out = out[place < np.repeat(stop - size + begins, size)]
    offs = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum(begins * len(GRAMS), out=offs[1:])
    return out.ravel(), offs


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4, is 2 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for part in returning(slices(batch, most=1 << 20)):
            n += part.num_rows
            now, seen = -1, np.zeros(BUCKETS + 1, bool)
            for b, offs, own in grams_of(_texts(part)):
                for r, i in enumerate(own.tolist()):
                    if i != now:
                        df += seen
                        now, seen = i, np.zeros(BUCKETS + 1, bool)
                    seen[b[offs[r]:offs[r + 1]]] = True
            df += seen
    if n:
        df[BUCKETS] = n                             # the last row counts documents
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["b", "df"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        for part in returning(slices(batch, most=1 << 20)):
            sums = [np.zeros(BUCKETS + 1, np.int64)] * part.num_rows
            for b, offs, own in grams_of(_texts(part)):
                for r, i in enumerate(own.tolist()):
                    sums[i] = sums[i] + np.bincount(b[offs[r]:offs[r + 1]], minlength=BUCKETS + 1)
            at, num = [], []
            for c in sums:
                c = c[:BUCKETS]
                k = np.flatnonzero(c)
                at.append(k.astype(np.int32))
                num.append(c[k].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("key"), part.column("lang"), pa.array(at, kind), pa.array(num, kind)],
                names=["key", "lang", "at", "num"])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int,
             ) -> tuple[np.ndarray, np.ndarray]:
    """(weights [BUCKETS, classes], bias) by FTRL-proximal with L1 and L2."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zi, ni):
        w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        return np.where(np.abs(zi) > L1, w, 0.0)

    rng = np.random.default_rng(10)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            k, v = np.append(at, BUCKETS), np.append(x, 1.0)     # the last coordinate is the bias
            w = weights(z[k], n[k])
            p = _softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            s = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            z[k] += g - s * w
            n[k] += g * g
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-300).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


class Model:
    """Per-gram logit weights (idf and scale folded in), bias, temperature, languages,
    the known n-grams and the least share of them that a text of each language has."""

    def __init__(self, langs, table, bias, heat, known, floor):
        self.langs, self.table, self.bias, self.heat = langs, table, bias, heat
        self.known, self.floor = known, floor

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; ``und`` and 0 without a letter or a model."""
        return self._told(texts, None)[:2]

    def told(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """``predict``, and whether enough of each text's n-grams are known.

        A share of n n-grams is uncertain by half of 1 / sqrt(n) at most; twice that
        is allowed for, so that a short text does not go by chance.
        """
        lang, score, share, total, best = self._told(texts, self.known)
        if not self.langs:
            return lang, score, np.zeros(len(texts), bool)
        return lang, score, share + 1 / np.sqrt(total) >= self.floor[best]

    def _told(self, texts, known):
        ok = np.array([has_letter(t) for t in texts], bool)
        z, total = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        if not self.langs or not ok.any():
            return ["und"] * len(texts), total, total, total + 1, np.zeros(len(texts), np.int64)
        found = np.zeros(len(texts))
        for b, offs, own in grams_of([t if k else "a" for t, k in zip(texts, ok)]):
            np.add.at(total, own, np.add.reduceat(b < BUCKETS, offs[:-1], dtype=np.int64))
            if known is not None:
                np.add.at(found, own, np.add.reduceat(known[b], offs[:-1], dtype=np.int64))
            for c in range(len(self.langs)):
                np.add.at(z[:, c], own, np.add.reduceat(self.table[:, c][b], offs[:-1], dtype=np.float64))
        p = _softmax((z / total[:, None] + self.bias) / self.heat)
        best = p.argmax(axis=1)
        lang = [self.langs[i] if k else "und" for i, k in zip(best.tolist(), ok.tolist())]
        return lang, np.where(ok, p[np.arange(len(p)), best], 0.0), found / total, total, best


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Learn from text and lang of the documents that are not held out."""
    ensure_checkpoint_dir(docs.sparkSession)
    train = (docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                         & F.col("text").rlike(r"\p{L}"))
             .select("text", F.col("lang").cast("string").alias("lang"),
                     F.xxhash64("text").alias("key")))
    df = train.select("text").mapInArrow(_frequencies, "b long, df long").groupBy("b").agg(
        F.sum("df").alias("df")).collect()          # BUCKETS + 1 rows at most
    freq = np.zeros(BUCKETS + 1)
    for r in df:
        freq[r["b"]] = r["df"]
    idf = np.log((1 + freq[BUCKETS]) / (1 + freq[:BUCKETS])) + 1
    # keys are uniform, so about 4 * per_lang of a language are below its threshold, and only
    # those meet to be ranked; a common language is no hot key
    names = train.select("key", "lang").distinct().checkpoint()
    labels = names.select("lang").distinct().count()
    per_lang = min(per_lang, max(FEWEST, TOTAL // max(labels, 1)))
    share = names.groupBy("lang").agg((F.lit(4.0 * per_lang) / F.count(F.lit(1))).alias("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    low = F.col("key").cast("double") / float(1 << 63) * 0.5 + 0.5 <= F.col("share")
    picked = (names.join(F.broadcast(share), "lang").filter(low).withColumn("r", rank)
              .filter(F.col("r") <= per_lang).select("key", "lang"))
    sample = (train.join(F.broadcast(picked), ["key", "lang"]).select("key", "lang", "text")
              .mapInArrow(_counts, "key long, lang string, at array<int>, num array<int>")
              .dropDuplicates(["key", "lang"]).toPandas())      # per_lang rows a language
    sample = sample.sort_values(["key", "lang"], kind="stable").reset_index(drop=True)
    langs = sorted(set(sample["lang"]))
    if not langs:
        return Model([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0), 1.0,
                     np.zeros(BUCKETS + 1, bool), np.zeros(0))
    index = {lang: i for i, lang in enumerate(langs)}
    rows = []
    for at, num, lang in zip(sample["at"], sample["num"], sample["lang"]):
        at, num = np.asarray(at, np.int64), np.asarray(num, np.float64)
        rows.append((at, num / num.sum() * idf[at], index[lang]))
    scale = 1.0 / np.mean([np.linalg.norm(x) for _, x, _ in rows])
    rows = [(at, x * scale, y) for at, x, y in rows]
    fold = [r for i, r in enumerate(rows) if i % 5] or rows
    w, bias = fit_ftrl(fold, len(langs))
    check = rows[::5]
    heat = temperature(np.array([x @ w[at] + bias for at, x, _ in check]),
                       np.array([y for _, _, y in check]))
    table = np.zeros((BUCKETS + 1, len(langs)), np.float32, order="F")
    table[:BUCKETS] = w * (idf * scale)[:, None]
    # by texts, not by weights: of a single language no weight is learned
    seen, texts = np.zeros((BUCKETS + 1, len(langs)), np.int32), np.zeros(len(langs))
    for at, _, y in fold:
        seen[at, y] += 1
        texts[y] += 1
    known = (seen >= np.maximum(1, COMMON * texts)).any(axis=1)
    share = np.array([num[known[at]].sum() / num.sum() for at, num in (
        (np.asarray(a, np.int64), np.asarray(c, np.int64)) for a, c in zip(sample["at"][::5], sample["num"][::5]))])
    own = np.array([y for _, _, y in check])
    # a language without a calibration text rejects nothing
    floor = np.array([KNOWN * np.median(share[own == c]) if (own == c).any() and len(own) >= ENOUGH else 0.0
                      for c in range(len(langs))])
    return Model(langs, table, bias, heat, known, floor)


def _predictor(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in returning(slices(batch, most=1 << 19)):
                lang, score = m.predict(_texts(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()),
                     pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])
    return run


def identify(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, from the text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every
    row if nothing was labelled. A null doc_id is never held out. Repeated rows
    each get a row; an empty table gives none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, per_lang))
    kind = dict(docs.dtypes)["doc_id"]
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
            .mapInArrow(_predictor(model),
                        f"doc_id {kind}, held_out boolean, lang_pred string, score double"))


def identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` without the rows of no language: no letter, or too few known n-grams.

    ``least`` is a confidence that a caller may ask for besides.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in returning(slices(batch, most=1 << 19)):
                lang, score, known = m.told(_texts(part))
                yield part.filter(pa.array([bool(a != "und" and b >= least and c)
                                            for a, b, c in zip(lang, score, known)], pa.bool_()))
    return docs.mapInArrow(keep, docs.schema)
