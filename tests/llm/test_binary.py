import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlens.llm import binary
from airlens.llm.common import scratch
from airlens.llm.tokens import vocabulary
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 256, 257, 3000])
@pytest.mark.parametrize("top", [1, 2, 100, 50_000, 1 << 20, 1 << 45])
def test_words_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n)
    ids[rng.random(n) < 0.3] = 0
    words, offs, escapes = binary.encode_runs(ids)
    assert (binary.decode_runs(words, escapes) == ids).all()
    for r in range(len(offs) - 1):                   # every run alone
        a, b = r * binary.RUN, min(n, (r + 1) * binary.RUN)
        before = int((ids[:a] >= 1 << 20).sum())
        inside = int((ids[a:b] >= 1 << 20).sum())
        got = binary.decode_runs(words[offs[r]:offs[r + 1]], escapes[before:before + inside])
        assert (got == ids[a:b]).all()


def library_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_are_the_library():
    rnd = random.Random(1)
    al = "ab E.,'sS\n▁ éÉ日1\t|<>́̌ʾJ!"
    texts = ["", "Hello World, it's <|endoftext|> x<|EndOfText|>.", "J̌ J̌x É É don't DON'T", "ΑΣ ΣΑΣ. İ ǅ",
             "a,b;c.d!! (x), 12.5", "日本 語。", "K Å ſ", "x***y a*** b.%% c,'s"]
    texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    raw = [t.encode() for t in texts]
    enc = binary.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    offs = np.r_[0, np.cumsum([len(r) for r in raw])]
    ids, at = enc.ids(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library_ids(texts)


def encoded(enc, texts):
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(r) for r in raw])]
    ids, at = enc.ids(np.frombuffer(b"".join(raw), np.uint8), offs)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_words_with_other_marks_are_encoded_once():
    """Marks at a word's end, an upper-case letter or another text need no further call of the library."""
    enc = binary.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["word straße été 7", "word, Word. WORD!! straße) été;", "7%, word*** straße."]
    assert encoded(enc, texts) == library_ids(texts)
    assert len(enc.chunks) == 4 + len([",", ".", "!!", ")", ";", "%,", "***"])


def test_frequent_chunks_outlast_others(monkeypatch):
    """A full cache lets chunks go that were met once; ids stay right, and what is kept stays bounded."""
    monkeypatch.setattr(binary, "_CHUNKS_MAX", 200)
    enc = binary.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    seen = []
    library = enc._together
    monkeypatch.setattr(enc, "_together", lambda t, words: seen.extend(words) or library(t, words))
    rnd = random.Random(2)
    for _ in range(20):
        rare = ["".join(rnd.choice("abcdeé") for _ in range(9)) for _ in range(50)]
        texts = ["often " + " ".join(rare[:25]), " ".join(rare[25:]) + " often."]
        assert encoded(enc, texts) == library_ids(texts)
        assert len(enc.chunks) <= 200
    assert seen.count("often") == 1


def test_long_tails_and_many_words():
    enc = binary.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["x" + "#" * k + " é" + "." * k + " ×" + "," * k + " 9" + "!" * k + "a." for k in range(40)]
    texts += [" ".join(f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnoß" for c in "pqrstuÀ日"), "ÿ÷. ÷÷ ªx. º."]
    assert encoded(enc, texts) == library_ids(texts)


def test_workers_keep_little_beside_the_ids():
    """A kept chunk costs tens of bytes, where Python's dicts and strings took some 200."""
    enc = binary.ChunkEncoder(vocabulary("word_bpe_49k.json"))
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(5000))]
    encoded(enc, texts)
    c = enc.chunks
    assert len(c) == len(set(texts[0].split()))
    assert sum(x.nbytes for x in (c.keys, c.begin, c.length, c.again, c.pool)) < 40 * len(c)


def brute(rows):
    """(doc_id, n, crc) in order of doc_id (null first), and the starts."""
    out = []
    for (i, *_), ids in zip(rows, library_ids([t for _, t in rows])):
        x = np.array([*ids, 1], "<u4")
        out.append((i, len(x), zlib.crc32(x.tobytes())))
    return out


@pytest.mark.parametrize("block_ids", [50, 1 << 17])
def test_store_reads_back(spark, block_ids):
    rows = [(r[0], r[1]) for r in H.awkward_rows()]
    path = scratch(spark, "store")
    binary.write_store(H.awkward(spark), path, block_ids=block_ids)
    got = binary.read_store(spark.read.schema(binary.BLOCKS).parquet(path)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (str(i), n, c) for i, n, c in brute(rows))
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert order == sorted(order)


def test_query_on_documents_and_empty(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    got = sorted(tuple(r) for r in binary.query(docs).collect())
    start, want = 0, []
    for i, n, c in brute(rows):
        want.append((i, start, n, c))
        start += n
    assert got == want
    assert binary.query(H.empty(spark)).count() == 0


@pytest.mark.parametrize("kind", ["string", "int"])
def test_doc_id_keeps_its_type(spark, kind):
    rows = [("1", "one two"), (None, "three"), ("20", None), ("20", "a  b"), ("3", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = binary.query(docs)
    assert dict(got.dtypes)["doc_id"] == kind
    to = int if kind == "int" else str
    want = [(None if i is None else to(i), t or "") for i, t in rows]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(
        (str(i), n, c) for i, n, c in brute(want))
