import random

import sentencepiece

from airlens.llm import tokens
from tests.llm import helpers as H


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    return [len(x) for x in sp.encode([t or "" for t in texts])]


def test_counts_are_the_library():
    rnd = random.Random(2)
    al = "ab e.,\n▁ é日—'1\t\x00"
    texts = ["", " ", "  ", "a  b\n\n c ", "\n  x\n", "a" * 3000, "▁▁x y", "<s> <0x0A> </s> <unk>", "😀😀 x\x00y",
             "été, d'accord. é", "a.b,c;;!!  ...", "\t\tdef f(x):\r\n    return  x", "1234 56 7.8e9",
             "ab" * 700 + " " + "-" * 1000, "　x ​", "a\x00b  c\nd"]
    texts += ["".join(rnd.choice(al) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    m = tokens.RankMerger(tokens.vocabulary("piece_bpe_32k.model"))
    assert m.counts(texts) == library(texts)
    assert m.counts(texts) == library(texts)         # from the cache


def test_awkward_rows(spark):
    rows = H.awkward_rows()
    got = tokens.count_tokens(H.awkward(spark)).collect()
    want = [(str(r[0]), len((r[1] or "").encode()), n, n > 4096)
            for r, n in zip(rows, library([r[1] for r in rows]))]
    assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == sorted(want)
    assert any(r["over_limit"] for r in got)
    assert tokens.count_tokens(H.empty(spark)).count() == 0


def test_lengths_about_the_heap_threshold(monkeypatch):
    """Pre-tokens on both sides of LONG count as the library's; the pair table is built once."""
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(al) for _ in range(n))
             for n in range(tokens.LONG - 4, tokens.LONG + 5)
             for al in ("a", "ab", "etaoinshrdlu", "日本語中国人大学", "é😀x")]
    m = tokens.RankMerger(tokens.vocabulary("piece_bpe_32k.model"))
    table, ways = m.pair, []
    heap = m.merge_long
    monkeypatch.setattr(m, "merge_long", lambda s: ways.append(len(s)) or heap(s))
    assert m.counts(texts) == library(texts)
    assert ways and min(ways) == tokens.LONG + 1 and m.pair is table
