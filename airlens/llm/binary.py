"""Operator 3: token ids in Simple-8b word-aligned blocks.

File format. A store is a table of blocks in ascending document order. A block
holds whole documents (about ``BLOCK_IDS`` ids; one at least) as

* ``doc_ids`` / ``n_tokens``: the documents and their lengths,
* ``words``: the ids of all its documents as little-endian 64-bit words. The top
  4 bits of a word are its selector, the low 60 bits hold values of equal width,
  the first value lowest. Ids are coded in runs of ``RUN`` so that a run can be
  decoded alone,
* ``run_offsets``: the first word of each run (and the end), for decoding many
  runs at once or one document out of the middle,
* ``escapes``: values of 2**20 and more, in order of place. Their slot holds 0 in
  a word of selector 15, which holds that one escape.

Selectors 0 to 13 pack 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2 or 1 values.
A block is a row of a Parquet table, so writing is atomic, survives a lost
executor, and reads from any store that Spark reads.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlens.llm.common import LOWER, find_words, kept, partitions, returning, scratch, slices, utf8

COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
RUN = 256
BLOCK_IDS = 1 << 17
END_ID = 1
_CHUNKS_MAX = 1_000_000   # about 30 bytes each
_TOGETHER = 512           # words that the library encodes as one text
SLICE = 2 << 20           # bytes of text encoded at a time

# letters and a run of these marks, which starts no contraction, are two pre-tokens
_MARKS = np.isin(np.arange(256), list(b".,;:!?|)*$&%#"))
_LETTER = np.isin(np.arange(256), np.arange(0x61, 0x7B))
_LATIN = re.compile("[a-zß-öø-ÿ]+")
_ODD = np.isin(np.arange(256), (0xCA, 0xCC, 0xCD))
_BITS = np.array([max(1, x.bit_length()) for x in range(1 << 16)], np.uint8)



def blocks(kind: str = "bigint") -> str:
    """Columns of the store's files for documents whose doc_id has this type."""
    return (f"part int, block int, start_in_part long, doc_ids array<{kind}>, n_tokens array<int>, "
            "run_offsets array<int>, words binary, escapes array<long>")


BLOCKS = blocks()


def encode_runs(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, run offsets, escapes) of non-negative integers, all runs in step."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    runs = -(-n // RUN)
    if not n:
        return np.empty(0, np.uint64), np.zeros(1, np.int32), np.empty(0, np.int64)
    big = ids >= np.uint64(1 << 20)
    value = np.zeros(n + 60, np.uint64)
    value[:n] = np.where(big, np.uint64(0), ids)
    # bits of each value; 61 (an escape, or the end of its run) fits in no width
    low = value[:n].astype(np.int64)
    bits = np.full(n + 60, 61, np.uint8)
    bits[:n] = np.maximum(_BITS[low & 0xFFFF], np.where(low >> 16, _BITS[low >> 16] + 16, 0))
    bits[:n][big] = 61
    # the widest of the c values from each place on, and from it the best selector there
    worst, sel = {1: bits}, np.full(n, ESCAPE, np.uint8)
    for c in (2, 4, 8, 16, 32):
        w, h = worst[c // 2].copy(), c // 2
        w[:-h] = np.maximum(w[:-h], worst[h][h:])
        worst[c] = w
    seen = np.cumsum(np.bincount(bits[:n], minlength=62))
    left = (RUN - np.arange(n, dtype=np.int32) % RUN).astype(np.int32)
    for s in range(len(COUNTS) - 1, -1, -1):
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        if seen[w] < c:
            continue
        h = 1 << (c.bit_length() - 1)
        most = worst[h][:n] if h == c else np.maximum(worst[h][:n], worst[h][c - h:n + c - h])
        sel[(most <= w) & (left >= c)] = s
    step = np.r_[COUNTS, 1, 1][sel]
    pos = np.arange(runs, dtype=np.int64) * RUN
    stop = np.minimum(pos + RUN, n)
    begins = np.zeros(n, bool)
    while len(pos):                          # all runs take one word a step
        begins[pos] = True
        pos = pos + step[pos]
        more = pos < stop
        pos, stop = pos[more], stop[more]
    at = np.flatnonzero(begins)
    chosen = sel[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if s == ESCAPE:
            continue
        k = np.flatnonzero(chosen == s)
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        for j in range(c):
            words[k] |= value[at[k] + j] << np.uint64(j * w)
    offs = np.searchsorted(at, np.minimum(np.arange(runs + 1) * RUN, n)).astype(np.int32)
    return words, offs, ids[big].astype(np.int64)


def decode_runs(words: np.ndarray, escapes: np.ndarray | None = None) -> np.ndarray:
    """All ids of consecutive words, selector by selector."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    count = np.where(sel == ESCAPE, 1, COUNTS[np.minimum(sel, len(COUNTS) - 1)])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    for s in np.unique(sel):
        k = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[at[k]] = escapes
            continue
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        v = (words[k][:, None] >> (np.arange(c, dtype=np.uint64) * np.uint64(w))) \
            & np.uint64((1 << w) - 1)
        out[at[k][:, None] + np.arange(c)] = v
    return out


class Chunks:
    """Ids of chunks by their hashes, in arrays: the hashes in order, and where each chunk's ids stand."""

    def __init__(self, kind):
        self.keys, self.begin, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.again = np.empty(0, bool)       # met since it was kept
        self.pool = np.empty(0, kind)

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether it is kept) of ascending keys."""
        place = np.searchsorted(self.keys, keys)
        old = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        old[inside] = self.keys[place[inside]] == keys[inside]
        self.again[place[old]] = True
        return place, old

    def keep(self, keys: np.ndarray, ids: np.ndarray, begin: np.ndarray, number: np.ndarray, most: int) -> None:
        """Keep more chunks (keys ascending); over ``most`` those that were met once are let go first."""
        if len(self.keys) + len(keys) > most:
            stay = np.flatnonzero(self.again)
            if len(stay) > most // 2:
                stay = stay[:0]
            size = self.length[stay].astype(np.int64)
            to = np.cumsum(size) - size
            self.pool = self.pool[np.repeat(self.begin[stay] - to, size) + np.arange(size.sum())]
            self.keys, self.begin, self.length = self.keys[stay], to, self.length[stay]
            self.again = np.zeros(len(stay), bool)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.begin = np.insert(self.begin, where, begin + len(self.pool))
        self.length = np.insert(self.length, where, number)
        self.again = np.insert(self.again, where, False)
        self.pool = np.concatenate([self.pool, ids])


class ChunkEncoder:
    """Token ids of whole texts from a tokenizers file, by distinct chunks.

    The tokenizer's pre-tokenizer drops white space, parts letters and digits from
    marks, and no special token holds white space; so a text's ids are those of its
    words, each without the marks at its end, and of these marks, in order. The
    library encodes only chunks that a worker does not keep. Chunks are told apart
    by 64-bit hashes of their bytes with ASCII letters lowered, as the tokenizer
    lowers them; a text where that could differ (a combining mark that might
    compose with a lowered letter, the start of a special token) is encoded whole.
    In words of a to z and small Latin-1 letters only, the tokenizer's normaliser
    changes nothing and its pre-tokenizer cuts at spaces alone, so they go to the
    library's model with that rule in their place.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit
        self.t = Tokenizer.from_file(file)
        self.plain = Tokenizer(self.t.model)
        self.plain.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.t.get_vocab_size() + 1, bool)
        for piece, i in self.t.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.chunks = Chunks(self.kind)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for i in range(0, len(texts), 4096)
                for e in self.t.encode_batch_fast(texts[i:i + 4096], add_special_tokens=False)]

    def _together(self, tokenizer, words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
        """(place of the first, ids, numbers of ids) of many words at a time; no numbers if one is several pre-tokens."""
        for i in range(0, len(words), _TOGETHER):
            some = words[i:i + _TOGETHER]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            one_each = len(cut) == len(some) and cut[-1] == len(ids)
            yield i, ids, np.diff(cut, prepend=0) if one_each else None

    def _encoded(self, raw: bytes, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, where they begin, number of ids) of the chunks at these places."""
        at = np.cumsum(size) - size
        d = data[np.repeat(start - at, size) + np.arange(size.sum())]
        plain = np.bitwise_and.reduceat(_LETTER[LOWER[d]] | (d >= 0x80), at)
        high = np.bitwise_or.reduceat(d >= 0x80, at)
        words = [raw[a:b].lower().decode("utf-8") for a, b in zip(start.tolist(), (start + size).tolist())]
        latin = np.zeros(len(at), bool)
        latin[high] = [_LATIN.fullmatch(words[i]) is not None for i in np.flatnonzero(high).tolist()]
        alpha = np.zeros(len(at), bool)
        alpha[high & ~latin] = [words[i].isalpha() for i in np.flatnonzero(high & ~latin).tolist()]
        number = np.zeros(len(at), np.int64)
        found, order, rest = [], [], [np.flatnonzero(~(plain & ~high | latin | alpha))]
        for tokenizer, group in ((self.plain, np.flatnonzero(plain & ~high | latin)), (self.t, np.flatnonzero(alpha))):
            for i, ids, n in self._together(tokenizer, [words[k] for k in group.tolist()]):
                own = group[i:i + _TOGETHER]
                if n is None:
                    rest.append(own)
                    continue
                number[own] = n
                found.append(ids)
                order.append(own)
        other = np.concatenate(rest)
        whole = self._library([words[k] for k in other.tolist()])
        number[other] = [len(x) for x in whole]
        order = np.concatenate([*order, other])
        begin = np.empty(len(at), np.int64)
        begin[order] = np.cumsum(number[order]) - number[order]
        return np.concatenate([*found, *whole]).astype(self.kind), begin, number

    def ids(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of many texts given as bytes and offsets."""
        n, raw = len(offs) - 1, data.tobytes()
        odd = _ODD[data]
        odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
        doc = np.unique(np.searchsorted(offs, np.flatnonzero(odd), "right") - 1).tolist()
        h, at, start, size = find_words(data, offs, tail=_MARKS)
        code, distinct = pd.factorize(h)
        by = np.argsort(distinct)
        chunks = self.chunks
        place, old = chunks.find(distinct[by])
        begin, length = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
        begin[by[old]], length[by[old]] = chunks.begin[place[old]], chunks.length[place[old]]
        pool, new = chunks.pool, by[~old]
        if len(new):
            some = np.empty(len(distinct), np.int64)
            some[code[::-1]] = np.arange(len(h) - 1, -1, -1)
            ids, first, number = self._encoded(raw, data, start[some[new]], size[some[new]])
            begin[new], length[new] = first + len(pool), number
            pool = np.concatenate([pool, ids])
            chunks.keep(distinct[new], ids, first, number, _CHUNKS_MAX)
        per = length[code]
        to = np.zeros(len(h) + 1, np.int64)
        np.cumsum(per, out=to[1:])
        out = pool[np.repeat(begin[code] - to[:-1], per) + np.arange(to[-1])].astype(np.uint32)
        bounds = to[at]
        if doc:                              # texts that have to be encoded whole
            whole = self._library([raw[offs[d]:offs[d + 1]].decode("utf-8") for d in doc])
            parts, a = [], 0
            count = np.diff(bounds)
            for d, x in zip(doc, whole):
                parts += [out[a:bounds[d]], x]
                a, count[d] = bounds[d + 1], len(x)
            out = np.concatenate([*parts, out[a:]])
            bounds = np.zeros(n + 1, np.int64)
            np.cumsum(count, out=bounds[1:])
        return out, bounds


def _block(part, block, start, doc_ids, lengths, ids, kind) -> pa.RecordBatch:
    words, offs, escapes = encode_runs(ids)
    one = [part, block, start, doc_ids, lengths, offs, words.astype("<u8").tobytes(), escapes]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(kind), pa.list_(pa.int32()),
             pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(one, kinds)],
                                      names=["part", "block", "start_in_part", "doc_ids", "n_tokens",
                                             "run_offsets", "words", "escapes"])


def _writer(file: str | None, end_id: int | None, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from airlens.llm.tokens import vocabulary
        part = TaskContext.get().partitionId()
        name = file or vocabulary("word_bpe_49k.json")
        enc = kept(name, lambda: ChunkEncoder(name))
        end = np.array([] if end_id is None else [end_id], "<u4")
        block = start = held = 0
        docs, parts, size = [], [], []
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for piece in returning(slices(batch, most=SLICE), keep=name):
                ids, at = enc.ids(*utf8(piece.column("text")))
                n = np.diff(at) + len(end)
                names = piece.column("doc_id").to_pylist()
                # as many whole documents a block as reach block_ids
                a = 0
                while a < len(n):
                    run = held + np.cumsum(n[a:])
                    b = min(len(n), a + int(np.searchsorted(run, block_ids)) + 1)
                    x = ids[at[a]:at[b]]
                    parts.append(np.insert(x, np.repeat(at[a + 1:b + 1] - at[a], len(end)),
                                           np.tile(end, b - a)) if len(end) else x)
                    docs += names[a:b]
                    size += n[a:b].tolist()
                    held += int(n[a:b].sum())
                    if held >= block_ids:
                        yield _block(part, block, start, docs, size, np.concatenate(parts), kind)
                        block, start, held, docs, parts, size = block + 1, start + held, 0, [], [], []
                    a = b
        if docs:
            yield _block(part, block, start, docs, size, np.concatenate(parts), kind)
    return write


def write_store(docs: DataFrame, path: str, file: str | None = None, end_id: int | None = END_ID,
                block_ids: int = BLOCK_IDS) -> None:
    """Encode every text whole and write the blocks in ascending doc_id order.

    Documents are range-partitioned by doc_id (null first); rows with one doc_id
    stay together, in order of their text. Each partition becomes one file.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    (rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
     .mapInArrow(_writer(file, end_id, block_ids), blocks(dict(docs.dtypes)["doc_id"])).write.parquet(path))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            row = {c: batch.column(c)[r] for c in batch.schema.names}
            ids = decode_runs(np.frombuffer(row["words"].as_py(), "<u8"),
                              np.array(row["escapes"].as_py(), np.int64)).astype("<u4")
            n = np.array(row["n_tokens"].as_py(), np.int64)
            at = np.cumsum(n) - n
            crc = [zlib.crc32(ids[a:a + k].tobytes()) for a, k in zip(at.tolist(), n.tolist())]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [row["doc_ids"].values, pa.array([row["part"].as_py()] * k, pa.int32()),
                 pa.array(at + row["start_in_part"].as_py()), pa.array(n),
                 pa.array(crc, pa.int64())],
                names=["doc_id", "part", "start", "n_tokens", "ids_crc32"])


def read_store(store: DataFrame) -> DataFrame:
    """Documents of a store: doc_id, start, n_tokens, ids_crc32 from the decoded ids.

    ``start`` adds the totals of the partitions before; that table has one row
    per written partition.
    """
    totals = store.groupBy("part").agg(F.sum(F.expr(
        "aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()
    docs = store.mapInArrow(_reader, f"doc_id {kind}, part int, start long, n_tokens long, ids_crc32 long")
    return (docs.join(F.broadcast(base), "part")
            .select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"))


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write the store and read it back.

    A null or empty text is the end id alone; repeated rows are documents of
    their own, side by side; a null doc_id comes first; an empty table makes a
    store without blocks and a result without rows; other columns are not read.
    A text longer than a block is a block of its own. The doc_id keeps its type.
    """
    path = path or scratch(docs.sparkSession, "token_store")
    write_store(docs, path)
    return read_store(docs.sparkSession.read.schema(blocks(dict(docs.dtypes)["doc_id"])).parquet(path))
