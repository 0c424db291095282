"""Operator 4: n-gram Jaccard self-join by size-banded tiles with bitmap signatures.

Documents are sets of hashed word shingles. Equal sets are one class, named by a
hash of the set; the join works on classes.

Tiles. Two sets of sizes a and b with a Jaccard similarity of t or more differ in
at most D = (1 - t) / (1 + t) * (a + b) elements. Sizes fall into bands
(growing by ``GROWTH``); in band i with largest D_i the elements are hashed into
D_i + 1 + e_i parts, so at least e_i + 1 parts of the two sets are equal. A tile
is the set of classes that agree on one part's whole content. Parts of fewer
than two elements say little and are in most sets (an empty part is in every
set that has none there), so each set leaves out its first e_i of them, in one
order for all sets: empty ones first, then by the key of the tile. That loses
nothing: of e_i + 1 equal parts the last in that order, behind which parts of two
elements and more come, is left out by neither set, as e_i others stand before
it. A set makes tiles in its own band and, if a partner 1/t times as large would
be in the next band, there too.

Within tiles, each class is paired with the smallest class of the tile; the pairs
that hold make components; so do the nearest neighbours of each class in a part
of the tiles. What remains are tiles with classes of several components. There every pair of different components is compared in blocks by
bitmaps: the parity bitmaps of two sets differ in at most as many bits as the
sets differ in elements, so the count bounds the overlap from above. Of what the
bound lets through, each class's nearest ``NEAREST`` in a block are checked on the
exact sorted arrays (fetched for such classes only) and join components. A block
that had more is compared again, now between fewer components and with four
times as many per class, until none has more. Every pair of different texts that
could link is thus linked, in one component already, or refuted, and a group of
near copies costs pairs in proportion to its size and not to its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm.common import components, mix64, partitions, release, returning, slices, unused, utf8, word_hashes
from airlens.session import ensure_checkpoint_dir

SHINGLE = 4
PERCENT = 85
GROWTH = 1.5
BITS = 8192               # most bits of a bitmap
CELL = 8192               # classes on one side of a block of a tile
NEAREST = 2               # partners of a class in a block in the first round
FINE = 8                  # so many times the bits where a block had more pairs than that
SOME = 8                  # one tile of so many tells the first links
PAIRS = 1 << 18           # pairs of classes compared at a time
SLICE = 1 << 20           # bytes of text made into sets at a time
FILTER_BITS = 26          # size of the membership filter of classes whose sets are fetched

_STEP = mix64(np.arange(7, 7 + 16, dtype=np.uint64))
_SALT = np.uint64(0xD6E8FEB86659FD93)


class Bands:
    """Size bands, their largest difference D and number of parts."""

    def __init__(self, percent: int):
        self.percent = percent
        edge = [1]
        while edge[-1] < 1 << 40:
            edge.append(max(edge[-1] + 1, int(edge[-1] * GROWTH)))
        self.edge = np.array(edge, np.int64)         # band i holds edge[i] <= size < edge[i + 1]
        top = self.edge[1:] - 1
        self.most = (100 - percent) * 2 * top // (100 + percent)
        self.spare = self.most // 8
        self.parts = self.most + 1 + self.spare

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edge, size, "right") - 1


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE,
                 ) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct k-word shingles of each text, ascending within it."""
    h, at = word_hashes(data, offs)
    n = np.diff(at)
    g = np.full(max(0, len(h) - k + 1), k, np.uint64)
    for j in range(k):
        g += h[j:j + len(g)] * _STEP[j]
    g = mix64(g)
    sets = []
    for a, m in zip(at[:-1].tolist(), n.tolist()):
        if m >= k:
            sets.append(np.unique(g[a:a + m - k + 1]))
        elif m:
            w = np.full(1, m, np.uint64)
            for j in range(m):
                w += h[a + j:a + j + 1] * _STEP[j + 8]
            sets.append(mix64(w))
        else:
            sets.append(np.empty(0, np.uint64))
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=out[1:])
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), out


def class_ids(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set, from its elements and size (0 for the empty set)."""
    n = np.diff(at)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix64(x ^ _SALT), out=sums[1:])
    name = mix64(sums[at[1:]] - sums[at[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, name | np.uint64(1), np.uint64(0)).view(np.int64)


def tile_keys(x: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(key, set number) of every tile that the sets belong to."""
    n = np.diff(at)
    own = bands.of(np.maximum(n, 1))
    largest = np.where(n > 0, n * 100 // bands.percent, 0)
    keys, sets = [], []
    for up in (0, 1):
        band = own + up
        # no difference allowed: only equal sets, which are one class already
        pick = np.flatnonzero((n > 0) & (bands.most[band] > 0)
                              & ((up == 0) | (largest >= bands.edge[band])))
        if not len(pick):
            continue
        parts = bands.parts[band[pick]]
        start = np.cumsum(parts) - parts
        size = n[pick]
        idx = np.repeat(at[pick] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        e = x[idx]
        slot = np.repeat(start, size) + ((e >> np.uint64(32)) * np.repeat(parts, size).astype(np.uint64)
                                         >> np.uint64(32)).astype(np.int64)
        total = int(parts.sum())
        content = np.zeros(total, np.uint64)
        np.add.at(content, slot, mix64(e ^ _SALT))
        count = np.bincount(slot, minlength=total)
        of = np.repeat(np.arange(len(pick)), parts)
        place = np.arange(total) - start[of]
        k = mix64(content + np.minimum(count, 2).astype(np.uint64) * _SALT)
        k = mix64(k ^ mix64((band[pick][of].astype(np.uint64) << np.uint64(40))
                            + place.astype(np.uint64)))
        use = count >= 2
        few = np.bincount(of[~use], minlength=len(pick))
        spare = bands.spare[band[pick]]
        loose = np.flatnonzero(~use & (few > spare)[of])     # all small parts of the other sets are left out
        loose = loose[np.lexsort((k[loose], count[loose], of[loose]))]
        few = few * (few > spare)
        rank = np.arange(len(loose)) - (np.cumsum(few) - few)[of[loose]]
        use[loose[rank >= spare[of[loose]]]] = True
        keys.append(k[use])
        sets.append(pick[of[use]])
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets)


def bitmap(x: np.ndarray, fine: int = 1) -> bytes:
    """Parity bitmap of a set: each element flips one bit; bits follow the size."""
    bits = min(BITS * min(fine, 4), max(64, 1 << int(len(x) - 1).bit_length()) * fine)
    b = np.bincount((x >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(b.astype(np.uint8)).tobytes()


def _fine(x: np.ndarray) -> bytes:
    return bitmap(x, FINE)


def _fold(b: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps brought to ``size`` bytes: bit i mod the smaller length, by exclusive or."""
    while b.shape[1] > size:
        h = b.shape[1] // 2
        b = b[:, :h] ^ b[:, h:]
    return b


def _classes(k):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in returning(slices(batch, most=SLICE)):
                x, at = shingle_sets(*utf8(part.column("text")), k)
                bits = [bitmap(x[a:b]) if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(np.diff(at)),
                     pa.array(class_ids(x, at)), pa.array(bits, pa.binary())],
                    names=["doc_id", "th", "n_shingles", "sid", "bits"])
    return run


def _tiles(k, bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sent: set[int] = set()                   # copies in one batch make their tiles once
            for part in returning(slices(batch, most=SLICE)):
                x, at = shingle_sets(*utf8(part.column("text")), k)
                sid = class_ids(x, at)
                _, first = np.unique(sid, return_index=True)
                keep = np.zeros(len(sid), bool)
                keep[[i for i in first.tolist() if sid[i] not in sent]] = True
                sent.update(sid.tolist())
                key, own = tile_keys(x, at, bands)
                use = keep[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[use].view(np.int64)), pa.array(sid[own[use]])], names=["key", "sid"])
    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sid, lo) of the tiles of two classes or more, with their smallest class, each row once.

    Rows come sorted by key and sid. Of the tile that a batch ends in, only its first
    and last class are held, so a tile may be of any size.
    """
    held = None                                      # key, first and last class, whether it has two
    for batch in batches:
        if not batch.num_rows:
            continue
        key, sid = (batch.column(c).to_numpy() for c in ("key", "sid"))
        if held is not None and key[0] == held[0]:
            key, sid = np.r_[held[0], key], np.r_[held[2], sid]
        else:
            held = None
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
        key, sid = key[new], sid[new]
        start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
        size = np.diff(np.r_[start, len(key)])
        lo = np.repeat(sid[start], size)
        several = np.repeat(size > 1, size)
        if held is not None:
            lo[:size[0]] = held[1]
            if held[3]:                              # its last class went out before
                several[:size[0]] = True
                several[0] = False
        last = len(key) - 1
        held = (key[last], lo[last], sid[last], bool(lo[last] != sid[last]))
        yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, sid, lo)], names=["key", "sid", "lo"])


def _wanted(th: np.ndarray) -> np.ndarray:
    """Place of a text in the membership filter: the top bits of its hash."""
    return (th.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _arrays(k, wanted, pack):
    """Sets of the texts that the filter may hold, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            sent: set[int] = set()
            at = _wanted(batch.column("th").to_numpy())
            batch = batch.filter(pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
            for part in returning(slices(batch, most=SLICE)):
                x, at = shingle_sets(*utf8(part.column("text")), k)
                sid = class_ids(x, at)
                keep = []
                for i in np.flatnonzero(np.diff(at) > 0).tolist():
                    if sid[i] not in sent:
                        sent.add(int(sid[i]))
                        keep.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sid[keep]), pa.array([pack(x[at[i]:at[i + 1]]) for i in keep], pa.binary())],
                    names=["sid", "elements"])
    return run


def _elements(rows: DataFrame, light: DataFrame, sids: DataFrame, k: int, pack=np.ndarray.tobytes) -> DataFrame:
    """(sid, elements) of the classes in ``sids``, sorted or as ``pack`` has them, from one more pass over the texts.

    The pass makes sets only of texts that a membership filter of ``2 ** FILTER_BITS``
    bits may hold (one text of each class): a fixed 8 MB that the driver collects
    and broadcasts, whatever the input. The join after it is exact.
    """
    slot = F.shiftrightunsigned("th", 64 - FILTER_BITS) + 1      # these functions count from 1
    parts = light.join(sids, "sid", "left_semi").select(
        F.bitmap_bucket_number(slot).alias("b"), F.bitmap_bit_position(slot).alias("p")) \
        .groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()
    wanted = np.zeros(((1 << FILTER_BITS) >> 3) + 4096, np.uint8)
    for r in parts:
        at = (r["b"] - 1) * 4096
        wanted[at:at + 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    return (rows.select("text", F.xxhash64("text").alias("th"))
            .mapInArrow(_arrays(k, shared, pack), "sid long, elements binary")
            .join(sids.select(F.col("sid").alias("s2")), F.col("sid") == F.col("s2"), "left_semi")
            .dropDuplicates(["sid"]))


def _overlaps(percent):
    """Exact test of (a, x, b, y): 100 * intersection >= percent * union."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returning(batches):
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                both = int((v[at] == u).sum())
                ok.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())],
                names=["a", "b", "ok"])
    return run


def _sifted(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow a link."""
    p = (pairs.join(light.select(F.col("sid").alias("a"), F.col("n").alias("na"),
                                 F.col("bits").alias("ba")), "a")
         .join(light.select(F.col("sid").alias("b"), F.col("n").alias("nb"),
                            F.col("bits").alias("bb")), "b"))
    return (p.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
            .mapInArrow(_sift(percent), "a long, b long"))


def _checked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, ok) of distinct pairs a < b, by their exact sorted arrays."""
    return (pairs.join(sets.select(F.col("sid").alias("a"), F.col("elements").alias("x")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("elements").alias("y")), "b")
            .mapInArrow(_overlaps(percent), "a long, b long, ok boolean").checkpoint())


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).unionAll(pairs.select(F.col("b").alias("sid"))).distinct()


def _bytes2d(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _sift(percent):
    """Pairs whose bitmaps allow enough overlap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in returning(batches):
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ba, bb = batch.column("ba").to_pylist(), batch.column("bb").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            size = np.array([min(len(u), len(v)) for u, v in zip(ba, bb)])
            for s in np.unique(size):
                i = np.flatnonzero(size == s)
                u = np.concatenate([_fold(_bytes2d([ba[j]]), s) for j in i])
                v = np.concatenate([_fold(_bytes2d([bb[j]]), s) for j in i])
                differ = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
                keep[i] = _allowed(na[i], nb[i], differ, percent)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))],
                names=["a", "b"])
    return run


def _allowed(na, nb, differ, percent):
    """Whether sets of these sizes that differ in ``differ`` elements or more can link.

    overlap <= (na + nb - differ) / 2 and union >= (na + nb + differ) / 2
    """
    return 100 * (na + nb - differ) >= percent * (na + nb + differ)


def _differing(u, v, data, offs):
    """Number of differing bits of the bitmaps of rows u and v, the longer one folded."""
    size = np.diff(offs)
    least = np.minimum(size[u], size[v])
    out = np.zeros(len(u), np.int64)
    place = np.zeros(len(size), np.int64)
    longer = None                                    # rows of a longer bitmap, folded to this size
    for w in np.unique(size)[::-1].tolist():
        own = np.flatnonzero(size == w)
        b = data[offs[own][:, None] + np.arange(w)]
        if longer is not None:
            b = np.concatenate([b, _fold(longer, w)])
            own = np.concatenate([own, held])
        longer, held = b, own
        place[own] = np.arange(len(own))
        pick = np.flatnonzero(least == w)
        words = np.ascontiguousarray(b.view(np.uint64).T)
        x, y = place[u[pick]], place[v[pick]]
        count = np.zeros(len(pick), np.uint16)
        for row in words:
            count += np.bitwise_count(row[x] ^ row[y])
        out[pick] = count
    return out


def _triangles(edge):
    """Every u < v of each stretch of rows, in lists of about ``PAIRS``."""
    behind = np.repeat(edge[1:], np.diff(edge)) - np.arange(edge[-1]) - 1
    part = np.cumsum(behind) // PAIRS
    cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(behind)]
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        m = behind[lo:hi]
        u = np.repeat(np.arange(lo, hi), m)
        yield u, u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(m) - m, m)


def _cells(percent, nearest):
    """The pairs of every block, and the tiles of blocks that had more; a block's rows follow one another.

    A block of side 2 is a whole tile. Others have rows of side 0, which are not of
    the tile's largest component, and rows of side 1, of which those that are not
    either are met by smaller ones only.
    """
    names = ["key", "i", "j", "side", "minor", "n", "label", "sid"]

    def blocks(edge, col):
        whole = col["side"][edge[:-1]] == 2
        for k in np.flatnonzero(np.r_[whole, False] & ~np.r_[False, whole]).tolist():
            end = k + int(np.argmin(np.r_[whole[k:], False]))
            for u, v in _triangles(edge[k:end + 1] - edge[k]):
                yield u + edge[k], v + edge[k]
        for k in np.flatnonzero(~whole).tolist():
            at = np.arange(edge[k], edge[k + 1])
            left, right = at[col["side"][at] == 0], at[col["side"][at] == 1]
            for lo in range(0, len(left), max(1, PAIRS // max(1, len(right)))):
                part = left[lo:lo + max(1, PAIRS // max(1, len(right)))]
                u, v = np.repeat(part, len(right)), np.tile(right, len(part))
                ok = ~col["minor"][v] | (col["sid"][u] < col["sid"][v])
                yield u[ok], v[ok]

    def pairs(held):
        col = {c: held.column(c).to_numpy(zero_copy_only=False) for c in names}
        data, offs = utf8(held.column("bits"))
        new = np.zeros(held.num_rows, bool)
        new[:1] = True
        for c in ("key", "i", "j"):
            new[1:] |= col[c][1:] != col[c][:-1]
        edge = np.r_[np.flatnonzero(new), held.num_rows]
        block = np.cumsum(new) - 1
        rows, more = [], []
        for u, v in blocks(edge, col):
            least, most = np.minimum(col["n"][u], col["n"][v]), np.maximum(col["n"][u], col["n"][v])
            ok = (col["label"][u] != col["label"][v]) & (100 * least >= percent * most)
            u, v = u[ok], v[ok]
            differ = _differing(u, v, data, offs)
            ok = _allowed(col["n"][u], col["n"][v], differ, percent)
            u, v, differ = u[ok], v[ok], differ[ok]
            # of each u the nearest few
            order = np.lexsort((differ, u))
            u, v = u[order], v[order]
            start = np.r_[0, np.flatnonzero(np.diff(u)) + 1]
            rank = np.arange(len(u)) - np.repeat(start, np.diff(np.r_[start, len(u)])) if len(u) else u
            near = rank < nearest
            more.append(col["key"][edge[block[u[~near]]]])
            rows.append(np.stack([col["sid"][u[near]], col["sid"][v[near]], differ[order][near]]))
        found = np.unique(np.concatenate([np.empty((3, 0), np.int64), *rows], axis=1), axis=1)
        tiles = np.unique(np.concatenate([np.empty(0, np.int64), *more]))
        none = [None]
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c.tolist() + none * len(tiles), pa.int64()) for c in found),
             pa.array(none * found.shape[1] + tiles.tolist(), pa.int64())], names=["a", "b", "differ", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in returning(batches):
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            key = np.stack([held.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            last = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:                                  # all but the block that may go on
                yield pairs(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield pairs(held)
    return run


def _labels(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(sid, label) after further links: components of the labels so far."""
    e = links.filter("ok").select("a", "b")
    if labels is None:
        return components(e).select(F.col("id").alias("sid"), "label").checkpoint()
    for end in ("a", "b"):
        known = labels.select(F.col("sid").alias(end), F.col("label").alias("l" + end))
        e = e.join(known, end, "left").withColumn("l" + end, F.coalesce("l" + end, end))
    e = e.filter("la <> lb")
    moved = components(e.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    m = moved.select(F.col("id").alias("old"), F.col("label").alias("new"))
    every = labels.unionAll(_ends(links.filter("ok")).select("sid", F.col("sid").alias("label"))
                            .join(labels, "sid", "left_anti"))
    return (every.join(m, F.col("label") == F.col("old"), "left")
            .select("sid", F.coalesce("new", "label").alias("label")).checkpoint())


def _open_pairs(tiles: DataFrame, labels: DataFrame, light: DataFrame, percent: int, nearest: int) -> DataFrame:
    """(a, b, differ) of different components within tiles that bitmaps allow, or key of a tile with more.

    A tile of more than ``CELL`` classes is dealt into blocks: the classes that are
    not of its largest component against all.
    """
    n = partitions(tiles.sparkSession)
    tile = tiles.join(labels, "sid", "left").select(
        "key", "sid", F.coalesce("label", "sid").alias("label")).repartition(n, "key")
    per = tile.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    open_ = (per.groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels"),
                                    F.max_by("label", "c").alias("main"), F.max("c").alias("most"))
             .filter("labels > 1 and m > 2")            # of two classes, both are checked already
             .select("key", "main", F.ceil(F.col("m") / CELL).cast("int").alias("all"),
                     F.ceil((F.col("m") - F.col("most")) / CELL).cast("int").alias("minors")))
    rows = (tile.join(open_.hint("shuffle_hash"), "key")
            .withColumn("minor", F.col("label") != F.col("main")).join(light.drop("th"), "sid"))
    dealt = F.xxhash64("sid")
    own, small = F.pmod(dealt, F.col("all")).cast("int"), F.pmod(dealt, F.col("minors")).cast("int")

    def to(i, j, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    zero = F.lit(0)
    left = F.transform(F.sequence(zero, F.col("all") - 1), lambda j: to(small, j, 0))
    right = F.transform(F.sequence(zero, F.col("minors") - 1), lambda i: to(i, own, 1))
    where = (F.when(F.col("all") == 1, F.array(to(zero, zero, 2)))
             .when(F.col("minor"), F.concat(left, right)).otherwise(right))
    cells = (rows.withColumn("at", F.explode(where))
             .select("key", "at.i", "at.j", "at.side", "minor", "n", "label", "sid", "bits"))
    return (cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "sid")
            .mapInArrow(_cells(percent, nearest), "a long, b long, differ long, key long"))


class Joined(NamedTuple):
    rows: DataFrame           # doc_id, th (text hash), n_shingles, sid (class) of every row
    labels: DataFrame         # sid, label of the classes that are linked
    tested: DataFrame         # a, b, ok of the pairs of classes compared exactly

    def of_components(self, value: Column) -> DataFrame:
        """(sid, least, rows): of the class's component the least value and the number of rows.

        Rows are aggregated by class first, so neither a large class nor a large
        component lies in one task.
        """
        per = (self.rows.filter("n_shingles > 0").groupBy("sid")
               .agg(F.min(value).alias("least"), F.count(F.lit(1)).alias("rows"))
               .join(self.labels, "sid", "left").withColumn("label", F.coalesce("label", "sid")))
        whole = per.groupBy("label").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))
        return per.select("sid", "label").join(whole, "label").drop("label")


def classes_joined(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> Joined:
    """Every row's class, and the component of every class that has a link."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    kind = dict(docs.dtypes)["doc_id"]
    bands = Bands(percent)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    named = rows.withColumn("th", F.xxhash64("text")).mapInArrow(
        _classes(k), f"doc_id {kind}, th long, n_shingles long, sid long, bits binary").checkpoint()

    shared = (rows.select("text").mapInArrow(_tiles(k, bands), "key long, sid long")
              .repartition(partitions(spark), "key").sortWithinPartitions("key", "sid")
              .mapInArrow(_shared, "key long, sid long, lo long").checkpoint())
    release(spark)
    light = (named.select("sid", F.col("n_shingles").alias("n"), "th", "bits")
             .join(shared.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"]).checkpoint())

    star = shared.select(F.col("lo").alias("a"), F.col("sid").alias("b")).filter("a <> b").distinct()
    close = _sifted(star, light, percent).checkpoint()
    release(spark)
    sets = _elements(rows, light, _ends(close), k).checkpoint()
    tested = _checked(close, sets, percent)
    labels = _labels(tested, None)
    release(spark)
    shared = shared.select("key", "sid")

    def found(out, few):
        """The tiles' pairs out, compared exactly: each class's nearest only, or all that are left."""
        nonlocal sets, tested, labels
        rest = out.filter("key is null")
        if few:
            rest = rest.groupBy("a").agg(F.min_by("b", "differ").alias("b"))
        rest = (rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
                .join(tested, ["a", "b"], "left_anti").checkpoint())
        if rest.isEmpty():
            return
        missing = _ends(rest).join(sets, "sid", "left_anti").checkpoint()
        if not missing.isEmpty():
            sets = sets.unionAll(_elements(rows, light, missing, k).checkpoint())
        now = _checked(rest, sets, percent)
        tested = tested.unionAll(now)
        if not now.filter("ok").isEmpty():
            labels = _labels(now, labels)
        release(spark)

    # near copies share many tiles: some of them tell most links, with a pair or two per class
    found(_open_pairs(shared.filter(F.pmod("key", F.lit(SOME)) == 0), labels, light, percent, 1), True)
    # every pair left in tiles that still hold several components
    left, nearest, fine = shared, NEAREST, None
    while True:
        out = _open_pairs(left, labels, light if fine is None else fine, percent, nearest).checkpoint()
        release(spark)
        found(out, False)
        more = out.filter("key is not null").select("key").distinct()
        if more.isEmpty():
            break
        left, nearest = shared.join(more, "key", "left_semi").checkpoint(), nearest * 4
        if fine is None:                             # later rounds are over parts of these tiles
            some = left.select("sid").distinct().checkpoint()
            fine = light.drop("bits").join(
                _elements(rows, light, some, k, _fine).withColumnRenamed("elements", "bits"), "sid").checkpoint()
    return Joined(named.drop("bits"), labels, tested)


def join_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id its links reach) of every row.

    A null, empty or blank text has no shingles and is alone; a text of fewer
    than k words is one shingle. Repeated rows and equal sets are linked. A null
    doc_id is ignored as a component's name unless it is the only one. An empty
    table gives no rows; other columns are not read.
    """
    j = classes_joined(docs, k, percent)
    names = j.of_components(F.col("doc_id"))
    return (j.rows.filter("n_shingles > 0").join(names, "sid")
            .select("doc_id", "n_shingles", F.col("least").alias("component_id"))
            .unionAll(j.rows.filter("n_shingles = 0")
                      .select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: smallest doc_id (null last), then text hash.

    Rows without shingles all stay. Of rows alike in doc_id and text that come
    first in their component one stays, whatever their other columns hold. Other
    columns are kept and may have any names.
    """
    j = classes_joined(docs, k, percent)
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    first = j.of_components(name).filter("rows > 1")
    c_id, c_th = unused(docs, "id", "th")
    marked = j.rows.filter("n_shingles > 0").join(first, "sid").select(
        F.col("doc_id").alias(c_id), F.col("th").alias(c_th), (name == F.col("least")).alias("win"))
    same = docs["doc_id"].eqNullSafe(F.col(c_id)) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(c_th))
    kept = docs.join(marked.filter("not win").select(c_id, c_th).distinct().hint("shuffle_hash"),
                     same, "left_anti")
    again = marked.filter("win").groupBy(c_id, c_th).count().filter("count > 1").select(c_id, c_th)
    if again.isEmpty():
        return kept
    # a row that comes again as the first of its component stays once
    twice = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, same, "left_anti").unionAll(twice)
