import numpy as np
import pyarrow as pa
import pytest

from airlens.llm import jaccard
from tests.conftest import SF_SMALL
from tests.llm import helpers as H


def test_linked_sets_share_a_tile():
    """Every pair at the threshold or above meets in a tile, whatever its sizes."""
    rng = np.random.default_rng(4)
    bands = jaccard.Bands(85)
    for _ in range(400):
        n = int(np.exp(rng.uniform(np.log(2), np.log(900))))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        # drop and add elements as long as the pair still links
        b, x = list(a), list(a)
        while True:
            y = list(b)
            if rng.random() < 0.5 and len(y) > 1:
                y.pop(int(rng.integers(len(y))))
            else:
                y.append(np.uint64(rng.integers(0, 1 << 63)))
            both = len(set(x) & set(y))
            if 100 * both < 85 * len(set(x) | set(y)):
                break
            b = y
        sets = [np.unique(np.array(s, np.uint64)) for s in (x, b)]
        if np.array_equal(*sets):
            continue
        at = np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])])
        key, own = jaccard.tile_keys(np.concatenate(sets), at, bands)
        assert set(key[own == 0]) & set(key[own == 1])


def test_bitmaps_never_refute_a_link():
    rng = np.random.default_rng(5)
    for n in (3, 40, 700, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 14:], rng.integers(0, 1 << 63, n // 14, dtype=np.uint64)])
        x, y = (jaccard._bytes2d([jaccard.bitmap(s)]) for s in (a, b))
        size = min(x.shape[1], y.shape[1])
        differ = int(np.bitwise_count(jaccard._fold(x, size) ^ jaccard._fold(y, size)).sum())
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def brute(rows):
    sets = [H.shingles(r[1]) for r in rows]
    label = H.components(sets)
    names = {}
    for r, c in zip(rows, label):
        ids = names.setdefault(c, [])
        if r[0] is not None:
            ids.append(r[0])
    return sorted(str((r[0], len(s), min(names[c], default=None)))
                  for r, s, c in zip(rows, sets, label))


@pytest.mark.parametrize("source", ["awkward", "near", "table"])
def test_components_match_brute_force(spark, source):
    if source == "awkward":
        rows = H.awkward_rows()
    elif source == "table":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select(
            "doc_id", "text").collect()]
    else:                                            # chains: neighbours link, ends do not
        rng = np.random.default_rng(6)
        rows, base = [], [f"w{i}" for i in range(120)]
        for i in range(60):
            rows.append((i, " ".join(base)))
            if i % 9 == 8:
                base = [f"v{i}_{k}" for k in range(int(rng.integers(6, 200)))]
            else:
                base = list(base)
                base[int(rng.integers(len(base)))] = f"n{i}"
        rows += [(100 + i, f"common passage of several words that many share {i} {i + 1} x{i} y{i} z{i}")
                 for i in range(30)]
        rng.shuffle(rows)
        rows = [(int(i), str(t)) for i, t in rows]
    docs = (H.awkward(spark) if source == "awkward" else
            spark.createDataFrame(rows, "doc_id long, text string"))
    got = jaccard.join_documents(docs).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_small_blocks_and_empty(spark, monkeypatch):
    assert jaccard.join_documents(H.empty(spark)).count() == 0
    monkeypatch.setattr(jaccard, "CELL", 4)
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):                              # about as many changes as the threshold allows
        w = list(base)
        for k in rng.choice(100, int(rng.integers(1, 5)), replace=False):
            w[k] = f"c{i}_{k}"
        rows.append((i, " ".join(w)))
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_one_of_each_stays(spark):
    rows = H.awkward_rows()
    docs = H.awkward(spark)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    sets = [H.shingles(r[1]) for r in rows]
    label = H.components(sets)
    firsts = {c for c, s in zip(label, sets) if s}
    blank = sum(1 for s in sets if not s)
    assert kept.count() == len(firsts) + blank
    assert jaccard.one_of_each(H.empty(spark)).count() == 0


def test_linked_sets_share_a_tile_at_80_percent():
    """The same at the pipeline stage's threshold."""
    rng = np.random.default_rng(14)
    bands = jaccard.Bands(80)
    for _ in range(400):
        n = int(np.exp(rng.uniform(np.log(2), np.log(900))))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        grow, m = rng.random() < 0.5, len(a)
        most = m // 4 if grow else m // 5            # so many more, or fewer, is 0.8 or just above
        more = rng.integers(0, 1 << 63, most, dtype=np.uint64)
        b = np.unique(np.concatenate([a, more])) if grow else a[most:]
        if len(a) == len(b):
            continue
        at = np.array([0, len(a), len(a) + len(b)])
        key, own = jaccard.tile_keys(np.concatenate([a, b]), at, bands)
        assert set(key[own == 0]) & set(key[own == 1])


def near_group(m):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    for i in range(m):
        w = list(base)
        for k in rng.choice(200, int(rng.integers(1, 9)), replace=False):
            w[k] = f"c{i}_{k}"
        yield i, " ".join(w)


def test_pairs_of_a_group_of_near_copies_follow_its_size(spark):
    """Texts around the threshold, half of them linked: no more than 8 pairs a text, at any size."""
    for m in (300, 1200):
        docs = spark.createDataFrame(list(near_group(m)), "doc_id long, text string")
        assert jaccard.classes_joined(docs, 5, 80).tested.count() <= 8 * m


def test_a_tile_with_a_large_component_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    rows = list(near_group(150))
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    label = H.components([H.shingles(t, 5) for _, t in rows], 80)
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))


def test_shared_tiles_whatever_the_batches():
    rng = np.random.default_rng(3)
    rows = sorted(zip(rng.integers(0, 40, 300).tolist(), rng.integers(-9, 9, 300).tolist()))
    by = {}
    for k, s in rows:
        by.setdefault(k, set()).add(s)
    want = sorted((k, s, min(v)) for k, v in by.items() if len(v) > 1 for s in v)
    for step in (1, 2, 3, 7, 300):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i:i + step])], names=["key", "sid"])
                   for i in range(0, 300, step)]
        got = [t for b in jaccard._shared(iter(batches)) for t in zip(*(c.to_pylist() for c in b.columns))]
        assert sorted(got) == want


def test_unrelated_sets_share_next_to_no_tile():
    """Sets of random elements have small parts, some of them empty; those bring them together no more."""
    rng = np.random.default_rng(15)
    bands = jaccard.Bands(80)
    sets = [np.unique(rng.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in rng.integers(600, 2400, 400)]
    at = np.cumsum([0, *map(len, sets)])
    key, _ = jaccard.tile_keys(np.concatenate(sets), at, bands)
    m = np.unique(key, return_counts=True)[1]
    assert (m * (m - 1) // 2).sum() < 400


def test_tiles_by_themselves_or_among_others():
    """A set makes the same tiles whatever sets come with it."""
    rng = np.random.default_rng(16)
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        sets = [np.unique(rng.integers(0, 1 << 64, int(n), dtype=np.uint64)) for n in rng.integers(0, 500, 60)]
        key, own = jaccard.tile_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), bands)
        for i, x in enumerate(sets):
            alone, _ = jaccard.tile_keys(x, np.array([0, len(x)]), bands)
            assert sorted(alone.tolist()) == sorted(key[own == i].tolist())


def test_linked_sets_with_only_small_parts_equal():
    """Pairs at the threshold share a tile when every part that both have alike is empty or of one element."""
    rng = np.random.default_rng(17)
    for percent in (80, 85):
        bands = jaccard.Bands(percent)
        met = 0
        for n in rng.integers(30, 900, 150).tolist():
            a = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
            band = int(bands.of(np.array([len(a)]))[0])
            parts = int(bands.parts[band])
            slot = ((a >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(slot, minlength=parts)
            # take one element out of as many of the fuller parts as the threshold allows
            most = len(a) * (100 - percent) // 100
            full = np.argsort(-count)[:most]
            gone = [int(np.flatnonzero(slot == p)[0]) for p in full if count[p]]
            b = np.delete(a, gone)
            if 100 * len(b) < percent * len(a) or not gone:
                continue
            at = np.array([0, len(a), len(a) + len(b)])
            key, own = jaccard.tile_keys(np.concatenate([a, b]), at, bands)
            assert set(key[own == 0]) & set(key[own == 1])
            met += 1
        assert met > 100
