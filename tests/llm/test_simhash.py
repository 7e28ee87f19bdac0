"""Fingerprints, links within a radius and links of similar texts against brute force."""

import random

import numpy as np
import pytest
import xxhash
from common import SCHEMA, frame, write_tables
from pyspark.sql import functions as F

from gridfield.llm import simhash
from gridfield.llm.queries import QUERIES


def joined(n, linked):
    """The first member of each one's group, from all pairs."""
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if root[a] != root[b] and linked(a, b):
                x, y = min(root[a], root[b]), max(root[a], root[b])
                root = [x if r == y else r for r in root]
    return root


def fingerprint(text, shingle=3):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, root):
    """By row: the smallest doc_id of its group, or None."""
    ids = {}
    for (i, *_), r in zip(rows, root, strict=True):
        if i is not None:
            ids[r] = min(i, ids.get(r, i))
    return [ids.get(r) for r in root]


def odd_rows():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=3)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(40)]
    for i in range(40, 70):  # small changes of long texts
        w = rows[i % 7][1].split() * 9
        w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(None, rows[3][1]), (None, rows[4][1].upper()), (None, None), (80, ""), (81, " \n"), (82, None), (5, "one two"), (5, "two one"), (90, "a a a a a a"), (91, rows[50][1] + " \t"), (92, "x y " * 20_000)]
    return rows


@pytest.mark.parametrize("parts", [1, 6])
def test_query(spark, tmp_path, parts):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).withColumns({"fp": F.lit("x"), "key": F.lit(1), "id": F.lit(2), "told": F.lit(3)})
    docs.repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    prints = [fingerprint(t) for _, t in rows]
    root = joined(len(rows), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert len(set(root)) < len(set(prints))  # some are joined by bits that differ
    want = sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, components(rows, root), strict=True)), key=str)
    got = QUERIES["op4_simhash_near_dedup"](spark, str(tmp_path))
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()), key=str) == want


def test_ties_and_empty(spark):
    assert simhash.majority(np.array([1, 2], np.uint64), 1).tolist() == [0]
    assert simhash.majority(np.array([1, 3], np.uint64), 1).tolist() == [1]
    none = frame(spark, [])
    assert simhash.groups(none, simhash.spare_families(2)).count() == 0 and simhash.keep_one(none, simhash.plain_table(64, 4), 5, similar=0.8).count() == 0


def clouds(rng, centres, each, flips, fixed=0):
    """Fingerprints around centres, the lowest ``fixed`` bits alike."""
    base = rng.integers(0, 1 << 64, centres, dtype=np.uint64)
    out = [x ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(fixed, 64, flips).astype(np.uint64)) for x in base for _ in range(each)]
    return np.unique(np.array(out, np.uint64))


@pytest.mark.parametrize("most, finer", [(3000, (16, 64)), (10, (16, 64)), (10, (64,)), (1, (16, 64))])
def test_buckets_of_any_size_lose_no_pair(monkeypatch, most, finer):
    monkeypatch.setattr(simhash, "BUCKET_PAIRS", most)
    fps = clouds(np.random.default_rng(5), 20, 12, 3)
    want = joined(len(fps), lambda a, b: int(fps[a] ^ fps[b]).bit_count() <= 2)
    root = list(range(len(fps)))
    for left, right in simhash.close_pairs(simhash.spare_families(2), np.zeros(len(fps), np.uint64), fps[:, None], finer):
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            assert int(fps[a] ^ fps[b]).bit_count() <= 2
            x, y = min(root[a], root[b]), max(root[a], root[b])
            root = [x if r == y else r for r in root]
    assert root == want


def test_keys_lose_no_pair():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 1 << 64, (5000, 1), dtype=np.uint64)
    b = a.copy()
    for _ in range(2):
        b[:, 0] ^= np.uint64(1) << rng.integers(0, 64, 5000).astype(np.uint64)
    for families in (simhash.spare_families(2), simhash.spare_families(2, 1, 16)):
        assert (families.bucket_keys(a) == families.bucket_keys(b)).any(axis=1).all()


def sentence(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def similar_rows(seed=9):
    """Texts with 1 to 9 of 60 words changed, stars, a passage that unlike texts share, copies, nulls, odd ids."""
    rng, rows = random.Random(seed), []
    for i in range(12):
        base = sentence(rng, 60)
        rows.append((20 * i, " ".join(base)))
        rows += [(20 * i + k, " ".join(base[:-k] + sentence(rng, k))) for k in range(1, 10)]
    base = sentence(rng, 94)
    for i in range(40):
        w, (a, b) = list(base), rng.choice([(x, y) for x in range(5, 84) for y in range(x + 5, 89)])
        w[a], w[b] = sentence(rng, 2)
        rows.append((500 + i, " ".join(w)))
    rows.append((999, " ".join(base)))
    shared = sentence(rng, 40)
    for i in range(60):  # 36 of 45 to 100 shingles are the passage's
        rows.append((600 + i, " ".join(shared + sentence(rng, 5 + i))))
    rows += [(None, rows[5][1].upper()), (None, rows[7][1]), (None, None), (901, ""), (902, " "), (903, "one two"), (903, "two one"), (904, "ONE two"), (905, "la " * 50)]
    return rows


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    sets = [grams(t) for _, t in rows]
    return joined(len(rows), lambda a, b: len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


@pytest.mark.parametrize("group, hot, radius", [(128, 500_000, 64), (4, 500_000, 64), (4, 5, 64), (128, 5, 64), (4, 5, 0)])
def test_similar_texts(spark, monkeypatch, group, hot, radius):
    """Sizes of groups, tasks and tables change nothing."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HOT", hot)
    rows = similar_rows()
    root = brute(rows)
    docs = frame(spark, rows).repartition(4).withColumns({"root": F.lit("x"), "token": F.lit(1), "at": F.lit(2)})
    out = simhash.groups(docs, simhash.plain_table(radius, 4), 5, similar=0.8)
    assert sorted(((r["doc_id"], r["component_id"]) for r in out.collect()), key=str) == sorted(((i, c) for (i, _), c in zip(rows, components(rows, root), strict=True)), key=str)
    if group == 128:
        return
    kept = simhash.keep_one(docs, simhash.plain_table(radius, 4), 5, similar=0.8)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    firsts = {c for c in components(rows, root) if c is not None}
    assert set(ids) - {None} == firsts and sorted(x for x in ids if x is not None and x != 903) == sorted(firsts - {903})
    assert ids.count(None) == 0  # the one without a text is in the group of blanks


def test_large_groups_make_few_pairs():
    """Near copies in one group: some pairs a node, not the square."""
    rng = np.random.default_rng(3)
    base, n = rng.integers(0, 1 << 64, 4, dtype=np.uint64), 5000
    fps = base ^ (np.uint64(1) << rng.integers(0, 64, (n, 4)).astype(np.uint64))
    arrays = (np.zeros(n, "<u8"), np.arange(n, dtype="<u4"), np.zeros(n, "<u4"), np.zeros(n, bool), np.arange(n, dtype="<i8"), np.full(n, 100, "<u4"), fps.astype("<u8"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], [x.split()[0] for x in simhash.DEALT.split(", ")])
    out = pa.Table.from_batches(list(simhash._meet(0.8, simhash.plain_table(64, 4))([batch])))
    pairs = out.filter(out.column("early").is_valid())
    assert out.num_rows - pairs.num_rows == n and n - 1 <= pairs.num_rows <= 1.1 * n and all(pairs.column("early").to_pylist())


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(4)
    for n in (0, 1, 30, 3000):
        a, b = (np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for _ in range(2))
        b = np.union1d(b, a[: n // 2])
        differ = np.bitwise_count(simhash.parity(a) ^ simhash.parity(b)).sum()
        assert differ <= len(np.setxor1d(a, b)) and (n != 30 or differ > 20)
