"""Sharding: exact sizes, draws against exact chances, uniformity over seeds, hot groups, totals over 10**9."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from common import SCHEMA, frame, write_tables
from pyspark.sql import functions as F

from gridfield.llm import sharding
from gridfield.llm.queries import QUERIES


@pytest.mark.parametrize("good, bad, draws", [(3, 5, 4), (10, 2, 7), (40, 400, 30), (1, 1, 1), (5, 0, 3), (0, 5, 3)])
def test_draws_have_the_exact_chances(good, bad, draws):
    rng, n = np.random.default_rng(1), 20_000
    seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    for k in range(draws + 1):
        p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
        assert abs(seen[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1e-9 and (p > 0 or not seen[k])


def test_large_totals():
    m = sharding.matrix([6 * 10**8, 6 * 10**8, 7, 0, 10**10], 40, 1)
    assert m.sum(axis=1).tolist() == [6 * 10**8, 6 * 10**8, 7, 0, 10**10] and np.ptp(m.sum(axis=0)) <= 1 and m.min() >= 0
    share = m[0] / m.sum(axis=0)
    assert abs(share - 6e8 / 1.12e10).max() < 7e-5  # five deviations
    m = sharding.matrix([5, 0, 9, 30], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 9, 30] and np.ptp(m.sum(axis=0)) <= 1


def check(out, rows, shards):
    text = lambda t: (t or "").encode()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((str(i), len(text(t)) + 16, zlib.crc32(text(t))) for i, t in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))


def odd_rows():
    rng = random.Random(3)
    return [(i, "x" * rng.randrange(50)) for i in range(300)] + [(None, None)] * 2100 + [(7, "again")] * 3 + [(None, "a"), (400, ""), (401, "é" * 10**5)]


@pytest.mark.parametrize("parts, shards", [(1, 7), (6, 40)])
def test_sizes_and_slots(spark, parts, shards):
    rows = odd_rows()
    docs = frame(spark, rows).repartition(parts).withColumns({"size": F.lit("x"), "number": F.lit(1), "shard": F.lit(2), "rows": F.lit(3)})
    out = sharding.shuffle(docs, shards).collect()
    check(out, rows, shards)
    hot = Counter(r["shard"] for r in out if r["doc_id"] is None)
    assert max(hot.values()) < 2.2 * min(hot.values())  # a hot group is in all shards alike
    again = sharding.shuffle(docs.repartition(3), shards).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    check(sharding.shuffle(frame(spark, rows[:3]), shards).collect(), rows[:3], shards)
    assert sharding.shuffle(frame(spark, []), shards).count() == 0


def test_uniform_over_seeds(spark):
    """Shard and half of the shard of each of 40 rows, over 60 seeds; and neighbours meet as often as chance says."""
    rows, shards, seeds = [(i, "t") for i in range(40)], 4, 60
    docs, counts, together = frame(spark, rows).coalesce(1).cache(), np.zeros((40, shards, 2)), 0
    for seed in range(seeds):
        at = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shuffle(docs, shards, seed=seed).collect()}
        for i, (s, k) in at.items():
            counts[i, s, k // 5] += 1
        together += sum(at[i][0] == at[i + 1][0] for i in range(39))
    want = seeds / 8
    chi2 = ((counts - want) ** 2 / want).sum()  # 40 * 7 degrees of freedom
    assert abs(chi2 - 280) < 5 * math.sqrt(560)
    mean = 39 * seeds * 9 / 39
    assert abs(together - mean) < 5 * math.sqrt(mean)


def test_query(spark, tmp_path):
    rows = odd_rows()
    write_tables(spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA))
    out = QUERIES["op8_hypergeometric_sharding"](spark, str(tmp_path)).collect()
    check(out, rows, 40)
    assert {(r["law"], r["grown_shard"]) for r in out} == {("rows", None)}
