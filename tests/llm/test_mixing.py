"""Mixing against the dual solved by bisection, and equal rows."""

import math
import random
from collections import Counter

import pytest
from common import SCHEMA, write_tables
from pyspark.sql import functions as F

from gridfield.llm import mixing
from gridfield.llm.queries import QUERIES


def rows_of(n, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), "en", rng.choice(["a", "b", "b", "c", "ü", "Z", None]), 1))
    return rows + [(n, None, "en", "a", 1), (n + 1, "", "en", None, 1), (n + 2, " \t\n", "en", "b", 1), (None, "no id at all", "en", "c", 1), (None, "x " * 9000, "en", "b", 1), (5, "again", "en", "a", 1), (n + 3, None, "en", "empty", 1), (n + 4, "caf é", "en", "one", 1)]


def plan_of(rows, weights=(5, 2, 1), share=1.5, cap=2.0):
    """By source: sizes, target, and the multiplier that meets it, by halving."""
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes.setdefault(source, []).append(len((text or "").encode().split()))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target, left, live = {}, share * sum(map(sum, sizes.values())), list(names)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    while live:
        unit = left / sum(weight[s] for s in live)
        over = [s for s in live if unit * weight[s] > cap * sum(sizes[s])]
        for s in over or live:
            target[s] = cap * sum(sizes[s]) if over else unit * weight[s]
            left -= target[s] if over else 0
        live = [s for s in live if s not in target]
    out = {}
    for s in names:
        low, high = -50.0, 50.0
        for _ in range(200):
            mid = (low + high) / 2
            got = sum(n * min(cap, math.exp(min(50, mid * n))) for n in sizes[s])
            low, high = (mid, high) if got < target[s] else (low, mid)
        out[s] = (sizes[s], target[s], mid)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_rates_solve_the_dual(spark, parts):
    rows = rows_of(400)
    plan = plan_of(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"size": F.lit("x"), "rows": F.lit(1), "copies": F.lit(2), "told": F.lit(3)})
    out = mixing.mix(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), len((t or "").encode().split())) for i, t, *_ in rows)
    by_total = {(r["source_size"], round(r["target"], 6)) for r in out}
    assert by_total == {(sum(n), round(t, 6)) for n, t, _ in plan.values()}
    for n, target, at in plan.values():
        own = [r for r in out if r["source_size"] == sum(n) and round(r["target"], 6) == round(target, 6)]
        for r in own:
            assert r["rate"] == pytest.approx(min(2.0, math.exp(at * r["size"])) if r["size"] else 1.0, rel=1e-5)
            assert math.floor(r["rate"] + 1e-9) * r["size"] <= r["taken"] <= 2 * r["size"]
        assert abs(sum(r["taken"] for r in own) - target) <= max(min([x for x in n if x], default=1) * 3, 0.005 * target + 2)
    assert sorted(map(str, mixing.mix(docs.repartition(3)).collect())) == sorted(map(str, out))


def test_equal_rows(spark):
    """A hot group is shared out exactly, and the mix writes what the plan says."""
    rows = [(1, " ".join(["a"] * 10), "en", "s", 1)] * 41 + [(2, "b b b", "en", "s", 1)] + [(3, "c " * 7, "en", "t", 1)] * 5 + [(None, None, "en", None, None)] * 2500
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in out) == {1: 41, 2: 1, 3: 5, None: 2500}
    for source, ids in (("s", (1, 2)), ("t", (3,))):
        own = [r for r in out if r["doc_id"] in ids]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10 and source
    copies = Counter()
    for r in out:
        copies[r["doc_id"]] += r["copies"]
    written = mixing.mixed(docs)
    assert written.columns == docs.columns
    assert Counter(r["doc_id"] for r in written.collect()) == +copies


def test_written_rows(spark):
    rows = rows_of(200, 9)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"mix_copies": F.lit("x"), "doc": F.struct("lang"), "tags": F.create_map(F.lit("a"), "lang")})
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[str(r["doc_id"]), r["size"]] += r["copies"]
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter((str(r["doc_id"]), len((r["text"] or "").encode().split())) for r in got.collect()) == +want
    assert {r["mix_copies"] for r in got.collect()} == {"x"}


def test_empty_and_targets(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert mixing.targets([10, 100, 100], [5, 2, 1], 315, 2) == [20, pytest.approx(590 / 3), pytest.approx(295 / 3)]


def test_query(spark, tmp_path):
    rows = rows_of(100, 4)
    write_tables(spark, tmp_path, documents=spark.createDataFrame(rows, SCHEMA))
    out = QUERIES["op1_entropy_mixing"](spark, str(tmp_path)).collect()
    plan = plan_of(rows)
    assert {(r["source_size"], round(r["target"], 6)) for r in out} == {(sum(n), round(t, 6)) for n, t, _ in plan.values()} and len(out) == len(rows)
