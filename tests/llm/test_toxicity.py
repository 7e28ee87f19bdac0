"""Ordinal toxicity: held-out accuracy, the fit against other weights, scores by hand, odd rows."""

import math
import random

import numpy as np
import pytest
from common import SCHEMA, frame, write_tables
from pyspark.sql import functions as F

from gridfield.llm import toxicity
from gridfield.llm.queries import QUERIES

MILD, SEVERE = ["vile", "awful", "nasty", "rotten"], ["killing", "hateful", "murderous", "scumbag"]


def corpus(n=600, seed=1):
    """Texts and their grades: two mild words, or two of either kind."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        w = ["".join(rng.choices("lmnopq", k=4)) for _ in range(60)]
        grade = (0, 0, 0, 1, 0, 2)[i % 6]
        if grade:
            w[3:5] = rng.sample(MILD, 2)
        if grade == 2:
            w[20:22] = rng.sample(SEVERE, 2)
        rows.append((i, " ".join(w), grade))
    return rows


def trained(spark, rows, told):
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame(told, "doc_id long, grade int")
    return docs, toxicity.train(docs, labels)


def test_held_out(spark):
    rows = corpus()
    docs, model = trained(spark, rows, [(i, g) for i, _, g in rows[:420]])
    assert len(model.cuts) == 2 and model.cuts[0] < model.cuts[1]
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = rows[420:]
    assert sum(out[i]["toxic"] == (g > 0) for i, _, g in held) >= len(held) - 3
    assert not any(out[i]["toxic"] for i, _, g in held if g == 0)
    mean = [np.mean([out[i]["expected_severity"] for i, _, g in held if g == k]) for k in range(3)]
    assert mean[0] < 0.3 and mean[0] + 0.4 < mean[1] < mean[2] - 0.4
    assert sum(out[i]["severity"] == g for i, _, g in held) >= 0.95 * len(held)
    # scores by hand: one weight vector, a threshold a grade
    for i, text, _ in rows[:40]:
        z = sum(model.weights.get(f, 0.0) for f in toxicity.features(text.encode()))
        assert out[i]["expected_severity"] == pytest.approx(sum(1 / (1 + math.exp(c - z)) for c in model.cuts))


def test_no_other_weights_are_better():
    """The penalized, balanced likelihood at the fit against small steps away from it."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 300)
    rows = [np.flatnonzero(rng.random(8) < 0.2 + 0.25 * (g * (np.arange(8) < 4) / 2)) for g in grades]
    balance = np.array([300 / (grades == g).sum() for g in range(3)])[grades]
    balance /= balance.mean()
    scale = np.sqrt(np.bincount(np.concatenate(rows), minlength=8))

    def loss(w, cuts):
        z = np.array([w[r].sum() for r in rows])
        above = np.c_[np.ones(300), 1 / (1 + np.exp(np.array(cuts)[None, :] - z[:, None])), np.zeros(300)]
        p = above[np.arange(300), grades] - above[np.arange(300), grades + 1]
        return -(balance * np.log(p)).sum() + 0.01 * ((w * scale) ** 2).sum()

    w, cuts = toxicity.fit_ordinal(rows, grades, 8, 2)
    here = loss(w, cuts)
    for k in range(8):
        for step in (0.05, -0.05):
            assert loss(w + step * (np.arange(8) == k), cuts) > here - 0.02
    for k in range(2):
        for step in (0.05, -0.05):
            assert loss(w, cuts + step * (np.arange(2) == k)) > here - 0.02


def test_odd_labels_and_rows(spark):
    rows = corpus(200)
    docs, model = trained(spark, rows, [])
    assert toxicity.score(docs, model).where("toxic").count() == 0
    docs, model = trained(spark, rows, [(i, 0) for i, _, _ in rows])
    assert toxicity.score(docs, model).where("toxic or severity > 0").count() == 0
    told = [(i, g) for i, _, g in rows] + [(None, 2), (3, None), (0, None), (10**6, 1), (3, 0)]
    docs, model = trained(spark, rows, told)
    odd = spark.createDataFrame([(None, None, "en", "a", 0), (1, "", "en", "a", 0), (1, "vile nasty awful rotten", "en", "a", 0), (2, "lmno " * 50_000 + " ".join(MILD), "en", "a", 0)], SCHEMA).withColumns({"toxic": F.lit(True), "SEVERITY": F.lit("s"), "y": F.lit(1)})
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "expected_severity", "severity_", "toxic_"]
    assert {(r["doc_id"], r["text"] and r["text"][:4]): r["toxic_"] for r in out.collect()} == {(None, None): False, (1, ""): False, (1, "vile"): True, (2, "lmno"): True}
    assert out.where("toxic and SEVERITY = 's'").count() == 4
    assert toxicity.score(frame(spark, []), model).count() == 0 and toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), toxicity.graded(spark.createDataFrame([], "doc_id long, quality int, toxic int")))).count() == 0


def test_query(spark, tmp_path):
    rows = corpus(400)
    labels = [(i, int(g != 2), int(g > 0)) for i, _, g in rows[:300]]
    write_tables(spark, tmp_path, documents=frame(spark, [(i, t) for i, t, _ in rows]), labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in QUERIES["op7_ordinal_toxicity"](spark, str(tmp_path)).collect()}
    assert len(out) == 400 and sum(out[i]["toxic"] == (g > 0) for i, _, g in rows[300:]) >= 98
