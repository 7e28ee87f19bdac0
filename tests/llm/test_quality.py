"""Quality rules: counts and certified cutoffs against brute force, odd rows, hard and clashing columns."""

import random
import re
from collections import Counter
from math import comb

import pytest
from common import SCHEMA
from pyspark.sql import functions as F

from gridfield.llm import quality


def counts(text):
    t = text or ""
    w = t.encode().split()
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if x.encode().split()]
    return {
        "n_words": len(w),
        "word_chars": sum(len(x.decode()) for x in w),
        "n_symbols": sum(t.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_capitals": len(re.findall("[A-Z]", t)),
        "n_marks": t.count("!"),
    }


def rejected_from(c):
    share = lambda a, b: c[a] / c[b] if c[b] else 0.0
    metric = {"symbol_share": share("n_symbols", "word_chars"), "duplicate_line_share": share("n_dup_lines", "n_lines"), "repeat_word_share": share("n_repeat_words", "n_words"), "capital_share": share("n_capitals", "word_chars"), "exclamation_share": share("n_marks", "n_words") / 5}
    return min([k for r, x in metric.items() for k, cut in enumerate(quality.GRIDS[r]) if x > cut], default=quality.STEPS)


def judged(rows, labels):
    """By row: its counts, base_failed and kept; certification by exact binomial sums."""
    told = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            told[i] = min(q, told.get(i, q))
    good = {i for i, q in told.items() if q == 1}
    seen = [(i, lang, counts(t)) for i, t, lang, *_ in rows]
    failed = [c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"] for *_, c in seen]
    held = {}
    for (i, lang, c), bad in zip(seen, failed, strict=True):
        if i in good and not bad:
            held.setdefault(lang, []).append(rejected_from(c))
    step = {}
    for lang, steps in held.items():
        n, p = len(steps), quality.RISK
        for s in range(quality.STEPS):
            k = sum(x <= s for x in steps)
            if k > n * p or sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > quality.LEVEL / len(held):
                break
            step[lang] = s
    return [(i, c, bad, not bad and (lang not in step or rejected_from(c) > step[lang])) for (i, lang, c), bad in zip(seen, failed, strict=True)], step


def odd_rows():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    rows = []
    for i in range(700):
        text = " ".join(rng.choices(words, k=rng.randint(40, 120)))
        if i % 9 == 0:
            text = text.replace(" ", " *$ ", rng.randint(0, 60))
        if i % 100 == 7:
            text = "\n".join([text[:200]] * rng.randint(1, 4))
        if i % 90 == 9:
            text = text.upper()
        rows.append((i, text, ("en", "en", "de", None)[i % 4], "a", 1))
    rows += [(None, None, "en", "a", 1), (None, "no id " * 30, None, "a", 1), (5, rows[5][1], "en", "a", 1), (5, "*" * 500, "de", "a", 1), (800, "", "xx", "a", 1), (801, " \n\t", "en", "a", 1), (802, "é ß! " * 9000, "en", "a", 1), (803, "A! " * 60, "en", "a", 1)]
    labels = [(i, int(i % 9 != 0 or i % 270 == 0), 0) for i in range(700)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (4, 1, 0), (5, 1, 0), (5, 1, 1), (9999, 1, 0)]
    return rows, labels


@pytest.mark.parametrize("parts", [1, 5])
def test_against_brute_force(spark, parts):
    rows, labels = odd_rows()
    want, step = judged(rows, labels)
    assert step and any(not k and not bad for _, _, bad, k in want) and len(step) < 4  # some cutoffs bite, some are not certified
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts).withColumns({"words": F.lit("x"), "stratum": F.lit("y"), "n_words": F.lit(1), "step": F.lit(0), "w": F.lit(2)})
    out = quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = sorted((str(r["doc_id"]), *(r[c] for c in want[0][1]), r["base_failed"], r["kept"]) for r in out)
    assert got == sorted((str(i), *c.values(), bad, kept) for i, c, bad, kept in want)


def test_many_strata_are_joined(spark, monkeypatch):
    rows, labels = odd_rows()
    monkeypatch.setattr(quality, "MAX_STRATA", 0)
    docs, told = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want, _ = judged(rows, labels)
    assert sorted((str(r["doc_id"]), r["kept"]) for r in quality.judge(docs, told).collect()) == sorted((str(i), k) for i, _, _, k in want)


def test_no_labels_and_no_rows(spark):
    rows, labels = odd_rows()
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    out = quality.judge(docs, none).collect()
    assert all(r["kept"] != r["base_failed"] for r in out) and len(out) == len(rows)
    assert quality.judge(docs.limit(0), none).count() == 0


def test_false_rejections_stay_under_the_risk(spark):
    """Over many draws of holdouts, the certified step loses over the risk's share of good documents in 5 % of them at most."""
    rng, bad, draws = random.Random(7), 0, 200
    chance = [0.001] * 4 + [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12]  # true share that each step rejects
    rows = []
    for d in range(draws):
        for _ in range(300):
            u = rng.random()
            rows.append((f"s{d}", next((k for k, c in enumerate(chance) if u < c), quality.STEPS)))
    held = spark.createDataFrame(rows, "stratum string, rejected_from int")
    step = {}
    for d in range(0, draws, 50):  # one stratum at a time would take a job each; 50 share one with level for each
        part = held.where(F.col("stratum").isin([f"s{k}" for k in range(d, d + 50)]))
        step |= {r["stratum"]: r["step"] for r in quality.certified(part, level=0.05 * 50).collect()}
    bad = sum(chance[s] > quality.RISK for s in step.values())
    assert bad <= 0.05 * draws + 3 * (0.05 * 0.95 * draws) ** 0.5 and len(step) > draws / 2


def test_binomial_tail(spark):
    row = spark.range(1).select(quality.binomial_tail(F.lit(3), F.lit(900), 0.01).alias("p"), quality.binomial_tail(F.lit(0), F.lit(173), 0.025).alias("q")).first()
    assert row["p"] == pytest.approx(sum(comb(900, k) * 0.01**k * 0.99 ** (900 - k) for k in range(4))) and row["q"] == pytest.approx(0.975**173)
