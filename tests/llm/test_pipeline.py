"""The stages one after the other, each against what brute force says of its own input."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from common import SCHEMA, write_tables
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridfield.llm import mixing, packing, toxicity
from gridfield.llm.queries import tokenizer_path
from gridfield.llm.runtime import Scratch

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def key(r):
    return tuple(str(r[c]) for c in sorted(r))


def check_toxicity(spark, before, after, folder):
    """What goes is what the model, applied by hand, rejects."""
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in before], "doc_id long, text string") if before else spark.createDataFrame([], "doc_id long, text string")
    model = toxicity.train(docs, toxicity.graded(spark.read.parquet(f"{folder}/labels.parquet")))
    keep = []
    for r in before:
        z = sum(model.weights.get(f, 0.0) for f in sorted(toxicity.features((r["text"] or "").encode())))
        if sum(1 / (1 + math.exp(min(500, c - z))) for c in model.cuts) < model.cutoff:
            keep.append(r)
    assert sorted(map(key, after)) == sorted(map(key, keep))


def check_near_duplicates(spark, before, after, folder):
    """One row of each group stays: that of the smallest doc_id, all that repeat it with it."""
    sets = []
    for r in before:
        w = (r["text"] or "").lower().encode().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(before)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_gram = {}
    for k, s in enumerate(sets):
        for g in s or {None}:
            by_gram.setdefault(g, []).append(k)
    pairs = {(a, b) for g in by_gram.values() for b in g for a in g if a < b}
    for a, b in sorted(pairs):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(find(k), []).append(r)
    want, choices = [], []
    for rows in groups.values():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        if ids:
            want += [key(r) for r in rows if r["doc_id"] == min(ids)]
        else:
            choices.append({key(r) for r in rows})
    rest = Counter(map(key, after))
    for k in want:
        assert rest[k] > 0
        rest[k] -= 1
    left = list(rest.elements())
    assert len(left) == len(choices) and all(any(k in c for c in choices) for k in left)


def check_repeats(spark, before, after, folder):
    """Texts that have a window which starts earlier lose its words; others stay to the blank."""
    import hashlib

    told = lambda t: hashlib.md5((t or "").encode()).hexdigest()[:15]
    seen, want = set(), []
    for r in sorted(before, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, told(r["text"]))):
        w = words(r["text"])
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(g)
        text = r["text"] if all(keep) else b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode()
        want.append(key({**r, "text": text, "n_chars": len(text or "")}))
    assert sorted(map(key, after)) == sorted(want)


def check_mixing(spark, before, after, folder):
    """Each row as often as the plan says, sources near their targets."""
    if not before:
        assert not after
        return
    docs = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(" long", "").replace(" string", "").split(", ")) for r in before], SCHEMA)
    plan = mixing.mix(docs).collect()
    sources = {}
    for r in before:
        sources.setdefault(r["source"], []).append(len(words(r["text"])))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([sum(sources[s]) for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(map(sum, sources.values())), 2)
    taken = Counter()
    for r in after:
        taken[r["source"]] += len(words(r["text"]))
    for s, t in zip(names, goal, strict=True):
        assert abs(taken[s] - t) <= max(sources[s], default=0)
    assert sum(r["taken"] for r in plan) == sum(taken.values())
    copies, rows = Counter(map(key, after)), Counter(map(key, before))
    assert set(copies) <= set(rows) and all(n <= 2 * rows[k] for k, n in copies.items())


def check_packing(spark, before, after, folder):
    """Every token once, in sequences without gaps."""
    t = Tokenizer.from_file(tokenizer_path())
    want, sequences = Counter(), {}
    for r in before:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for n in packing.cuts(len(ids), 4096, 64):
            want[r["doc_id"], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in after) == want
    for r in after:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


CHECKS = {"toxicity": check_toxicity, "near_duplicates": check_near_duplicates, "substring_dedup": check_repeats, "mixing": check_mixing, "packing": check_packing}


def go_through(spark, docs, folder):
    columns, scratch = docs.columns, Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.save(stage(spark, docs, folder), name)
        if name != "packing":
            assert out.columns == columns
        CHECKS[name](spark, rows_of(docs), rows_of(out), folder)
        docs = out
    return out


def test_stages(spark):
    out = go_through(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def odd_rows():
    rng = random.Random(12)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    shared, rows = prose(60), []
    for i in range(60):
        text = prose(rng.randint(25, 150))
        if i % 5 == 1:
            text += "\n" + shared + f" end{i}"
        if i % 6 == 2:
            text += " vile awful nasty"
        rows.append((i, text, "en", rng.choice(["a", "b", None]), len(text)))
    rows += [(70 + k, rows[k][1].upper(), "en", "a", 1) for k in range(5)]
    rows += [(None, rows[9][1], "en", "b", 1), (None, None, None, None, None), (None, None, None, None, None), (None, "alone without an id", "en", "a", 1), (3, rows[3][1], "en", "a", 1), (80, "", "en", "a", 0), (81, " \n", "en", "c", 2), (82, "z" * 30_000 + " y" * 9000, "en", "b", 1)]
    return rows + [rows[11]] * 40


@pytest.mark.parametrize("clash", [False, True])
def test_odd_tables(spark, tmp_path, clash):
    """Nulls, blanks, copies, a row 41 times, a long text; columns named like those that the operators add."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 6 == 2)) for i in range(60)], "doc_id long, quality int, toxic int")
    write_tables(spark, tmp_path, documents=docs, labels=labels)
    if not clash:
        go_through(spark, docs.repartition(4), str(tmp_path))
        return
    named = {"toxic": F.lit(True), "severity": F.lit(9), "n_removed": F.lit(0), "n_words": F.lit(0), "whole": F.lit("x"), "told": F.lit(1), "root": F.lit(2), "mix_copies": F.lit(0), "copies": F.lit(0), "own_kind": F.lit(3), "id": F.lit(4)}
    scratch, plain, odd = Scratch(spark, "test"), docs.repartition(4), docs.repartition(4).withColumns(named)
    for name, stage in corpus_pipeline.STAGES:
        plain, odd = scratch.save(stage(spark, plain, str(tmp_path)), f"{name}-plain"), scratch.save(stage(spark, odd, str(tmp_path)), f"{name}-odd")
        if name != "packing":
            assert odd.columns == [*docs.columns, *named]
        if name in ("toxicity", "near_duplicates", "substring_dedup"):
            assert sorted(map(str, odd.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
            assert odd.select(*named).distinct().count() == 1
        elif name == "mixing":
            assert {r["doc_id"]: r["n"] for r in odd.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}.keys() == {r["doc_id"] for r in plain.collect()}


def test_empty_tables(spark, tmp_path):
    write_tables(spark, tmp_path, documents=spark.createDataFrame([], SCHEMA), labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
