"""Substring dedup on tables without, with one, and with many repeats; repeated and missing ids; clashing columns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gridfield.llm import substrings
from gridfield.llm.queries import QUERIES
from common import SCHEMA, frame, write_tables


def brute(rows):
    """(doc_id, kept words, words before) of each row."""
    told = lambda t: hashlib.md5((t or "").encode()).hexdigest()[:15]
    turn = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, told(rows[k][1])))
    seen, out = set(), []
    for k in turn:
        w = (rows[k][1] or "").encode().split()
        keep = [True] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if g in seen:
                keep[s : s + 20] = [False] * 20
            seen.add(g)
        out.append((rows[k][0], b" ".join(x for x, y in zip(w, keep, strict=True) if y).decode(), len(w)))
    return sorted(out, key=str)


def got(df, **options):
    return sorted(((r["doc_id"], r["text"], r["n_words"]) for r in substrings.remove_repeats(df, 20, **options).collect()), key=str)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_few_and_no_repeats(spark, parts):
    rng = random.Random(parts)
    rows = [(i, prose(rng, 60)) for i in range(30)]
    assert got(frame(spark, rows).repartition(parts)) == brute(rows)
    rows.append((40, "a b c " + rows[7][1]))
    assert got(frame(spark, rows).repartition(parts)) == brute(rows)
    assert got(frame(spark, rows[:1]).repartition(parts)) == brute(rows[:1])


def odd_rows():
    rng = random.Random(8)
    shared, long = prose(rng, 40), prose(rng, 20_000)
    rows = [(None, prose(rng, 30) + " " + shared + f" tail{i}") for i in range(6)] + [(None, None), (None, ""), (3, shared), (3, "x " + shared), (3, prose(rng, 25))]
    rows += [(5, shared), (5, shared), (None, "same " + shared), (None, "same " + shared), (8, long), (9, long + " " + long), (10, "a " * 500), (2**63 - 1, shared + " end"), (-4, "z " + shared)]
    return rows


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_repeated_and_missing_ids(spark, parts):
    rows = odd_rows()
    assert got(frame(spark, rows).repartition(parts)) == brute(rows)


def test_whole_texts_stay(spark):
    rng = random.Random(2)
    a = "  two  blanks\n" + prose(rng, 30)
    rows = [(1, a), (2, None), (3, "x " + a.replace("  ", " "))]
    out = dict((r[0], r[1]) for r in got(frame(spark, rows), keep_whole=True))
    assert out[1] == a and out[2] is None and out[3] == "x"


def test_clashing_columns(spark):
    rows = odd_rows()
    df = frame(spark, rows).withColumns({"n_words": F.lit("a"), "N_REMOVED": F.lit(7), "own_shard": F.lit(1), "own_kind": F.lit(2), "shard": F.lit(3)})
    out = substrings.remove_repeats(df, 20)
    assert out.columns == [*df.columns, "n_words_", "n_removed_"]
    assert sorted(((r["doc_id"], r["text"], r["n_words_"]) for r in out.collect()), key=str) == brute(rows)
    assert out.where("n_words = 'a' and N_REMOVED = 7").count() == len(rows)


def test_query(spark, tmp_path):
    rows = odd_rows()
    write_tables(spark, tmp_path, documents=spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA))
    out = sorted(((r["doc_id"], r["n_words"], r["n_words"] - r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()), key=str)
    assert out == sorted(((i, n, len(t.split()), hashlib.sha256(t.encode()).hexdigest()) for i, t, n in brute(rows)), key=str)
