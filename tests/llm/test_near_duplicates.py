"""The pipeline's near duplicates: the least similarity, stars, repeated lines, rows without ids."""

import random

from common import SCHEMA
from pyspark.sql import functions as F

import corpus_pipeline
from gridfield.llm import simhash


def sentence(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def near_ids(spark, rows):
    """The ids that the pipeline's stage keeps."""
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(4)
    return [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id").collect()]


def test_no_pair_at_the_least_similarity_is_missed(spark):
    rng, rows = random.Random(21), []
    for i in range(150):  # 90 shingles each, 80 in common
        base = sentence(rng, 94)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base[:-10] + sentence(rng, 10)))]
    assert sorted(near_ids(spark, rows)) == list(range(0, 300, 2))


def test_unlike_copies_of_one_text_all_go(spark):
    """A star: copies are 0.8 like the original (id 0) and less than that like each other."""
    rng = random.Random(22)
    base = sentence(rng, 94)
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        w, (a, b) = list(base), rng.choice([(x, y) for x in range(5, 84) for y in range(x + 5, 89)])
        w[a], w[b] = sentence(rng, 2)
        rows.append((i, " ".join(w)))
    assert near_ids(spark, rows) == [0]


def test_repeated_lines_neither_join_nor_part_texts(spark):
    """Similarity is one of sets, however often a shingle stands in a text."""
    rng, rows, want = random.Random(23), [], []
    line = " ".join(sentence(rng, 12))
    for i in range(20):  # own shingles, and a line that they share 30 times over
        rows.append((i, "\n".join([" ".join(sentence(rng, 104)), *[line] * 30])))
        want.append(i)
    for i in range(20, 24):  # one shingle makes over half of all
        rows.append((i, " ".join(sentence(rng, 40) + ["la"] * 100)))
        want.append(i)
    for i in range(30, 50, 2):  # a copy with one of its lines 20 times more
        base = sentence(rng, 200)
        rows += [(i, " ".join(base)), (i + 1, " ".join(base + base[:10] * 20))]
        want.append(i)
    assert sorted(near_ids(spark, rows)) == want


def test_rows_without_ids_are_rows_of_their_own(spark):
    rng = random.Random(24)
    a, b, c = (" ".join(sentence(rng, 60)) for _ in range(3))
    rows = [(5, a), (9, b), (None, a.upper()), (None, b.upper()), (None, c), (None, c), (None, c.upper()), (7, b + " x"), (7, c + " y z")]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(3)
    first = {i: {r["component_id"] for r in simhash.groups(docs, simhash.spare_families(2)).where(f"doc_id <=> {i}").collect()} for i in ("5", "9")}
    assert first == {"5": {5}, "9": {9}}
    kept = simhash.keep_one(docs.where("doc_id is null or doc_id <> 7"), simhash.spare_families(2), 3).select("doc_id", F.lower("text")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(5, a), (9, b), (None, c)], key=str)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == sorted([(5, a), (7, b + " x"), (7, c + " y z")])
