"""Toxicity by cumulative-link (proportional odds) ordinal regression on sparse text features.

P(severity > j) = logistic(w.x - cut_j), with one weight vector for all thresholds and ascending cuts; the expected
severity is the sum of these probabilities over j, from 0 to the top grade.

Features: the distinct words of the whole text, letters and digits only, A-Z in lower case, and the words' beginnings of
4 to 6 bytes, which stand for stems that many endings follow; hashed to ``DIMENSIONS``.  A feature is 1 if present.  A
document's evidence must not thin out as the text grows, so features aren't divided by length, and only features that lean
to either label beyond chance in the labelled sample (likelihood ratio, in ``MIN_DOCS`` documents at least) have weights, and
the ``FEW`` that lean most to toxic: the many words that no label speaks of weigh nothing.

Grades are the labels': 0 is clean, and 1, 2, ... worse and worse.  ``graded`` makes three of the labels toxic and quality: a
toxic document that is also of poor quality is worse than one of good quality.  Grades without labelled documents above the
highest one seen have no threshold.

Fitting takes a bounded sample of labelled documents, those with the smallest hashes of doc_id, up to ``per_label`` clean
and as many others; scoring reads every text.  A document is rejected if its expected severity reaches ``cutoff``, which is
chosen on a quarter of each grade's sample that isn't fitted on: above the expected severity of all but ``max_false`` of the
clean held-out documents (of all, in small samples), half the way to the next toxic one.

Cases.  Null or blank text: no features, the severity of the cuts alone, so not rejected.  No labelled documents, or
labels of one kind: every severity near 0, none rejected.  Labels that are null count as none; repeated labels of a document:
the worst.  Null doc_id: scored, never labelled; rows that repeat a labelled doc_id are all in the sample.  Very long texts: distinct
words only.  Ties with the cutoff: rejected.  Extra columns pass through; added columns take underscores if their names are
taken (``added_columns``).  Empty table: empty result.
"""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfield.llm import runtime
from gridfield.llm.runtime import fresh, release, sampled

runtime.ship(sys.modules[__name__])

DIMENSIONS, MIN_DOCS, PER_LABEL = 1 << 20, 3, 3000
#: Features that lean most to toxic and have weights in any case.
FEW = 8
#: Rows of a batch that are scored at a time.
ROWS = 1000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def of_word(w: bytes) -> set[int]:
    """Hashed features of one word."""
    import zlib

    return {zlib.crc32(w) & (DIMENSIONS - 1), *(zlib.crc32(b"^" + w[:k]) & (DIMENSIONS - 1) for k in (4, 5, 6) if len(w) >= k)}


def features(text: bytes) -> set[int]:
    out: set[int] = set()
    for w in set(WORD.findall(text.lower())):
        out |= of_word(w)
    return out


class Model:
    def __init__(self, weights: dict[int, float], cuts: list[float], cutoff: float):
        self.weights, self.cuts, self.cutoff = weights, cuts, cutoff

    def above(self, z: np.ndarray) -> np.ndarray:
        """Chances of a severity over each threshold, a row a document."""
        return 1 / (1 + np.exp(np.clip(np.array(self.cuts)[None, :] - z[:, None], -500, 500)))

    def severity(self, found: list) -> np.ndarray:
        """Expected severity of each of these sets of features."""
        return self.above(np.array([sum(self.weights.get(f, 0.0) for f in x) for x in found])).sum(axis=1)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0 clean, 1 toxic, 2 toxic and of poor quality."""
    poor = F.coalesce((F.col("quality") == 0).cast("int"), F.lit(0))
    return labels.select("doc_id", F.when(F.col("toxic") > 0, 1 + poor).otherwise(F.col("toxic")).alias("grade"))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, dimensions: int, top: int, penalty: float = 0.02, steps: int = 300):
    """Maximum likelihood with a ridge penalty, by accelerated gradient steps.  rows: indices of a document's features."""
    n = len(rows)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    balance = np.array([n / max(1, (grades == g).sum()) for g in range(top + 1)])[grades]
    balance /= balance.mean()
    w, cuts = np.zeros(dimensions), np.linspace(1.0, 1.0 + top, top)
    step = np.zeros(dimensions)
    seen = np.bincount(flat, minlength=dimensions)
    scale = 1 / np.sqrt(np.maximum(seen, 1))
    rate, vw, vc = 1.0, step.copy(), np.zeros(top)
    for _ in range(steps):
        z = np.bincount(owner, weights=(w * scale)[flat], minlength=n)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -50, 50)))
        full = np.c_[np.ones(n), above, np.zeros(n)]
        p = np.maximum(full[np.arange(n), grades] - full[np.arange(n), grades + 1], 1e-12)
        slope = np.c_[np.zeros(n), above * (1 - above), np.zeros(n)]
        gz = balance * (slope[np.arange(n), grades] - slope[np.arange(n), grades + 1]) / p
        gw = np.bincount(flat, weights=gz[owner], minlength=dimensions) * scale - penalty * w
        gc = np.array([-(balance * ((grades == j + 1).astype(float) - (grades == j)) * slope[:, j + 1] / p).sum() for j in range(top)])
        vw, vc = 0.9 * vw + gw, 0.9 * vc + gc
        w = w + rate * vw / np.sqrt(n)
        cuts = np.sort(cuts + rate * 0.3 * vc / n)
    return w * scale, cuts


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, max_false: float = 0.002, id_column: str = "doc_id", text_column: str = "text", label_column: str = "grade") -> Model:
    told = labels.where(F.col("doc_id").isNotNull() & F.col(label_column).isNotNull()).groupBy("doc_id").agg(F.max(label_column).cast("int").alias("y"))
    chosen = [r for kind in (F.col("y") <= 0, F.col("y") > 0) for r in sampled(told.where(kind), "doc_id", per_label).collect()]
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in chosen], "label_id long, y int")
    sample = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text")).join(F.broadcast(ids), F.col("id") == F.col("label_id"))  # at most 2 * per_label ids

    def found(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.array(sorted(features(t)), "<u4").tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["id", "y", "f"])

    rows = sorted(sample.select("id", "y", "text").mapInArrow(found, "id long, y int, f binary").collect(), key=lambda r: (r["id"], len(r["f"])))
    return fit(rows, max_false)


def fit(rows: list, max_false: float) -> Model:
    """rows: y (a grade from 0) and f, distinct features as little-endian unsigned 32-bit integers."""
    grades = np.array([max(0, r["y"]) for r in rows], np.int64)
    y = grades > 0
    if not len(rows) or y.all() or not y.any():
        return Model({}, [50.0], 1.0)
    found = [np.frombuffer(r["f"], "<u4").astype(np.int64) for r in rows]
    held = np.zeros(len(rows), bool)
    for g in np.unique(grades):
        held[np.flatnonzero(grades == g)[3::4]] = True
    count = lambda chosen: np.bincount(np.concatenate([np.zeros(0, np.int64), *(found[k] for k in np.flatnonzero(chosen))]), minlength=DIMENSIONS).astype(float)
    bad, good = count(~held & y), count(~held & ~y)
    n1, n0, seen = float((~held & y).sum()), float((~held & ~y).sum()), bad + good
    n = n1 + n0
    # likelihood-ratio statistic of presence against the label; chance alone passes 2 ln(tests) about once
    ratio = lambda x, of: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(of, 1e-9)), 0.0)
    lean = 2 * (ratio(bad, seen * n1 / n) + ratio(good, seen * n0 / n) + ratio(n1 - bad, (n - seen) * n1 / n) + ratio(n0 - good, (n - seen) * n0 / n))
    usual, up = seen >= MIN_DOCS, bad * n0 > good * n1
    hints = np.flatnonzero(usual & up)
    kept = np.union1d(np.flatnonzero(usual & (lean > 2 * np.log(max(2, usual.sum())))), hints[np.argsort(-lean[hints], kind="stable")[:FEW]])
    place = np.full(DIMENSIONS, -1)
    place[kept] = np.arange(len(kept))
    index = [p[p >= 0] for p in (place[f] for f in found)]
    part = np.flatnonzero(~held)
    w, cuts = fit_ordinal([index[k] for k in part], grades[part], len(kept), int(grades.max()))
    model = Model({int(f): float(x) for f, x in zip(kept, w, strict=True)}, [float(c) for c in cuts], 1.0)
    told = model.severity([kept[p].tolist() for p in index])
    clean, toxic = np.sort(told[held & ~y]), told[held & y]
    if len(clean) == 0 or len(toxic) == 0:
        clean, toxic = np.sort(told[~y]), told[y]
    low = clean[len(clean) - 1 - int(max_false * len(clean))]
    over = toxic[toxic > low]
    model.cutoff = float(low + (np.min(over) - low) / 2) if len(over) else len(cuts) + 0.1
    return model


def added_columns(taken: list[str]) -> list[str]:
    """What ``score`` calls the expected severity, the severity and the verdict."""
    return [fresh(x, taken) for x in ("expected_severity", "severity", "toxic")]


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """docs with expected_severity, severity (how many thresholds it is likely over) and toxic (rejected)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    added = added_columns(names)
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + [T.StructField(n, t) for n, t in zip(added, (T.DoubleType(), T.IntegerType(), T.BooleanType()), strict=True)])
    arrow, at, weights = to_arrow_schema(schema), names.index(text_column), model.weights

    def task(batches):
        release()
        import zlib

        known: dict[bytes, tuple] = {}

        def weighty(w: bytes) -> tuple:
            """A word's features that have a weight."""
            if len(known) > 200_000:
                known.clear()
            found = known[w] = tuple(f for f in of_word(w) if f in weights)
            return found

        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            total = []
            for text in batch.column(at).to_pylist():
                once: set[int] = set()
                for w in set(WORD.findall((text or "").encode().lower())):
                    own = known.get(w)
                    once.update(weighty(w) if own is None else own)
                total.append(sum(weights[f] for f in sorted(once)))
            p = model.above(np.array(total, float))
            mean = p.sum(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(mean), pa.array((p > 0.5).sum(axis=1).astype(np.int32)), pa.array(mean >= model.cutoff)], arrow.names)

    return docs.mapInArrow(task, schema)
