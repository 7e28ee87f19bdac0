"""Mixing sources to target weights by entropy balancing.

Rates r of documents are to stay as even as possible (relative entropy to rate 1) while each source's tokens meet its
target: sum of r * size = target, 0 <= r <= cap.  The convex dual has one multiplier a source, and its optimum gives
r = min(cap, exp(multiplier * size)): exponentially tilted rates.  Newton's method on the dual runs for all sources at
once.  A step is one aggregation over the table of (source, size, documents), gradient and curvature a source; a
bracket around each multiplier replaces steps that leave it.  Sums are exact decimals, so reruns agree bit by bit.

Rates become copies by carrying the error on: chunks of a source take their documents from the longest to the shortest,
give each floor or ceiling of its rate, whichever brings the chunk's words nearer to its share, and pass the rest on; what
remains is about the size of the shortest documents.  A source of any size is split into chunks of ``CHUNK`` documents
or so by a hash.  Rows that agree in every column are counted first and rounded together, as one entry: so many of them get
one copy more than the others.  However many they are, they make one entry, and are dealt out again by many tasks.

Targets.  ``share`` of all tokens is dealt by weight; a target stops at ``cap`` times its source's size and the excess is
dealt again by weight among the others until none is above.  With ``share`` over ``cap`` all stop there.

Only per-source figures reach the driver (``max_sources``, checked; more raise an error).

Cases.  Null or blank text: size 0, rate 1, one copy.  Null source: a source of its own, last in order.  Null doc_id or
rows that repeat one: each row is a document.  Ties between floor and ceiling: floor.  Sources with no tokens: target 0.
Very long texts: one number each.  Empty table: empty result.  Extra columns, whatever their names: ``mix`` leaves them out,
``mixed`` passes them through.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfield.llm import runtime
from gridfield.llm.runtime import SPACES, Scratch, dealt_out, fresh, partitions_for

runtime.ship(sys.modules[__name__])

CHUNK, MAX_SOURCES, STEPS = 4_000, 500_000, 60


def word_count(text) -> F.Column:
    """Number of words between blanks; null: 0."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))
    return F.when(bare == "", 0).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(" "))) + 1).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; none over cap times its size."""
    out, left, open_ = [0.0] * len(sizes), total, [k for k, w in enumerate(weights) if w > 0]
    while open_:
        unit = left / sum(weights[k] for k in open_)
        full = [k for k in open_ if unit * weights[k] > cap * sizes[k]]
        if not full:
            for k in open_:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = cap * sizes[k]
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def solve(hist: DataFrame, totals: list, goal: list[float], cap: float, tolerance: float = 1e-9) -> list[float]:
    """Multipliers by source number, from (source_no, size, documents).  See the module."""
    spark, n = hist.sparkSession, len(totals)
    size, longest = [t["size"] for t in totals], [t["longest"] for t in totals]
    low, high, at = [-1e9] * n, [1e9] * n, [0.0] * n
    shortest = [t["shortest"] or 1 for t in totals]
    live = []
    for k in range(n):
        if size[k] and goal[k] >= cap * size[k] * (1 - 1e-12):
            at[k] = math.log(cap) / shortest[k]  # all rates at the cap
        elif size[k] and abs(goal[k] - size[k]) > tolerance * size[k]:
            low[k], high[k] = (0.0, math.log(cap) / shortest[k]) if goal[k] > size[k] else (-800.0 / shortest[k], 0.0)
            live.append(k)
    x = F.least(F.col("at") * F.col("size"), F.lit(math.log(cap)))
    exact = lambda v: F.sum(v.cast("decimal(38,9)"))
    for _ in range(STEPS):
        if not live:
            break
        now = spark.createDataFrame([(k, at[k]) for k in live], "source_no int, at double")
        tilted = hist.join(now, "source_no").withColumn("r", F.exp(x))
        grown = F.col("documents") * F.col("size") * F.col("r")
        bend = F.when(F.col("at") * F.col("size") < math.log(cap), grown * F.col("size") / F.lit(float(max(longest))))
        seen = {r["source_no"]: r for r in tilted.groupBy("source_no").agg(exact(grown).alias("tokens"), exact(F.coalesce(bend, F.lit(0.0))).alias("bend")).collect()}
        still = []
        for k in live:
            short, curve = goal[k] - float(seen[k]["tokens"]), float(seen[k]["bend"]) * max(longest)
            if abs(short) <= tolerance * goal[k] or high[k] - low[k] <= 1e-15 * max(abs(low[k]), abs(high[k])):
                continue
            low[k], high[k] = (at[k], high[k]) if short > 0 else (low[k], at[k])
            step = at[k] + short / curve if curve > 0 else math.inf
            at[k] = step if low[k] < step < high[k] else (low[k] + high[k]) / 2
            still.append(k)
        live = still
    return at


def _round(cap: float):
    """A chunk's classes come together, longest first: the chunk's number, size, rate and rows first."""

    def task(batches):
        at, carry = None, 0.0
        for batch in batches:
            least, extra = [], []
            for chunk, size, rate, rows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if chunk != at:
                    at, carry = chunk, 0.0
                if size == 0:
                    least.append(1)
                    extra.append(0)
                    continue
                low = math.floor(rate + 1e-9)
                want = rate * size * rows + carry
                more = min(rows, max(0, math.ceil(want / size - low * rows - 0.5))) if rate - low > 1e-9 and low < math.floor(cap) else 0
                carry = want - (low * rows + more) * size
                least.append(low)
                extra.append(more)
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(least, pa.int64()), pa.array(extra, pa.int64())], [*batch.schema.names[3:], "least", "extra"])

    return task


def _row_hash(docs: DataFrame):
    """Of all columns that have a hash."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()))


def classes(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", max_sources: int = MAX_SOURCES) -> DataFrame:
    """A row for each set of equal rows: doc_id, told (a hash of the row), size, source_size, target, rate, rows, least
    (copies of each) and extra (rows that get one more).  weights repeat over the sources in code-point order, null last."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{source_column}`").cast("string").alias("source"), word_count(F.col(f"`{text_column}`")).alias("size"), _row_hash(docs).alias("told"))
    sized = scratch.save(sized.groupBy("doc_id", "source", "size", "told").agg(F.count("*").alias("rows")), "sizes")
    hist = scratch.save(sized.groupBy("source", "size").agg(F.sum("rows").alias("documents")), "classes")
    tokens = F.col("size") * F.col("documents")
    totals = hist.groupBy("source").agg(F.sum(tokens).alias("size"), F.sum("documents").alias("documents"), F.max("size").alias("longest"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("shortest")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"over {max_sources} sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    goal = targets([r["size"] for r in totals], [float(weights[k % len(weights)]) for k in range(len(totals))], share * sum(r["size"] for r in totals), cap)
    numbers = spark.createDataFrame([(r["source"], k) for k, r in enumerate(totals)], "name string, source_no int")
    named = scratch.save(hist.join(numbers, hist["source"].eqNullSafe(numbers["name"])).select("source_no", "size", "documents"), "numbered")
    at = solve(named, totals, goal, cap)
    plan = spark.createDataFrame([(r["source"], k, at[k], int(r["size"]), float(goal[k]), max(1, math.ceil(r["documents"] / CHUNK))) for k, r in enumerate(totals)], "name string, source_no int, at double, source_size long, target double, chunks int")
    rate = F.when(F.col("size") == 0, 1.0).otherwise(F.exp(F.least(F.col("at") * F.col("size"), F.lit(math.log(cap)))))
    planned = sized.join(plan, sized["source"].eqNullSafe(plan["name"])).withColumn("rate", rate).withColumn("chunk", F.concat_ws(":", "source_no", F.pmod(F.xxhash64("doc_id", "told"), F.col("chunks"))))
    columns = ["rows", "doc_id", "told", "size", "source_size", "target", "rate"]
    turned = planned.select("chunk", F.col("size").alias("by"), F.col("rate").alias("r"), *columns)
    parts = partitions_for(spark, sum(r["documents"] for r in totals), 100_000)
    dealt = turned.repartition(parts, "chunk").sortWithinPartitions("chunk", F.desc("by"), "doc_id", "told")
    schema = T.StructType([turned.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in ("least", "extra")])
    return scratch.save(dealt.mapInArrow(_round(cap), schema), "rounded", rows=sum(r["documents"] for r in totals))


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row a document: doc_id, size, source_size, target, rate, copies, taken.  options: as in ``classes``."""
    rows = dealt_out(classes(docs, **options), "rows", "turn").withColumn("copies", F.col("least") + (F.col("turn") < F.col("extra")).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", **options) -> DataFrame:
    """docs, each row as many times as the mix takes it.  Of equal rows, those with one copy more are repeats of one of them."""
    plan = classes(docs, id_column=id_column, **options)
    at, told, copies, turn = (fresh(x, docs.columns) for x in ("mix_id", "mix_told", "mix_copies", "mix_turn"))
    every = F.col("least") + (F.col("extra") == F.col("rows")).cast("long")
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))
    key = lambda count: [F.col("doc_id").alias(at), F.col("told").alias(told), count.cast("int").alias(copies)]

    def joined(wanted):
        found = docs.withColumn(f"{told}_own", _row_hash(docs))
        # the plan grows with the documents: it is never broadcast
        return found.join(wanted.hint("merge"), found[id_column].cast("long").eqNullSafe(wanted[at]) & (found[f"{told}_own"] == wanted[told])).drop(f"{told}_own")

    def repeated(rows, most):
        return rows.where(F.col(copies) > 0).withColumn(turn, F.explode(F.sequence(F.lit(1), most)))

    out = repeated(joined(plan.select(*key(every))), F.col(copies)).select(*docs.columns)
    wanted = plan.where(some).select(*key(F.col("extra")))
    if wanted.isEmpty():
        return out
    one = joined(wanted).groupBy(at, told).agg(F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"), F.first(copies).alias("n"))
    more = dealt_out(one.select("row", "n"), "n", "turn").select("row.*")
    return out.unionByName(more)
