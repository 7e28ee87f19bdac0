"""Harmonic packing of documents into sequences of ``capacity`` tokens.

Class k takes pieces of capacity // k tokens, k to a sequence.  A document is cut greedily: whole sequences first, then,
for a rest that lies in class k (capacity/(k+1) < rest <= capacity/k), the largest class length that it holds, until the
rest is at most ``tail``; a tail of n tokens is a piece of its own, capacity // n to a sequence.  So every class has one
exact length, and a piece's place follows from its number in its class: sequence = number // k, offset =
(number % k) * length.  Workers number their pieces on their own; only the counts a worker and class (a few dozen) are
summed up, and no piece moves to find its place.  A full sequence wastes less than its class's k tokens, 1.5 % at most.

Each class leaves fewer than k pieces over, some ten thousand pieces in all whatever the input (``leftover_bound``);
they are placed first-fit, longest first, in one small task.

Cases.  Null or blank text: the end id alone.  Null doc_id stays null.  Rows that repeat a doc_id: each is packed.
Very long texts: sequences of their own and a rest.  Ties of lengths: in the order in which they were met.  Extra columns, whatever
their names, aren't carried.  Empty table: empty result.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfield.llm import runtime
from gridfield.llm.encoding import encoder
from gridfield.llm.runtime import Scratch, release

runtime.ship(sys.modules[__name__])

#: Rows of a batch that are taken at a time.
ROWS = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, number long"


def cuts(n: int, capacity: int, tail: int) -> list[int]:
    """Lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > tail:
        k = capacity // n
        length = capacity // k if capacity // k == n else capacity // (k + 1)
        out.append(length)
        n -= length
    return out + [n] * (n > 0)


def leftover_bound(capacity: int, tail: int) -> int:
    lengths = {capacity // k for k in range(1, capacity // tail + 2)} | set(range(1, tail + 1))
    return sum(capacity // n - 1 for n in lengths)


def _pieces(path: str, end_id: int, capacity: int, tail: int):
    def task(batches):
        import zlib

        from pyspark import TaskContext

        release(keep=True)
        own, end, part, numbers, known = encoder(path), end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), {}, {}
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            out = [[] for _ in range(7)]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.encode(text) + end
                n, at = len(ids) // 4, 0
                lengths = known.get(n)
                if lengths is None:
                    lengths = known[n] = cuts(n, capacity, tail)
                for length in lengths:
                    number = numbers.get(length, 0)
                    numbers[length] = number + 1
                    for column, x in zip(out, (i, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n, part, number), strict=True):
                        column.append(x)
                    at += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "number"])

    return task


def _first_fit(capacity: int):
    """Leftovers come longest first; a sequence's free room is looked up among those that can hold the piece."""

    def task(batches):
        free: list[int] = []
        for batch in batches:
            sequence, offset = [], []
            for length in batch.column(2).to_pylist():
                k = next((k for k, room in enumerate(free) if room >= length), len(free))
                if k == len(free):
                    free.append(capacity)
                sequence.append(k)
                offset.append(capacity - free[k])
                free[k] -= length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*batch.schema.names, "place", "offset"])

    return task


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, tail: int = 64, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"))
    pieces = scratch.save(texts.mapInArrow(_pieces(path, end_id, capacity, tail), PIECES), "pieces")

    counts = pieces.groupBy("part", "length").agg((F.max("number") + 1).alias("n"))
    by_length = Window.partitionBy("length").orderBy("part")
    k = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    ranges = counts.withColumn("before", F.sum("n").over(by_length.rowsBetween(Window.unboundedPreceding, -1))).select("part", "length", F.coalesce("before", F.lit(0)).alias("before"), "n")
    ranges = scratch.save(ranges, "ranges")
    classes, first, names = [], 0, "length long, first long, full long"
    for r in ranges.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("length")).collect():  # one row a class length
        full = r["n"] // (capacity // r["length"])
        classes.append((r["length"], first, full))
        first += full
    table = F.broadcast(spark.createDataFrame(classes, names))  # under 200 rows: class lengths depend on capacity and tail only

    placed = pieces.join(ranges.select("part", "length", "before"), ["part", "length"]).withColumn("number", F.col("number") + F.col("before")).join(table, "length")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = placed.where(F.col("number") < F.col("full") * k).select(*columns, (F.col("first") + F.floor(F.col("number") / k)).cast("long").alias("sequence_id"), (F.col("number") % k * F.col("length")).alias("offset"))
    over = placed.where(F.col("number") >= F.col("full") * k).select(*columns, "number").repartition(1).sortWithinPartitions(F.desc("length"), "number")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, number long, place long, offset long"
    rest = over.mapInArrow(_first_fit(capacity), schema).select(*columns, (F.col("place") + first).alias("sequence_id"), "offset")
    return full.unionByName(rest)
