"""A uniform shuffle of rows into shards of exact sizes, after a hypergeometric communication matrix.

Rows lie in cells (by a hash of the row).  How many rows of each cell go to each shard is drawn as a uniform
shuffle would have it: cell by cell, a multivariate hypergeometric draw from what is left of the shards.  Then each
cell permutes its rows and deals the first so many to shard 0, the next to shard 1, and so on; rows are exchanged; and
each shard permutes again.  The second permutation orders a shard by a hash in ranges, so that a shard of any size is
ordered by many tasks: a row's slot is the number of rows in earlier ranges plus its place in its own.

All of it is DataFrame functions; the matrix, one row a cell, is drawn on the driver from the counts by a seeded
generator, so reruns agree.  A draw inverts the distribution function, summed from exact ratios of neighbouring chances,
over twelve deviations to both sides of the mode: what lies beyond (under 1e-30) is less than doubles tell.  Totals are only
bounded by 2**53 rows.

Rows that agree in doc_id, size and checksum are counted first and numbered, and the number is hashed with the row: however
many they are, they spread over all cells, shards and ranges.

Cases.  Null text: no bytes, crc of nothing.  Null doc_id, repeated ones: rows like others.  Rows alike: numbered, as above.
Ties of hashes: in order of doc_id, size, checksum and number.  Very long texts: one number each.  Extra columns, whatever
their names, aren't carried.  Fewer rows than shards: sizes 0 or 1.  Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfield.llm.runtime import Scratch, dealt_out

CELLS, CELL_ROWS, RANGES = 256, 1_000_000, 32


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken from good + bad are good."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    every, share = good + bad, good / (good + bad)
    wide = 12 * (draws * share * (1 - share) * (every - draws) / max(1, every - 1)) ** 0.5 + 30
    mode = (draws + 1) * (good + 1) // (every + 2)
    low, high = max(low, int(mode - wide)), min(high, int(mode + wide))
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (draws - k)) - np.log((k + 1) * (bad - draws + k + 1))
    chance = np.r_[0.0, np.cumsum(steps)]
    total = np.cumsum(np.exp(chance - chance.max()))
    return low + int(np.searchsorted(total, rng.random() * total[-1], side="right").clip(0, high - low))


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """rows: cells; columns: shards.  Row sums are counts, column sums differ by one at most."""
    rng, n = np.random.default_rng(seed), sum(counts)
    left = [n // shards] * shards
    for k in rng.permutation(shards)[: n % shards].tolist():
        left[k] += 1
    out = np.zeros((len(counts), shards), np.int64)
    for cell, draws in enumerate(counts):
        rest = sum(left)
        for k in range(shards):
            rest -= left[k]
            taken = hypergeometric(rng, left[k], rest, draws)
            out[cell, k], left[k], draws = taken, left[k] - taken, draws - taken
    return out


def shuffle(docs: DataFrame, shards: int = 40, seed: int = 17, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a document: doc_id, size, text_crc32, shard, slot."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "shards")
    text, own = F.coalesce(F.col(f"`{text_column}`"), F.lit("")), ["doc_id", "size", "text_crc32"]
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = scratch.save(rows.groupBy(*own).agg(F.count("*").alias("rows")), "rows")
    n = alike.agg(F.sum("rows")).first()[0] or 0
    cells = max(CELLS, -(-n // CELL_ROWS))
    turn = lambda k: F.xxhash64(F.lit(seed + k), *own, "number")
    celled = dealt_out(alike, "rows", "number").withColumn("cell", F.pmod(turn(0), F.lit(cells)).cast("int"))
    counts = {r["cell"]: r["n"] for r in celled.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    drawn = matrix([counts.get(k, 0) for k in range(cells)], shards, seed)
    ends = spark.createDataFrame([(k, row) for k, row in enumerate(np.cumsum(drawn, axis=1).tolist())], "cell int, ends array<long>")
    order = Window.partitionBy("cell").orderBy(turn(1), *own, "number")
    dealt = celled.withColumn("place", F.row_number().over(order)).join(ends, "cell")
    # ends ascend: the shard is the number of ends below the place
    shard = F.size(F.filter("ends", lambda e: e < F.col("place"))).cast("int")
    ranges = max(RANGES, -(-n // (shards * CELL_ROWS)))
    ranged = dealt.select(*own, "number", shard.alias("shard"), turn(2).alias("turn"))
    # the range is the turn's place on the circle of hashes, so ranges ascend with turns
    ranged = scratch.save(ranged.withColumn("range", F.floor((F.col("turn") / F.lit(2.0**64) + 0.5) * ranges).cast("int")), "dealt")
    totals = ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = totals.select("shard", "range", before.alias("first"))
    place = F.row_number().over(Window.partitionBy("shard", "range").orderBy("turn", *own, "number")) - 1
    return ranged.withColumn("place", place).join(firsts, ["shard", "range"]).select(*own, "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
