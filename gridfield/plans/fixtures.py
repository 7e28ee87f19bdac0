"""Fields made from the driver's tables: the vectors of ``embeddings`` and the prices of ``orders``, on 5 x 5 x 4 x n grids.

Rows past the last hundred are the grid's tail.
"""

from __future__ import annotations

import math
import sys
import tempfile
import uuid

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import algebra as A
from gridfield.lattice import Lattice
from gridfield.operators.gauge import Gauge

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(rows: DataFrame) -> Lattice:
    n = rows.count()
    return Lattice((5, 5, 4, n // 100), tail=n % 100)


def prices(spark: SparkSession, sf_dir: str) -> Field:
    orders = table(spark, sf_dir, "orders")
    return Field(grid(orders), orders.select(F.col("o_orderkey").alias("site"), F.col("o_totalprice").alias("v")))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[Lattice, DataFrame]:
    """site and e, the vector in doubles."""
    rows = table(spark, sf_dir, "embeddings")
    return grid(rows), rows.select(F.col("vec_id").alias("site"), F.col("embedding").cast("array<double>").alias("e"))


def element(k: int):
    return F.get(F.col("e"), F.lit(k))


def real(spark, sf_dir, first: int, shape: tuple[int, ...]) -> Field:
    lattice, rows = vectors(spark, sf_dir)
    v = F.slice("e", first + 1, math.prod(shape)) if shape else element(first)
    return Field(lattice, rows.select("site", v.alias("v")), shape)


def complex_(spark, sf_dir, first: int, shape: tuple[int, ...]) -> Field:
    lattice, rows = vectors(spark, sf_dir)
    values = [A.Complex(element(first + 2 * k), element(first + 2 * k + 1)) for k in range(math.prod(shape))]
    return Field(lattice, rows.select("site", A.save(values if shape else values[0]).alias("v")), shape, True)


def links(spark, sf_dir) -> Gauge:
    """Element 8 mu + 2 (2 i + j) + part: four 2 x 2 complex links."""
    lattice, rows = vectors(spark, sf_dir)
    u = F.array(*(A.save([A.Complex(element(8 * mu + 2 * k), element(8 * mu + 2 * k + 1)) for k in range(4)]) for mu in range(4)))
    return Gauge(lattice, rows.select("site", u.alias("u")), 2)


def shared_file(spark: SparkSession, name: str) -> str:
    """A new path in the folder that executors share; without spark.checkpoint.dir, of this machine in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{(found or 'file://' + tempfile.gettempdir() + '/gridfield-files').rstrip('/')}/{uuid.uuid4().hex}-{name}"


def thousandth_square(x: pd.Series) -> pd.Series:
    return x * x / 1000
