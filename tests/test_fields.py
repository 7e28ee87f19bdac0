"""Algebraic laws of fields, shifts, links and duals."""

import math

import pytest
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import algebra as A
from gridfield.functions import seeds
from gridfield.lattice import Lattice
from gridfield.operators import stencils
from gridfield.operators.gauge import Gauge

LAT = Lattice((3, 4, 5))


def values(f):
    return {r["site"]: r["v"] for r in f.df.collect()}


def index_field(spark, lat=LAT):
    return Field(lat, lat.sites(spark).select("site", F.col("site").cast("double").alias("v")))


def test_shift_laws(spark):
    f = index_field(spark)
    start = values(f)
    assert values(f.shift((1, 0, 0)).shift((-1, 0, 0))) == start
    assert values(f.shift((0, 4, 0))) == start
    assert values(f.shift((1, 2, 0)).shift((0, 0, 3))) == values(f.shift((0, 0, 3)).shift((1, 2, 0)))
    one = values(f.shift((0, 0, 1)))
    assert all(one[LAT.site_of(x)] == LAT.site_of((x[0], x[1], x[2] + 1)) for x in map(LAT.coords_of, range(60)))
    assert values(f.transport(1)) == values(f.shift((0, -1, 0)))


def test_laplacian(spark):
    assert set(values(Field.filled(spark, LAT, value=3.0).laplacian()).values()) == {0.0}
    linear = Field(LAT, LAT.sites(spark).select("site", (F.col("x0") + F.col("x1") + F.col("x2")).cast("double").alias("v")))
    out = values(linear.laplacian())
    assert all(out[LAT.site_of(x)] == 0 for x in map(LAT.coords_of, range(60)) if all(0 < c < n - 1 for c, n in zip(x, LAT.dims, strict=True)))


def test_unit_links(spark):
    g = Gauge.unit(spark, Lattice((2, 3, 2, 4)), 3)
    assert g.link_trace().first()[0] == 1.0
    assert g.plaquette().first()[0] == 1.0


def test_parallelogram_is_refused(spark):
    with pytest.raises(ValueError):
        Gauge.unit(spark, Lattice((2, 2)), 2).action(1.0, cpg=1.0)


def test_inverse(spark):
    row = spark.createDataFrame([([2.0, 1.0, 0.0, 1.0, 3.0, 1.0, 0.0, 1.0, 4.0],)], "v array<double>")
    m = A.load(F.col("v"), (3, 3))
    out = row.select(A.save(A.matmul(m, A.inverse(m))).alias("x")).first()["x"]
    assert out == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1])


def test_division_follows_ieee(spark):
    row = spark.range(1).select(A.ratio(1.0, 0.0).alias("a"), A.ratio(0.0, 0.0).alias("b"), A.logarithm(0.0).alias("c"), A.Dual(F.lit(0.0)).abs().du.alias("d")).first()
    assert row["a"] == math.inf and math.isnan(row["b"]) and row["c"] == -math.inf and math.isnan(row["d"])


def test_patterns():
    assert len(stencils.staple(4).points) == 32
    for a in range(4):
        for b in range(4):
            for sa in (1, -1):
                for sb in (1, -1):
                    if a != b:
                        want = tuple(sa * (k == a) + sb * (k == b) for k in range(4))
                        assert stencils.staple(4).points[stencils.corner_point(4, a, sa, b, sb)] == want
    assert stencils.path(stencils.plaquette(3, 0, 2)).points[-1] == (0, 0, 0)


def test_even_odd(spark):
    lat = Lattice((3, 4, 5))
    n = lat.sites(spark).select(lat.even_odd_index(F.col("site")).alias("k")).distinct().count()
    assert n == lat.volume
    with pytest.raises(ValueError):
        Lattice((3, 3)).even_odd_index(F.col("site"))


def test_seed(spark):
    high, low = seeds.site_seed(12345, [F.lit(0)] * 4)
    row = spark.range(1).select(high.alias("h"), low.alias("l")).first()
    assert row["h"] << 32 | row["l"] == 0x62EDDD4535EEF24C


def test_put_and_check(spark):
    f = index_field(spark)
    f.check()
    new = f.put(f.patch((0, 0, 0), (0, 0, 1)).select("site", F.lit(-1.0).alias("v")))
    assert sorted(k for k, v in values(new).items() if v == -1) == [0, 1]
