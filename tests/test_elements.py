"""Laws of duals, elements, files by ranges, and what is refused."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import algebra as A
from gridfield.functions import lanes
from gridfield.lattice import Lattice
from gridfield.operators import gauge, stencils
from gridfield.operators.gauge import Gauge
from gridfield.sources import lime, scidac

LAT = Lattice((2, 3, 4, 5))


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def value(row, name):
    x = row[name]
    return complex(x["re"], x["im"]) if hasattr(x, "im") or (hasattr(x, "asDict") and "im" in x.asDict()) else x


@pytest.mark.parametrize("name", [*A.ELEMENTARY, "pow"])
def test_derivatives_of_complex_duals(spark, name):
    """Against central differences."""
    w, u, h = 0.7 - 0.4j, 0.3 + 1.1j, 1e-6
    dual = A.Dual(A.Complex(w.real, w.imag), A.Complex(u.real, u.imag))
    f = lambda z: A.call(name, z) if name != "pow" else z.pow(1.7)
    at = lambda z: f(A.Complex(z.real, z.imag)).column()
    got = dual.pow(1.7) if name == "pow" else getattr(dual, name)()
    row = one(spark, re=got.re.column(), du=got.du.column(), here=at(w), up=at(w + h * u), down=at(w - h * u))
    z = {n: value(row, n) for n in ("re", "du", "here", "up", "down")}
    assert z["re"] == pytest.approx(z["here"]) and z["du"] == pytest.approx((z["up"] - z["down"]) / (2 * h), rel=1e-6)
    import cmath

    assert z["here"] == pytest.approx(w**1.7 if name == "pow" else getattr(cmath, "log" if name == "ln" else name)(w))


@pytest.mark.parametrize("name", [*A.ELEMENTARY, "pow", "abs"])
def test_derivatives_of_real_duals(spark, name):
    w, h = 0.8, 1e-6
    f = lambda x: A.call(name, x) if name in A.ELEMENTARY else (A.power(x, 2.5) if name == "pow" else F.abs(F.lit(x)))
    x = A.Dual(w, 3.0)
    got = x.pow(2.5) if name == "pow" else getattr(x, name)()
    row = one(spark, re=got.re, du=got.du, here=f(w), up=f(w + h), down=f(w - h))
    assert row["re"] == pytest.approx(row["here"]) and row["du"] == pytest.approx(3 * (row["up"] - row["down"]) / (2 * h), rel=1e-6)


def test_dual_arithmetic(spark):
    """Laws over both kinds: quotients undo products, scalars act as duals without derivative, conjugates."""
    for a, b, s in ((A.Dual(2.0, 3.0), A.Dual(4.0, -5.0), 2.5), (A.Dual(A.Complex(1.0, 2.0), A.Complex(0.5, -1.0)), A.Dual(A.Complex(-3.0, 1.0), A.Complex(2.0, 2.0)), A.Complex(0.0, 2.0))):
        sum_abs = lambda d: sum((p.abs() if isinstance(p, A.Complex) else F.abs(p)) for p in (d.re, d.du))
        near = lambda x, y: sum_abs(x - y) < 1e-12  # noqa: E731, B023
        d = A.Dual.of(s)
        laws = {"quotient": near(a * b / b, a), "left": near(s * a, d * a), "minus": near(s - a, -(a - s)), "over": near(a / s, a / d), "plus": near(s + a, a + d), "conj": a.conjugate().conjugate() == a, "adj": near(a.adj(), a.dual_conjugate().conjugate()), "norm": near(a.norm2(), a * a.conjugate()), "differs": ~(a == b)}
        assert all(one(spark, **laws).asDict().values())
    assert A.is_dual(A.Dual(1.0)) and A.is_real_dual(A.Dual(1.0)) and A.is_complex_dual(A.Dual(A.Complex(1.0))) and not A.is_dual(1.0)
    row = one(spark, t=A.Dual(2.0, -1.0).text(), z=A.Dual(A.Complex(1.0, 2.0)).text())
    assert row["t"] == "(2.0 + -1.0ε)" and row["z"] == "((1.0, 2.0) + (1.0, 0.0)ε)"
    stored = spark.range(1).select(A.Dual(A.Complex(1.0, 2.0), A.Complex(3.0)).column().alias("d")).select((A.Dual.stored(F.col("d"), True) * 2.0).column().alias("x")).first()["x"]
    assert (stored["re"]["im"], stored["du"]["re"]) == (4.0, 6.0)
    with pytest.raises(ValueError):
        A.Dual(A.Complex(1.0)).abs()


def ramp(spark, lat=LAT):
    return Field(lat, lat.sites(spark).select("site", (F.col("site") * 0.1).alias("v")))


def test_refusals(spark):
    f, v = ramp(spark), Field.filled(spark, LAT, (3,), 1.0)
    for bad in (lambda: v.element(3), lambda: v.element(0, 0), lambda: f.site(10**6)):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: v.squeeze(), lambda: v.assign(f), lambda: f.to_complex().compare("<", 1.0), lambda: f.call("gamma"), lambda: Lattice((3, 4), (2, 1)).processes(), lambda: Gauge.of_fields([f])):
        with pytest.raises(ValueError):
            bad()
    assert f.site(7) == pytest.approx(0.7)


def test_mixed_expressions(spark):
    f = ramp(spark)
    out = {r["site"]: r["v"] for r in (2.0 * f * f + f / 2.0 - 1.0).df.collect()}
    assert all(out[k] == pytest.approx(2 * (k * 0.1) ** 2 + k * 0.05 - 1) for k in range(LAT.volume))
    z = (f + A.Complex(0.0, 1.0)) if f.complex else f.to_complex() + A.Complex(0.0, 1.0)
    assert {r["site"]: r["v"]["im"] for r in z.df.collect()} == dict.fromkeys(range(LAT.volume), 1.0)
    assert {r["v"] for r in z.im().df.collect()} == {1.0}


def test_parts_are_a_bijection(spark):
    lat = Lattice((4, 6, 8), (2, 3, 1))
    rows = lat.sites(spark).select("site", lat.process_of(F.col("site")).alias("p"), lat.local_index(F.col("site")).alias("k"))
    assert rows.groupBy("p").count().where("count <> 32").count() == 0 and rows.select("p", "k").distinct().count() == 192
    assert lat.bounds(5) == ((2, 4, 0), (3, 5, 7)) and lat.part().dims == (2, 2, 8)
    wide = lat.padded((1, 0, 2))
    back = wide.sites(spark).select("site", wide.unpadded(wide.padded_index([F.col(f"x{d}") for d in range(3)])).alias("back"))
    assert back.where("site <> back or back is null").count() == 0


def test_sites_beyond_doubles(spark):
    """Coordinates are taken in integers."""
    lat, n = Lattice((2**31, 2**31)), 2**61 + 2**30 + 1
    row = spark.range(1).select(lat.coordinate(F.lit(n).cast("long"), 0).alias("a"), lat.coordinate(F.lit(n).cast("long"), 1).alias("b")).first()
    assert (row["a"], row["b"]) == (n // 2**31, n % 2**31)


def test_shift_sets(spark):
    out = stencils.shift_sets(spark, Lattice((4, 4)), 0, 1)
    assert out.where("not local").count() == 4 and out.where("sent").count() == 4 and out.count() == 16
    out = stencils.shift_sets(spark, Lattice((4, 4, 4, 8)), 2, 1)
    assert out.where("not local").count() == 128 and out.where("sent").count() == 128


def su2(spark, lat, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for site in range(lat.volume):
        u = []
        for _ in range(lat.rank):
            a = rng.normal(size=4)
            a /= np.linalg.norm(a)
            m = np.array([[a[0] + 1j * a[3], a[2] + 1j * a[1]], [-a[2] + 1j * a[1], a[0] - 1j * a[3]]])
            u.append(m)
        rows.append((site, u))
    df = spark.createDataFrame([(s, [[(float(z.real), float(z.imag)) for z in m.ravel()] for m in u]) for s, u in rows], "site long, u array<array<struct<re: double, im: double>>>")
    return Gauge(lat, df, 2), {s: u for s, u in rows}


def test_observables_by_loops(spark):
    """Plaquette and action of random links, site by site in numpy."""
    lat = Lattice((2, 3, 2))
    g, u = su2(spark, lat)
    at = lambda x, *steps: lat.site_of([c + sum(s for d, s in steps if d == k) for k, c in enumerate(x)])
    plaquettes, action, cr = [], 0.0, -0.05
    for site in range(lat.volume):
        x = lat.coords_of(site)
        for m in range(3):
            for n in range(m):
                link = lambda d, *steps: u[at(x, *steps)][d]  # noqa: B023, E731
                ta, tb = link(m) @ link(n, (m, 1)), link(n) @ link(m, (n, 1))
                p = np.trace(ta @ tb.conj().T).real
                plaquettes.append(p)
                halves = ((ta @ link(m, (n, 1)).conj().T, link(m, (m, -1)).conj().T @ link(n, (m, -1)) @ link(m, (m, -1), (n, 1))), (tb @ link(n, (m, 1)).conj().T, link(n, (n, -1)).conj().T @ link(m, (n, -1)) @ link(n, (n, -1), (m, 1))))
                action += 2 - p + cr * (4 - sum(np.trace(a @ b.conj().T).real for a, b in halves))
    assert g.plaquette().first()[0] == pytest.approx(np.mean(plaquettes) / 2)
    assert g.action(7.5, 1.0, cr).first()[0] == pytest.approx(7.5 / 2 * action)
    assert Gauge.unit(spark, lat, 3).action(7.5, 1.0, cr).first()[0] == pytest.approx(0, abs=1e-9)


def test_transport_there_and_back(spark):
    lat = Lattice((3, 4))
    g, _ = su2(spark, lat)
    m = Field(lat, lat.sites(spark).select("site", F.array(*(F.struct((F.col("site") + k).cast("double").alias("re"), F.lit(1.0).alias("im")) for k in range(4))).alias("v")), (2, 2), True)
    for d in range(2):
        for first in (1, -1):
            back = g.transport(g.transport(m, d, first), d, -first)
            off = (back - m).norm2().sum().first()[0]
            assert off < 1e-20
    plain = Gauge(lat, g.df, 2, "none")  # links inverted by determinant
    assert (g.transport(m, 0, -1) - plain.transport(m, 0, -1)).norm2().sum().first()[0] < 1e-20


def test_ranges_and_validation(spark, tmp_path):
    g, _ = su2(spark, LAT)
    path = str(tmp_path / "g.lime")
    scidac.write_gauge(g, path, extra="<note>hi</note>")
    file = scidac.File(spark, path)
    number = file.nth(scidac.BINARY, 0)
    data = file.sites(number, 8, 32, LAT, block=256 * 7)
    assert data.rdd.getNumPartitions() == -(-LAT.volume // 7) and data.count() == LAT.volume
    told = {r["quantity"]: r for r in scidac.check_links(spark, path).collect()}
    assert told["plaquette"]["agrees"] and told["linkTrace"]["agrees"]
    assert scidac.stored_value(scidac.read_user(spark, path)[1], "note") is None and scidac.stored_value("no xml", "a") is None
    other = Gauge.unit(spark, LAT, 2)
    assert [r["agrees"] for r in scidac.check_links(spark, path, other).collect()] == [False, False]
    assert scidac.read_gauge(spark, path).link_trace().first()[0] == pytest.approx(g.link_trace().first()[0])
    plain = str(tmp_path / "f.lime")
    scidac.write_field(Field.filled(spark, LAT, (4, 2, 2), 1.0, True), plain)
    assert scidac.metadata(spark, plain).first()["bytes"] == LAT.volume * 4 * 4 * 16
    with pytest.raises(ValueError):
        scidac.File(spark, plain).nth(scidac.ILDG_BINARY, 0)


def test_another_store_is_read_by_one_task(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f.lime")
    scidac.write_field(ramp(spark), path)
    monkeypatch.setattr(lime, "_opens", lambda p: False)
    got = {r["site"]: r["v"] for r in scidac.read_field(spark, path, block=64).df.collect()}
    assert got == {k: k * 0.1 for k in range(LAT.volume)}


def test_damaged_file(spark, tmp_path):
    path = tmp_path / "d.lime"
    good = lime.Record("x", 9).header() + bytes(16)
    for bad in (good[:100], good[:150], b"\0" + good[1:]):
        path.write_bytes(bad)
        with pytest.raises(ValueError):
            lime.headers(spark, str(path))
    path.write_bytes(good)
    assert [(h.type, h.length) for h in lime.headers(spark, str(path))] == [("x", 9)]
    path.write_bytes(b"")
    assert lime.headers(spark, str(path)) == []


def test_lane_grids():
    assert lanes.lane_grid((6, 4), 6) == (3, 2) and lanes.lane_grid((4, 6, 8), 1) == (1, 1, 1)
    with pytest.raises(ValueError):
        lanes.lane_grid((8, 8), 3)


def test_operation_counts():
    assert (gauge.matmul_flops(3), gauge.add_flops(3), gauge.trace_flops(3), gauge.adjoint_flops(3)) == (198, 18, 4, 9)


def test_draws(spark):
    from gridfield.functions import seeds

    h, low = seeds.site_seed(5, [F.col("id"), F.col("id") + 1])
    rows = spark.range(20_000).select(seeds.uniform(h, low).alias("u"), seeds.uniform(h, low, 1, -2.0, 4.0).alias("w"), seeds.gaussian(h, low).alias("g"))
    m = rows.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("w"), F.avg("g"), F.stddev("g"), F.corr("u", "w")).first()
    assert abs(m[0] - 0.5) < 0.01 and 0 <= m[1] < 0.001 and 0.999 < m[2] < 1 and abs(m[3] - 1) < 0.06 and abs(m[4]) < 0.03 and abs(m[5] - 1) < 0.03 and abs(m[6]) < 0.03 and not math.isnan(m[5])
