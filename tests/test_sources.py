"""Files, lane layouts, larger matrices, site functions and timers."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.functions import lanes, siteops
from gridfield.lattice import Lattice
from gridfield.operators import dense
from gridfield.operators.gauge import Gauge
from gridfield.plans.profile import Profiler
from gridfield.sources import lime, scidac

LAT = Lattice((2, 3, 4, 5))


def ramp(spark, lat=LAT):
    return Field(lat, lat.sites(spark).select("site", (F.col("site") * 0.1).alias("v")))


def test_records_of_odd_lengths(spark, tmp_path):
    path = str(tmp_path / "a.lime")
    said = [(b"hello", "text", True, False), (b"", "empty", False, True), (bytes(range(17)), "bytes", True, True)]
    lime.write(spark, path, [(lime.Record(t, len(d), b, e), [d]) for d, t, b, e in said])
    assert os.path.getsize(path) == 3 * 144 + 8 + 0 + 24
    rows = lime.records(spark, path).orderBy("number").collect()
    assert [(bytes(r["data"]), r["type"], r["begins"], r["ends"]) for r in rows] == said
    assert [r["length"] for r in lime.contents(spark, path).collect()] == [5, 0, 17]
    blob = open(path, "rb").read()
    assert int.from_bytes(blob[:4]) == 0x456789AB and blob[4:8] == b"\x00\x01\x80\x00" and blob[8:16] == (5).to_bytes(8)


def test_damaged_files(tmp_path):
    good = lime.Record("x", 9).header() + bytes(16)
    assert len(list(lime.scan(good))) == 1 and not list(lime.scan(b""))
    for bad in (good[:100], good[:150], b"\0" + good[1:]):
        with pytest.raises(ValueError):
            list(lime.scan(bad))


def test_wrong_length_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        lime.write(spark, str(tmp_path / "b.lime"), [(lime.Record("x", 4), [b"abc"])])


def test_field_file(spark, tmp_path):
    path = str(tmp_path / "f.lime")
    scidac.write_field(ramp(spark), path)
    assert scidac.read_info(spark, path).dims == LAT.dims
    got = {r["site"]: r["v"] for r in scidac.read_field(spark, path).df.collect()}
    assert got == {k: k * 0.1 for k in range(LAT.volume)}
    (record,) = [r for r in lime.records(spark, path).collect() if r["type"] == scidac.BINARY]
    data = np.frombuffer(record["data"], ">f8")
    assert data[1] == LAT.site_of((1, 0, 0, 0)) * 0.1  # the first coordinate runs fastest
    blob = bytearray(open(path, "rb").read())
    blob[blob.index(record["data"]) + 3] ^= 1
    open(path, "wb").write(blob)
    (tmp_path / ".f.lime.crc").unlink()
    with pytest.raises(ValueError):
        scidac.read_field(spark, path)
    assert scidac.read_field(spark, path, verify=False).df.count() == LAT.volume
    with pytest.raises(ValueError):
        scidac.read_field(spark, path, index=1)
    with pytest.raises(ValueError):
        scidac.read_field(spark, path, (3,))


def test_links_file(spark, tmp_path):
    path = str(tmp_path / "u.lime")
    scidac.write_links(Gauge.unit(spark, LAT, 3), path, precision=32, lfn="lfn://none")
    g = scidac.read_links(spark, path)
    assert g.lattice.dims == LAT.dims and g.link_trace().first()[0] == 1.0
    assert [r["type"] for r in lime.contents(spark, path).collect()] == [scidac.ILDG_FORMAT, scidac.ILDG_BINARY, scidac.CHECKSUM, scidac.ILDG_LFN]


def test_metadata_round_trip():
    info = scidac.FileInfo(dims=(4, 4, 4, 8))
    assert scidac.FileInfo.parse(info.xml()) == info
    assert scidac.ChecksumInfo.parse(scidac.ChecksumInfo(suma="00ff", sumb="1").xml()).sums() == (255, 1)
    assert scidac.RecordInfo.parse("<scidacRecord><precision>F</precision></scidacRecord>").precision == "F"


def test_lane_grid():
    assert lanes.lane_grid((8, 8, 8, 16), 8) == (1, 2, 2, 2)
    assert lanes.lane_grid((8, 8, 8, 16), 8, (1, 1, 1, -1)) == (1, 1, 1, 8)
    with pytest.raises(ValueError):
        lanes.lane_grid((3, 3), 8)
    with pytest.raises(ValueError):
        lanes.lane_grid((8, 8), 8, (3, 1))


def test_lanes_are_a_bijection(spark):
    layout = lanes.LaneLayout(Lattice((4, 6, 8)), (2, 1, 4))
    group, lane = layout.place(F.col("site"))
    rows = layout.lattice.sites(spark).select("site", group.alias("g"), lane.alias("l"))
    assert rows.select("g", "l").distinct().count() == 192
    assert rows.where(layout.site(F.col("g"), F.col("l")) != F.col("site")).count() == 0
    assert layout.ghost_groups((1, 0, 1)) == 2 * 12 + 2 * 12


def test_large_matrices(spark):
    rng = np.random.default_rng(5)
    ms = rng.normal(size=(4, 5, 5)) + 1j * rng.normal(size=(4, 5, 5))
    rows = [(k, [(float(z.real), float(z.imag)) for z in m.ravel()]) for k, m in enumerate(ms)] + [(4, None)]
    f = Field(Lattice((5,)), spark.createDataFrame(rows, "site long, v array<struct<re: double, im: double>>"), (5, 5), True)
    det = {r["site"]: r["v"] for r in dense.determinant(f).df.collect()}
    assert det[4] is None and all(complex(*det[k]) == pytest.approx(np.linalg.det(ms[k])) for k in range(4))
    inv = {r["site"]: r["v"] for r in dense.inverse(f).df.collect()}
    assert inv[4] is None and np.allclose(np.array([complex(*z) for z in inv[0]]).reshape(5, 5) @ ms[0], np.eye(5))


def test_singular(spark):
    f = Field(Lattice((2,)), spark.createDataFrame([(0, [1.0, 2.0, 2.0, 4.0]), (1, [2.0, 0.0, 0.0, 4.0])], "site long, v array<double>"), (2, 2))
    inv = {r["site"]: r["v"] for r in dense.inverse(f).df.collect()}
    assert all(np.isnan(inv[0])) and inv[1] == [0.5, 0.0, 0.0, 0.25]


def test_site_functions():
    with pytest.raises(ValueError):
        siteops.define("five", 5, lambda a, b, c, d, e: a)
    with pytest.raises(ValueError):
        siteops.define("two", 2, lambda a: a)


def test_profiler():
    p = Profiler()
    with p.timed("outer"):
        with p.timed("inner", 198, 10):
            pass
    assert p.events["outer"].flops == p.events["inner"].flops == 1980 and p.events["outer"].seconds >= p.events["inner"].seconds
    assert {r[0] for r in p.report()} == {"outer", "inner"}


def test_pieces_through_the_driver(spark):
    """A field of 30 MB comes in several pieces, in order."""
    rows = spark.range(300).select(F.col("id").alias("site"), F.repeat(F.char(65 + F.col("id") % 26), 100_000).cast("binary").alias("data"))
    sizes, last = [], b""
    for piece in scidac._ordered(rows, 30_000_000):
        sizes.append(len(piece))
        last += piece[::100_000]
    assert sum(sizes) == 30_000_000 and max(sizes) < 2 * scidac.PIECE
    assert last == bytes(65 + k % 26 for k in range(300))
