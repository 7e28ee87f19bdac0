"""Tables whose rows fill no whole number of planes: the rows past the grid are its tail."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from gridfield.field import Field
from gridfield.lattice import Lattice
from gridfield.plans import catalog
from gridfield.sources import lime, scidac

SF = "/root/testdata/sf0.001"
#: Rows of embeddings: a tail in one row along the last dimension, one over several of them, one that also has planes of its own.
ROWS = (404, 437, 199)


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """A folder with all tables and a connection that sees them, by number of rows."""
    out = {}
    for n in ROWS:
        folder, con = tmp_path_factory.mktemp(f"rows{n}"), duckdb.connect()
        for f in os.listdir(SF):
            if f == "embeddings.parquet":
                con.sql(f"COPY (SELECT * FROM '{SF}/{f}' WHERE vec_id < {n}) TO '{folder}/{f}' (FORMAT parquet)")
            else:
                shutil.copy(f"{SF}/{f}", folder / f)
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
        out[n] = str(folder), con
    return out


def same(spark, tables, name):
    for folder, con in tables.values():
        df = catalog.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        relation = con.sql(catalog.ORACLES[name])
        assert columns == sorted(relation.columns)
        want = sorted((tuple(dict(zip(relation.columns, r, strict=True))[c] for c in columns) for r in relation.fetchall()), key=str)
        assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == want


def test_file_of_a_field_with_a_tail(spark, tmp_path):
    path, plain, lat = str(tmp_path / "t.lime"), str(tmp_path / "p.lime"), Lattice((2, 3, 4, 5), tail=7)
    field = Field(lat, lat.sites(spark).select("site", (F.col("site") * 0.1).alias("v")))
    scidac.write_field(field, path)
    back = scidac.read_field(spark, path, block=64)
    back.check()
    assert back.lattice == lat and {r["site"]: r["v"] for r in back.df.collect()} == {k: k * 0.1 for k in range(127)}
    scidac.write_field(Field.filled(spark, Lattice((2, 3)), value=1.0), plain)
    assert "tail" in scidac.FileInfo(tail=1).xml() and "tail" not in lime.content(spark, plain, lime.headers(spark, plain)[0]).decode()


def test_scidac_matrix_round_trip(spark, tables):
    same(spark, tables, "scidac_matrix_round_trip")


def test_propagator_round_trip(spark, tables):
    same(spark, tables, "propagator_round_trip")


def test_ildg_link_trace(spark, tables):
    same(spark, tables, "ildg_link_trace")
    same(spark, tables, "link_trace")


def test_lime_records(spark, tables):
    same(spark, tables, "lime_records")


def test_field_text(spark, tables):
    same(spark, tables, "field_text")


def test_moves_of_a_tail(spark):
    """Along the first direction sites of the tail come into the grid, where values add up; along others they stay past it."""
    lat = Lattice((2, 3), tail=2)
    f = Field(lat, lat.sites(spark).select("site", F.col("site").cast("double").alias("v")))
    told = lambda g: sorted((r["site"], r["v"]) for r in g.df.collect())
    assert told(f.shift((1, 0))) == [(0, 3.0), (1, 4.0), (2, 5.0), (3, 0.0), (3, 6.0), (4, 1.0), (4, 7.0), (5, 2.0)]
    assert told(f.shift((1, 0)).merged()) == [(0, 3.0), (1, 4.0), (2, 5.0), (3, 6.0), (4, 8.0), (5, 2.0)]
    assert told(f.shift((0, 1))) == [(0, 1.0), (1, 2.0), (2, 0.0), (3, 4.0), (4, 5.0), (5, 3.0), (6, 7.0), (8, 6.0)]
    z = Field(lat, f.df.select("site", F.array(F.struct(F.col("v").alias("re"), F.lit(1.0).alias("im"))).alias("v")), (1,), True)
    assert [tuple(r["v"][0]) for r in z.shift((1, 0)).merged().df.orderBy("site").collect()] == [(3.0, 1.0), (4.0, 1.0), (5.0, 1.0), (6.0, 2.0), (8.0, 2.0), (2.0, 1.0)]


def test_covariant_derivative(spark, tables):
    same(spark, tables, "covariant_derivative")


def test_covariant_shift(spark, tables):
    same(spark, tables, "covariant_shift")


def test_covariant_shift_backward(spark, tables):
    same(spark, tables, "covariant_shift_backward")


def test_transport_matrix(spark, tables):
    same(spark, tables, "transport_matrix")


def test_transport_matrix_backward(spark, tables):
    same(spark, tables, "transport_matrix_backward")


def test_wilson_action(spark, tables):
    same(spark, tables, "wilson_action")


def test_gauge_file_check(spark, tables):
    same(spark, tables, "gauge_file_check")


def test_scidac_metadata(spark, tables):
    same(spark, tables, "scidac_metadata")
