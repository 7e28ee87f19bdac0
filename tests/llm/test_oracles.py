"""Queries against their SQL, on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

from gridfield.llm import queries

SF = "/root/testdata/sf0.001"


def rows_of(relation_columns, rows, columns):
    return sorted((tuple(dict(zip(relation_columns, r, strict=True))[c] for c in columns) for r in rows), key=str)


def compare(spark, name, folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        glob = f"{folder}/{f}/*.parquet" if os.path.isdir(f"{folder}/{f}") else f"{folder}/{f}"
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{glob}'")
    relation, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    assert columns == sorted(relation.columns)
    assert rows_of(got.columns, map(tuple, got.collect()), columns) == rows_of(relation.columns, relation.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    compare(spark, name, SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql_on_odd_rows(spark, name, tmp_path):
    """Nulls, blank texts, copies; enough good labels that cutoffs are certified, and documents over them."""
    words = [f"w{k}" for k in range(90)]
    rows = [(i, " ".join(words[i % 7 :] + [f"d{i}"] * (i % 2)) + " CC  by, MIT\tLicense", None if i % 3 else "en", "a", 1) for i in range(1600)]
    rows += [(1600, None, "en", "a", 0), (1601, " \n ", None, None, 3), (1602, "*** " * 40 + " ".join(words), "en", "a", 1), (1603, "A! " * 60 + "\n" + " ".join(words), None, "a", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None if i % 50 == 0 else 1, 0) for i in range(1600)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    compare(spark, name, str(tmp_path))
    if name == "op10_risk_controlled_quality":
        out = {r["doc_id"]: r for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert not out[1603]["base_failed"] and not out[1603]["kept"] and out[5]["kept"]
