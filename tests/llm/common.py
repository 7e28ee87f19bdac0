"""Small tables for the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """doc_id and text of a table with the columns of documents."""
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], SCHEMA)


def write_tables(spark, folder, **tables):
    for name, df in tables.items():
        df.coalesce(2).write.parquet(f"{folder}/{name}.parquet")
