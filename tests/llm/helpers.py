"""Small tables with the awkward cases, and the comparison of a query with its SQL."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "documents labels conversations pages benchmark embeddings".split()


def odd_documents(spark, rows):
    """A documents table with extra columns whose names clash with those that operators use."""
    kind = "doc_id long, text string, kept boolean, id string, n long, local long, row string, `class` string, n_words long"
    return spark.createDataFrame([(*r, None, "x", 3, None, "y", "z", 9) for r in rows], kind)


def sql_rows(query, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    rel = con.sql(query)
    return rel.columns, rel.fetchall()


def same_as_sql(df, query, sf_dir=SF):
    columns, expected = sql_rows(query, sf_dir)
    assert sorted(columns) == sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(expected, key=key)
