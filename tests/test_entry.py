"""Registered queries against their SQL, on the smallest tables and on a text longer than any of them."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """The smallest tables; of the documents the first 40, and one more of over 25,000 letters, some of them not ASCII."""
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("tables are not here")
    top = str(tmp_path_factory.mktemp("sf"))
    con = duckdb.connect()
    for t in TABLES:
        more = ""
        if t == "documents":
            word = "substr(md5(i::varchar), 1, 1 + i % 9) || chr(CAST(97 + i % 26 AS INTEGER)) || CASE WHEN i % 50 = 0 THEN 'é' ELSE '' END"
            text = f"(SELECT string_agg({word}, ' ' ORDER BY i) FROM range(11000) AS r(i))"
            more = f" UNION ALL SELECT * REPLACE ((SELECT max(doc_id) + 1 FROM '{SF}/{t}.parquet') AS doc_id, {text} AS text, length({text})::INTEGER AS n_chars) FROM (SELECT * FROM '{SF}/{t}.parquet' LIMIT 1)"
        cut = " WHERE doc_id < 40" if t == "documents" else ""
        con.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet'{cut}{more}) TO '{top}/{t}.parquet'")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{top}/{t}.parquet'")
    assert con.sql("SELECT max(length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))) FROM documents").fetchall()[0][0] > 25_000
    return top, con


def rows(df, cols):
    show = lambda v: "" if v is None or v is pd.NA or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    # a column of whole numbers with nulls is one of floats in one of the two engines
    plain = [df[c].astype("float64") if pd.api.types.is_numeric_dtype(df[c]) and df[c].isna().any() else df[c] for c in cols]
    return sorted(tuple(show(v) for v in r) for r in zip(*plain, strict=True))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, tables, name):
    top, con = tables
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, top).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() == 5
