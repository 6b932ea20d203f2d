"""Registered queries of the operators against their SQL twins, and the shape of the others' results."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
COLUMNS = {
    3: "doc_id n_bytes n_tokens over_limit",
    5: "doc_id piece start length ids_crc32 sequence_id offset",
    6: "doc_id n_bytes n_removed n_spans kept_sha256",
    8: "query_id rank vec_id score",
    9: "doc_id n_shingles component_id kept",
    10: "doc_id held_out score predicted",
    12: "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("n", [1, 2, 4, 11, 13])
def test_query_matches_sql(spark, n):
    key = next(k for k in entry.queries() if k.startswith(f"op{n}_"))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[key](spark, FOLDER)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[key])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns) and got == rows_of(cols, cur.fetchall())


@pytest.mark.parametrize("n", COLUMNS)
def test_query_has_its_columns(spark, n):
    keys = [k for k in entry.queries() if k.startswith(f"op{n}_")]
    assert len(keys) == 1 and set(COLUMNS[n].split()) <= set(entry.queries()[keys[0]](spark, FOLDER).columns)
