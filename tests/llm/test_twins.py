"""The newest operators' queries against their twins in SQL, on the smallest tables and on odd ones."""

import duckdb
import pytest

from framewise.llm import queries

NAMES = ["op11_conversation_repair", "op12_merkle_manifest"]


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet{'' if folder.startswith('/root') else '/*.parquet'}'")
    found, told = queries.QUERIES[name](spark, folder), con.sql(queries.ORACLES[name])
    at = [told.columns.index(c) for c in found.columns]
    assert sorted(found.columns) == sorted(told.columns)
    return sorted(map(str, map(tuple, found.collect()))), sorted(str(tuple(r[i] for i in at)) for r in told.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, data, name):
    found, told = compared(spark, data, name)
    assert found == told and found


def test_same_rows_as_sql_on_odd_tables(spark, tmp_path):
    turns = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "Be brief."), ("user", "a?"), ("assistant", "cut"), ("assistant", "One. "), ("user", None), (None, "x.")][c % 3 : 2 + c % 5])]
    spark.createDataFrame([*turns, (7, None, "user", "a?"), (None, 1, "user", "Hm.")], "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = [(i, f"s{i % 3}" if i % 7 else None, "en" if i % 5 else None, i, f"Text É {i}" if i % 11 else None) for i in range(90)] + [(900, "alone", "en", 1, "A")]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    for name in NAMES:
        found, told = compared(spark, str(tmp_path), name)
        assert found == told
