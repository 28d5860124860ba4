"""The registered queries give rows, each with the columns of its SQL's."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["records_lines", "records_quoted", "edit_texts", "program_entry", "stream_word_count", "print_redirect", "ranks"])
def test_registered(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in "region nation customer orders documents".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda some, names: sorted(str([r[names.index(c)] for c in sorted(names)]) for r in some)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)
