"""Every registered operator query, and the SQL of those that have one."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from skyledger.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = entry_module.queries()[name](spark, SF)
    rows = got.collect()
    if int(name[2:].split("_")[0]) <= 11:
        assert len(rows) == spark.read.parquet(f"{SF}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()
    assert rows
    if name in ORACLE:
        con = duckdb.connect()
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
        relation = con.execute(ORACLE[name])
        names = [d[0] for d in relation.description]
        assert sorted(names) == sorted(got.columns)
        want = sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in relation.fetchall())
        assert sorted(tuple(r[c] for c in sorted(names)) for r in rows) == want
