"""Queries and their helpers keep names of their own."""

import ast
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
WORKLOADS = sorted((Path(entry.__file__).parent / "workloads").glob("*.py"))


@pytest.mark.parametrize("path", WORKLOADS, ids=lambda p: p.stem)
def test_no_function_replaces_another(path):
    names = Counter(n.name for n in ast.parse(path.read_text()).body if isinstance(n, ast.FunctionDef))
    assert [n for n, k in names.items() if k > 1] == []


@pytest.mark.parametrize("name", ["agg27_score_by_count", "cv2_common_counts", "top3_best_count"])
def test_scores_by_count_equal_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view customer as select * from '{SMALL}/customer.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = entry.queries()[name](spark, SMALL).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())
