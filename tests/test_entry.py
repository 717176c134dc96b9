import math

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CHECKED = ["agg3_inside_counts", "win3_border_band_even", "jn4_nearest_exact", "agg18_class_panoptic_quality", "fs2_mann_whitney"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["slide_id", "cell_type", "class_name"] and df.count() == 50


def test_sql_names_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "part", "embeddings"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, SMALL).select(*columns).collect()]
    clean = lambda rows: sorted(
        (tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=repr
    )
    assert clean(got) == clean(want)
