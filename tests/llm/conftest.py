import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

from odd_rows import CLASH, ODD  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows as a stored table with extra columns of clashing names."""
    path = str(tmp_path_factory.mktemp("odd") / "documents")
    rows = [(i, t, la, s, None if t is None else len(t), *["x"] * len(CLASH)) for i, t, la, s in ODD]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASH)
    spark.createDataFrame(rows, schema).repartition(3, "doc_id").write.parquet(path)
    return path


@pytest.fixture(scope="session")
def nothing(spark, odd, tmp_path_factory):
    """The same columns without a row."""
    path = str(tmp_path_factory.mktemp("nothing") / "documents")
    spark.read.parquet(odd).limit(0).write.parquet(path)
    return path
