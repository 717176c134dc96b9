import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cytolake.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def mask100(spark):
    """100 x 100 mask of one slide, rows and columns 20..79 set."""
    return spark.sql(
        "select 's' as slide_id, r as row, c as col, if(r between 20 and 79 and c between 20 and 79, 255, 0) as value"
        " from (select explode(sequence(0, 99)) as r) lateral view explode(sequence(0, 99)) as c"
    )


@pytest.fixture(scope="session")
def cells7(spark):
    """Seven square cells: class 1 three times, class 2 twice, class 3 twice outside the mask."""
    spots = [(40, 20, 2, 1), (50, 21, 3, 1), (60, 20, 4, 1), (30, 50, 2, 2), (70, 50, 2, 2), (5, 5, 2, 3), (9, 9, 3, 3)]
    rows = []
    for i, (x, y, h, t) in enumerate(spots):
        ring = [[x - h, y - h], [x + h, y - h], [x + h, y + h], [x - h, y + h]]
        rows.append(("s", i, str(i), float(x), float(y), t, [[float(a), float(b)] for a, b in ring]))
    schema = "slide_id string, cell_ord bigint, cell_id string, cx double, cy double, cell_type int, contour array<array<double>>"
    return spark.createDataFrame(rows, schema)
