"""Pixels are made by as many tasks as their number asks for."""

import pytest
from pyspark.sql import functions as F

from cytolake.operators.segmentation import class_at_centroid, confusion_matrix, stack_layers
from cytolake.runtime import apply_session_rules
from workloads import inputs as I

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("view, key", [(I.raw_mask, "slide_id"), (I.tile_pixels, "tile_id")])
def test_tasks_follow_the_pixels(spark, monkeypatch, view, key):
    least = spark.sparkContext.defaultParallelism
    few = view(spark, SMALL)
    assert few.rdd.getNumPartitions() == least
    pixels = few.count()
    monkeypatch.setattr(I, "TASK_PIXELS", -(-pixels // (3 * least)))
    many = view(spark, SMALL)
    assert 3 * least - 1 <= many.rdd.getNumPartitions() <= 3 * least
    assert many.exceptAll(few).isEmpty() and few.exceptAll(many).isEmpty()
    # a key's pixels stay in one task, so counting them needs no further shuffle
    plan = many.groupBy(key, "row").agg(F.count("*"))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_layers_of_dealt_tiles_are_joined_where_they_are(spark):
    at = ["tile_id", "row", "col"]
    px = I.tile_pixels(spark, SMALL)
    layers = [px.select(*at, F.col(c).alias(n)) for c, n in (("row", "r"), ("true_inst", "inst"), ("true_class", "type"))]
    apply_session_rules(spark)
    expected = layers[0].join(layers[1], at).join(layers[2], at)
    assert expected._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("Exchange hashpartitioning(tile_id") > 3
    try:
        stacked = stack_layers(*layers)
        plan = stacked._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        # parts are dealt by tile for each layer, pixels are not dealt again
        assert plan.count("Exchange hashpartitioning(tile_id") == 3
        assert stacked.count() == px.count()
        assert stacked.where("tile_id < 20").exceptAll(px.where("tile_id < 20").select(*at, F.col("row").alias("r"), "true_inst", "true_class")).isEmpty()
    finally:
        apply_session_rules(spark)


def _tiles(spark):
    """Ten 6 x 6 tiles of two instances: rows 0 to 2 and 3 to 5; the class tells tile and row. Pixels of tile 3 come twice."""
    px = spark.range(360).select(
        (F.col("id") / 36).cast("bigint").alias("tile_id"),
        (F.col("id") / 6 % 6).cast("int").alias("row"),
        (F.col("id") % 6).cast("int").alias("col"),
    )
    px = px.unionByName(px.where("tile_id = 3"))
    return px.select("*", (1 + F.col("row") / 3).cast("int").alias("inst"), (F.col("tile_id") * 10 + F.col("row")).cast("int").alias("cls"))


def test_classes_of_dealt_tiles_are_looked_up_where_they_are(spark):
    expected = sorted((t, i, 10 * t + 3 * i - 2) for t in range(10) for i in (1, 2) for _ in range(2 if t == 3 else 1))
    try:
        for px, exchanges in ((_tiles(spark).repartition(3, "tile_id"), 2), (_tiles(spark), None)):
            apply_session_rules(spark)
            found = class_at_centroid(px, "inst", "cls")
            plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
            assert sorted(tuple(r) for r in found.collect()) == expected
            if exchanges:  # tiles are dealt for the positions and for the pixels, pixels are not dealt again
                assert plan.count("Exchange hashpartitioning(tile_id") == exchanges
                assert "Sort [" not in plan
    finally:
        apply_session_rules(spark)


def test_confusion_matrix_reads_the_labels_once(spark):
    labels = spark.range(30).select((F.col("id") % 2).alias("t"), (F.col("id") % 3).alias("p"))
    found = confusion_matrix(labels)
    assert "Range (" not in found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert sorted((r["t"], r["p"], r["n"]) for r in found.collect()) == [(t, p, 5 if t < 2 else 0) for t in range(3) for p in range(3)]
