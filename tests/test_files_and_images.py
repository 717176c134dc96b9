"""Files of their own names, mask images, nested label maps and the areas distances are taken in."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.operators import distance as D
from cytolake.operators import mask as M
from cytolake.operators import regions as R
from cytolake.operators import segmentation as S
from cytolake.plans import slide_features as P
from cytolake.sources import masks as MI
from cytolake.sources import tables as ST
from cytolake.sources.files import write_files


def test_files_appear_whole_and_once(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = spark.createDataFrame([("a b#1.json", b"{}"), ("c+d.json", None), ("e.json", b"x" * 100_000)], "name string, content binary")
    assert sorted(tuple(r) for r in write_files(rows, folder).collect()) == [("a b#1.json", 2), ("c+d.json", 0), ("e.json", 100_000)]
    write_files(rows, folder).collect()  # again: the same files
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a b#1.json", "c+d.json", "e.json"]
    got = {r.slide_id: r.doc for r in ST.read_feature_docs(spark, folder).collect()}
    assert got["a b#1"] == "{}" and got["e"] == "x" * 100_000 and set(got) >= {"a b#1", "e"}
    assert write_files(rows.limit(0), str(tmp_path / "none")).count() == 0


def test_png_holds_its_rows():
    image = MI.png_image(4, 5, [(1, [(0, 1, 255), (4, 4, 7)]), (2, [(2, 2, 1)])])
    at = image.index(b"IDAT")
    size = int.from_bytes(image[at - 4 : at], "big")
    plane = np.frombuffer(zlib.decompress(image[at + 4 : at + 4 + size]), np.uint8).reshape(4, 6)
    assert not plane[:, 0].any()
    assert plane[:, 1:].tolist() == [[0] * 5, [255, 255, 0, 0, 7], [0, 0, 1, 0, 0], [0] * 5]


def test_mask_images_round_trip(spark, tmp_path):
    dice = np.random.default_rng(3)
    grids = {"s 1": (dice.random((70, 33)) < 0.4) * 255, "t": np.zeros((3, 4), int), "u": np.full((1, 1), 9)}
    pixels = [(s, r, c, int(g[r, c])) for s, g in grids.items() for r in range(g.shape[0]) for c in range(g.shape[1])]
    table = spark.createDataFrame(pixels, "slide_id string, row int, col int, value int")
    frame = table.groupBy("slide_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))
    runs = M.mask_runs(table, 255).withColumn("value", F.lit(255)).unionByName(M.mask_runs(table, 9).withColumn("value", F.lit(9)))
    folder = str(tmp_path / "masks")
    assert MI.write_masks(runs, frame, folder).count() == 3
    assert sorted(tuple(r) for r in MI.read_masks(spark, folder, 16).collect()) == sorted(pixels)
    for size in (7, 1024):
        back = MI.read_mask_runs(spark, folder, size)
        again = back.select("slide_id", "row", F.explode(F.sequence("c0", "c1")).alias("col"), "value")
        assert sorted(tuple(r) for r in again.collect()) == sorted(pixels)
        assert back.where("slide_id = 't'").count() == 3  # one run per row


def test_nested_label_maps(spark):
    rows = [("a", r, c, 10 * r + c, c % 3) for r in range(3) for c in range(4)] + [("b", 0, 0, 5, 1)]
    px = spark.createDataFrame(rows, "tile_id string, row int, col int, inst int, type int").repartition(5)
    grouped = S.grouped_labels(px)
    one = {r.tile_id: r for r in grouped.collect()}["a"]
    assert one.inst_map == [[0, 1, 2, 3], [10, 11, 12, 13], [20, 21, 22, 23]] and one.type_map[2] == [0, 1, 2, 0]
    assert sorted(tuple(r) for r in S.grouped_pixels(grouped).collect()) == sorted(rows)


def test_a_margin_joins_regions_and_the_slide_needs_none(spark):
    runs = spark.createDataFrame([("s", 2, 0, 3), ("s", 8, 0, 3)], "slide_id string, row int, c0 int, c1 int")
    frame = spark.createDataFrame([("s", 12, 12)], "slide_id string, height int, width int")
    counted = lambda margin: R.margin_regions(runs, frame, margin).select("region_id").distinct().count()
    assert counted(6) == 2 and counted(14) == 1  # kernels of 3 and 7 pixels
    cells = spark.createDataFrame([("s", i, float(x), float(x), t) for i, (x, t) in enumerate([(0, 1), (3000, 2), (5, 3)])], "slide_id string, cell_ord bigint, cx double, cy double, cell_type int")
    got = {(r.source, r.target): r.dist for r in D.nearest_targets(D.whole_slide(cells, [1, 2]), [1, 2]).collect()}
    assert got == {(1, 2): pytest.approx(3000 * 2**0.5)}
    with pytest.raises(ValueError, match="tumour, the margin or the slide"):
        P._distance_cells(cells, runs, frame, P.Settings(distance_area="nowhere"))
