import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytolake.functions import geometry as G
from cytolake.functions import text as TX
from cytolake.operators import cells as C
from cytolake.operators import features as FT
from cytolake.operators import mask as M
from cytolake.operators import morphology as morphology_module
from cytolake.operators import regions as R
from cytolake.operators.morphology import morphology
from cytolake.plans import slide_features as P
from cytolake.runtime import cut
from cytolake.sources import cells as SC
from cytolake.sources import masks as SM
from cytolake.sources import sinks as K
from cytolake.sources import tables as ST
from cytolake.streaming.ingest import stream_cells


def grid_of(df, shape, value=True):
    out = np.zeros(shape, dtype=int)
    for r in M.run_pixels(df).collect():
        out[r["row"], r["col"]] = 1
    return out


def pixels(spark, grid, slide="s"):
    rows = [(slide, int(r), int(c), int(grid[r, c])) for r in range(grid.shape[0]) for c in range(grid.shape[1])]
    return spark.createDataFrame(rows, "slide_id string, row int, col int, value int")


def window_extreme(grid, k, pick):
    """Literal k x k sliding maximum or minimum; beyond the border nothing counts."""
    a, b = k // 2, k - 1 - k // 2
    h, w = grid.shape
    return np.array([[pick(grid[max(0, r - a) : r + b + 1, max(0, c - a) : c + b + 1]) for c in range(w)] for r in range(h)])


def test_mask_area_and_remap(spark, mask100):
    assert M.pixel_area(mask100, 255, 1).first()["area"] == 3600
    assert M.pixel_area(mask100, 0, 1).first()["area"] == 6400
    assert M.pixel_area(mask100, 7, 1).first()["area"] == 0
    raw = spark.createDataFrame([("s", 0, i, v) for i, v in enumerate([1, 2, 0, 9])], "slide_id string, row int, col int, value int")
    assert [r["value"] for r in M.remap_pixels(raw).orderBy("col").collect()] == [0, 255, 0, 9]
    swapped = M.remap_pixels(raw, [1, 2], [2, 1])
    assert [r["value"] for r in swapped.orderBy("col").collect()] == [2, 1, 0, 9]
    with pytest.raises(ValueError):
        M.remap_pixels(raw, [1], [1, 2])


@pytest.mark.parametrize("k", [1, 2, 5, 6, 16, 23, 70])
def test_morphology_against_sliding_window(spark, k):
    rng = np.random.default_rng(k)
    grid = (rng.random((23, 31)) < 0.55).astype(int)
    mask = pixels(spark, grid * 255)
    runs, frame = M.mask_runs(mask), M.mask_frame(mask)
    big, small = window_extreme(grid, k, np.max), window_extreme(grid, k, np.min)
    assert np.array_equal(grid_of(M.dilate(runs, frame, k), grid.shape), big)
    assert np.array_equal(grid_of(M.erode(runs, frame, k), grid.shape), small)
    assert np.array_equal(grid_of(M.border_band(runs, frame, k), grid.shape), big - small)


def test_unions_of_a_strip_do_not_hang_on_its_height():
    """A strip of any height gives as many unions as its rows with runs ask for."""
    rows = [(3, [(0, 4)]), (5, [(2, 9), (20, 21)]), (6, [(10, 10)])]
    for last in (9, 10_000):
        got = list(M.strip_unions(rows, 0, last))
        assert got == [
            (3, 4, 0, 4, True), (5, 5, 0, 9, True), (5, 5, 20, 21, True), (6, last, 0, 10, True), (6, last, 20, 21, True),
            (6, 6, 10, 10, False), (4, 5, 2, 10, False), (4, 5, 20, 21, False), (0, 3, 0, 10, False), (0, 3, 20, 21, False),
        ]


def test_square_grows_and_shrinks(mask100):
    runs, frame = M.mask_runs(mask100), M.mask_frame(mask100)
    assert M.runs_area(M.dilate(runs, frame, 5), 1).first()["area"] == 64 * 64
    assert M.runs_area(M.erode(runs, frame, 5), 1).first()["area"] == 56 * 56
    assert M.band_kernel() == 67
    with pytest.raises(ValueError):
        M.band_kernel(10, 32)


def test_regions_match_flood_fill(spark):
    rng = np.random.default_rng(3)
    grid = (rng.random((150, 40)) < 0.42).astype(int)
    want, n = np.zeros(grid.shape, dtype=int), 0
    for r, c in zip(*np.nonzero(grid)):
        if want[r, c]:
            continue
        n += 1
        todo = [(r, c)]
        want[r, c] = n
        while todo:
            y, x = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    v, u = y + dy, x + dx
                    if 0 <= v < 150 and 0 <= u < 40 and grid[v, u] and not want[v, u]:
                        want[v, u] = n
                        todo.append((v, u))
    two = pixels(spark, grid * 255, "a").unionByName(pixels(spark, grid * 255, "b"))
    for slide in "ab":
        got = np.zeros(grid.shape, dtype=int)
        labelled = R.label_regions(M.mask_runs(two)).where(F.col("slide_id") == slide)
        for r in M.run_pixels(labelled).collect():
            got[r["row"], r["col"]] = r["region_id"]
        assert np.array_equal(got, want)


def test_polygon_measures(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0]]
    df = spark.createDataFrame([(ring,), ([[1.0, 1.0]],)], "contour array<array<double>>")
    c = F.col("contour")
    box, point = df.select(
        G.polygon_area(c).alias("a"),
        G.circularity(G.polygon_area(c), G.polygon_perimeter(c)).alias("circ"),
        G.aspect_ratio(G.polygon_width(c), G.polygon_height(c)).alias("asp"),
    ).collect()
    assert box["a"] == 8 and box["asp"] == 0.5 and box["circ"] == pytest.approx(4 * math.pi * 8 / 144)
    assert point["a"] == 0 and point["circ"] is None and point["asp"] is None


def test_counts_inside_and_in_band(mask100, cells7):
    runs, frame = M.mask_runs(mask100), M.mask_frame(mask100)
    layers = C.population_layers(runs, M.border_band(runs, frame, 5))
    got = C.population_counts(C.with_measures(cells7), layers, [1, 2, 3], [1, 2, 3], down=1).collect()
    by = {(r["population"], r["cell_type"]): (r["n"], r["area"]) for r in got}
    assert [by[("tumour", k)] for k in (1, 2, 3)] == [(3, 116), (2, 32), (0, 0)]
    assert by[("band", 1)][0] == 3 and by[("band", 2)][0] == 0
    inside = {r["cell_id"] for r in C.inside_cells(cells7, runs, 1).collect()}
    assert inside == {"0", "1", "2", "3", "4"}


def test_cells_off_the_image_are_outside(spark, mask100):
    far = spark.createDataFrame([("s", 1.0, -5.0, 5), ("s", 900.0, 40.0, 5), ("s", 40.0, 40.0, 5)], "slide_id string, cx double, cy double, cell_type int")
    out = C.relabel_outside(far, M.mask_runs(mask100), down=1)
    assert sorted(r["cell_type"] for r in out.collect()) == [5, 6, 6]
    assert {r["cell_type"] for r in C.undo_relabel(out).collect()} == {5}


def test_slide_features(spark):
    n = dict(zip(range(7), [10, 10, 20, 30, 40, 100, 0]))
    counts = spark.createDataFrame([("s", k, v) for k, v in n.items()], "slide_id string, cell_type int, n bigint")
    got = {r["feature"]: r["value"] for r in FT.unfold(FT.wide_counts(counts), FT.slide_features()).collect()}
    assert len(got) == 21
    assert got["Granulocytes_Percentage"] == 0.05 and got["TumorCells_Percentage"] == 0.5
    assert sum(v for k, v in got.items() if k.endswith("Percentage")) == pytest.approx(1)
    assert got["LogRatio_Granulocytes_TumorCells"] == pytest.approx(math.log(10.001 / 100.001))
    assert "LogRatio_EpithelialCells_StromalCells" in got


def test_full_catalogue_has_317_names(mask100, cells7):
    df = P.tissue_features(cells7, mask100, P.Settings(down=1, margin=10, morphology=True, distances=True))
    names = [r["feature"] for r in df.collect()]
    assert len(names) == len(set(names)) == 317
    assert "Morphology_insideTumorVicinity_Epithelial_aspectratios_iqr" in names
    assert "DistClosest_Granulocytes_Lymphocytes_inTumor_dist_MAD" in names
    default = P.tissue_features(cells7, mask100, P.Settings(down=1, margin=10))
    assert default.count() == 65


def test_slide_without_mask_keeps_whole_slide_features(mask100, cells7):
    other = cells7.withColumn("slide_id", F.lit("unmasked"))
    df = P.tissue_features(cells7.unionByName(other), mask100, P.Settings(down=1, margin=10))
    rows = {r["feature"]: r["value"] for r in df.where("slide_id = 'unmasked'").collect()}
    assert rows["Granulocytes_Percentage"] == pytest.approx(3 / 7)
    assert rows["Granulocytes_perTumorarea"] is None


def test_morphology_of_squares(mask100, cells7):
    layers = C.population_layers(M.mask_runs(mask100))
    rows = morphology(C.with_measures(cells7), layers, [1, 2, 3], None, 1).collect()
    by = {(r["cell_type"], r["measure"]): r for r in rows}
    assert len(rows) == 9
    area = by[(1, "areas")]
    values = np.array([16.0, 36.0, 64.0])
    assert area["mean"] == pytest.approx(values.mean()) and area["std"] == pytest.approx(values.std())
    assert area["median"] == 36 and area["MAD"] == pytest.approx(np.abs(values - values.mean()).mean())
    assert by[(1, "circularities")]["mean"] == pytest.approx(math.pi / 4)
    assert by[(1, "aspectratios")]["skewness"] is None  # constant
    absent = by[(3, "areas")]
    assert absent["n"] == 0 and absent["mean"] == 0 and absent["iqr"] == 0


def test_layers_of_kept_masks_lose_no_population(mask100, cells7):
    """A union of a checkpointed and a computed layer, summarised through joins on the layer name."""
    runs, profile = P.prepare_mask(mask100, 1)
    layers = P.population_layers(runs, profile, P.Settings(down=1, margin=10))
    got = {(r["population"], r["cell_type"]): r["n"] for r in morphology(C.with_measures(cells7), layers, [1, 2], [1, 2], 1).collect()}
    assert got == {("tumour", 1): 3, ("tumour", 2): 2, ("band", 1): 3, ("band", 2): 0}


def png(path, array):
    """Minimal PNG: grey, RGB or RGBA by the array's shape."""
    h, w = array.shape[:2]
    kind = {2: 0, 3: 2}.get(array.ndim) if array.ndim == 2 or array.shape[2] == 3 else 6
    lines = b"".join(b"\0" + array[r].tobytes() for r in range(h))

    def chunk(tag, data):
        return struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))

    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b""))


def test_read_mask_images(spark, tmp_path):
    rng = np.random.default_rng(0)
    grey = rng.choice([0, 255], (70, 9)).astype(np.uint8)
    colour = np.stack([grey, 255 - grey, np.full_like(grey, 3)], axis=2)
    (tmp_path / "m").mkdir()
    png(tmp_path / "m" / "grey.png", grey)
    png(tmp_path / "m" / "colour.png", colour)
    for slide in ("grey", "colour"):
        got = np.zeros(grey.shape, dtype=int)
        for r in SM.read_masks(spark, str(tmp_path / "m")).where(F.col("slide_id") == slide).collect():
            got[r["row"], r["col"]] = r["value"]
        assert np.array_equal(got, grey)  # the red channel of the colour image
    runs = SM.read_mask_runs(spark, str(tmp_path / "m")).where("slide_id = 'grey'")
    again = np.zeros(grey.shape, dtype=int)
    for r in M.run_pixels(runs).collect():
        again[r["row"], r["col"]] = r["value"]
    assert np.array_equal(again, grey) and runs.first()["height"] == 70
    (tmp_path / "bad").mkdir()
    png(tmp_path / "bad" / "rgba.png", np.zeros((4, 4, 4), dtype=np.uint8))
    with pytest.raises(Exception, match="1 or 3 channels"):
        SM.read_masks(spark, str(tmp_path / "bad")).count()


def test_cell_documents_in_all_forms(spark, tmp_path):
    one = '"7": {"bbox": [[1, 2], [3, 4]], "centroid": [1.5, 2.5], "contour": [[0, 0], [1, 0], [1, 1]], "type_prob": 0.9, "type": 5}'
    two = '"8": {"centroid": [3, 4], "contour": [[2, 2]], "type": 1}'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "wsi.json").write_text('{"mag": 40, "nuc": {' + one + ", " + two + "}}")
    (tmp_path / "in" / "bare.json").write_text("{" + one + ",\n  " + two + "}\n")
    (tmp_path / "in" / "none.json").write_text('{"mag": null, "nuc": {}}')
    rows = SC.read_cells(spark, str(tmp_path / "in")).orderBy("slide_id", "cell_ord").collect()
    assert [(r["slide_id"], r["cell_id"], r["cx"], r["cell_type"]) for r in rows] == [
        ("bare", "7", 1.5, 5), ("bare", "8", 3.0, 1), ("wsi", "7", 1.5, 5), ("wsi", "8", 3.0, 1)
    ]
    assert rows[0]["contour"] == [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]


def test_one_document_is_split_between_tasks(spark, tmp_path):
    n = 3000
    body = ", ".join(f'"{i}": {{"centroid": [{i}, {i % 7}], "type": {1 + i % 5}}}' for i in range(n))
    (tmp_path / "big.json").write_text('{"mag": 40, "nuc": {' + body + "}}")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = SC.read_cells(spark, str(tmp_path / "big.json"))
        assert df.rdd.getNumPartitions() > 3
        rows = df.orderBy("cell_ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["cell_id"] for r in rows] == [str(i) for i in range(n)]


def test_stream_takes_only_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    doc = '{"mag": 40, "nuc": {"1": {"centroid": [1, 2], "type": 3}}}'
    (tmp_path / "in" / "a.json").write_text(doc)

    def run():
        stream_cells(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r["slide_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a"]
    assert run() == ["a"]
    (tmp_path / "in" / "b.json").write_text(doc)
    assert run() == ["a", "b"]


def test_feature_document_is_nested(spark, tmp_path, mask100, cells7):
    df = P.tissue_features(cells7, mask100, P.Settings(down=1, margin=10, morphology=True))
    doc = K.feature_documents(df).first()["doc"]
    import json

    parsed = json.loads(doc)
    assert parsed["CalculationsMorphinsideTumor"]["Morphology_of_cells_in_Tumor_Regions"]["Morphology_insideTumor"]["Granulocyte"]["areas_median"] == 36
    assert parsed["CalculationsforWSI"]["Percentages_of_cell_types_in_WSI"]["Granulocytes_Percentage"] == pytest.approx(3 / 7)


def test_lookup_csv_last_row_wins(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("sample_a,1\nsample_b,2\nsample_a,3\n")
    got = {r["k"]: r["v"] for r in ST.read_id_lookup(spark, str(tmp_path / "ids.csv")).collect()}
    assert got == {"sample_a": "3", "sample_b": "2"}


def test_words_and_names(spark):
    df = spark.createDataFrame([("Tumor TumorMargin aaa",)], "t string")
    row = df.select(TX.count_substring(F.col("t"), "Tumor"), TX.count_substring(F.col("t"), "aa")).first()
    assert tuple(row) == (2, 1)
    names = spark.createDataFrame([("S1_no_response_analysed.json",), ("S2_vicinity_response_analysed.json",)], "n string")
    got = names.select(TX.label_from_name(F.col("n")), TX.sample_from_name(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(0, "S1"), (1, "S2")]
    with pytest.raises(Exception, match="no label token"):
        spark.createDataFrame([("x",)], "n string").select(TX.label_from_name(F.col("n"))).collect()


def test_layer_segments_cover_each_pixel_once(spark, mask100):
    runs = M.mask_runs(mask100)
    band = M.border_band(runs, M.mask_frame(mask100), 7)
    got = M.run_pixels(M.layer_segments(runs, band)).collect()
    flags = {(r.row, r.col): (r.in_tumour, r.in_band) for r in got}
    assert len(flags) == len(got)
    tumour = {(r.row, r.col) for r in M.run_pixels(runs).collect()}
    border = {(r.row, r.col) for r in M.run_pixels(band).collect()}
    assert flags == {p: (p in tumour, p in border) for p in tumour | border}


def test_relabelling_in_the_lookup_equals_relabelling_before(spark, mask100, cells7):
    five = cells7.withColumn("cell_type", F.when(F.col("cell_type") == 3, 5).otherwise(F.col("cell_type")))
    cfg = dict(down=1, margin=10)
    before = P.tissue_features(C.relabel_outside(five, M.mask_runs(mask100), down=1), mask100, P.Settings(**cfg))
    within = P.tissue_features(five, mask100, P.Settings(**cfg, relabel=True))
    rows = lambda df: sorted((r.section, r.feature, r.value) for r in df.collect() if r.value is not None)
    assert rows(before) == rows(within) and any("Epithelial" in r[1] and r[2] for r in rows(within))


def test_flagship_plan_reads_cells_once_and_keeps_outlines_in_the_scan(spark, mask100, tmp_path):
    from workloads import inputs, spatial

    plan = spatial.default_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1
    assert not any("contour" in line for line in plan.splitlines() if "Exchange" in line)
    assert inputs.cells(spark, "/root/testdata/sf0.001").columns[-1] == "contour"


def test_morphology_stores_the_cells_of_the_populations(spark, cells7, monkeypatch):
    """Values are looked at more than once: they are read back, not measured and looked up again."""
    looked_up = []
    monkeypatch.setattr(morphology_module, "cut", lambda df: looked_up.append(df.columns) or cut(df))
    layers = C.population_layers(spark.createDataFrame([("s", r, 20, 79) for r in range(20, 80)], "slide_id string, row int, c0 int, c1 int"))
    plan = morphology(C.with_measures(cells7), layers, [1, 2, 3], None, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert looked_up == [["slide_id", "cell_type", "area", "circularity", "aspect", "population"]]
    assert "zip_with" not in plan
