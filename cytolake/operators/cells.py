"""Cell projections, mask lookups and per-class counts."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions import geometry as G
from cytolake.operators.regions import BLOCK, blocks
from cytolake.schema import BACKGROUND, BAND_CLASSES, CLASS_NAMES, DOWN_FACTOR, TUMOUR_CLASSES

TUMOUR = "tumour"
BAND = "band"


def cell_pixel(cells: DataFrame, down: int = DOWN_FACTOR) -> DataFrame:
    """Add the mask pixel (row, col) under each centroid."""
    return cells.withColumn("row", G.to_pixel(F.col("cy"), down)).withColumn("col", G.to_pixel(F.col("cx"), down))


def select_classes(cells: DataFrame, classes: Sequence[int]) -> DataFrame:
    return cells.where(F.col("cell_type").isin(list(classes)))


def class_name(cell_type: Column, names: Sequence[str] = CLASS_NAMES) -> Column:
    """Name of a 1-based class code; 0 is the background; NULL beyond the list."""
    listed = F.array(*[F.lit(n) for n in [BACKGROUND, *names]])
    return F.when(cell_type >= 0, F.try_element_at(listed, (cell_type + 1).cast("int")))


def with_measures(cells: DataFrame) -> DataFrame:
    """Replace the contour by its measures.

    Done before any lookup join: three doubles travel through the shuffle instead of the
    whole outline.
    """
    return (
        cells.withColumn("area", G.polygon_area(F.col("contour")))
        .withColumn("_perimeter", G.polygon_perimeter(F.col("contour")))
        .withColumn("circularity", G.circularity(F.col("area"), F.col("_perimeter")))
        .withColumn(
            "aspect", G.aspect_ratio(G.polygon_width(F.col("contour")), G.polygon_height(F.col("contour")))
        )
        .drop("contour", "_perimeter")
    )


def lookup_runs(cells: DataFrame, runs: DataFrame, how: str = "inner", down: int = DOWN_FACTOR) -> DataFrame:
    """Join cells to the run under their centroid, keeping the run's extra columns.

    Equi join on (slide, row, column block) with a between test; a run is repeated once
    per block it spans, so a key never holds more than ``BLOCK / 2`` disjoint runs of one layer.
    """
    extra = [c for c in runs.columns if c not in ("slide_id", "row", "c0", "c1")]
    keyed = cell_pixel(cells, down).withColumn("_blk", F.floor(F.col("col") / F.lit(BLOCK)).cast("int"))
    spans = runs.select(
        F.col("slide_id").alias("_slide"),
        F.col("row").alias("_row"),
        F.explode(blocks(F.col("c0"), F.col("c1"))).alias("_span"),
        "c0",
        "c1",
        *extra,
    )
    on = (
        (keyed["slide_id"] == spans["_slide"])
        & (keyed["row"] == spans["_row"])
        & (keyed["_blk"] == spans["_span"])
        & keyed["col"].between(spans["c0"], spans["c1"])
    )
    return keyed.join(spans, on, how).drop("_slide", "_row", "_span", "_blk", "c0", "c1")


def inside_cells(cells: DataFrame, runs: DataFrame, down: int = DOWN_FACTOR) -> DataFrame:
    """Cells whose centroid lies on a run; outside the image means outside."""
    return lookup_runs(cells, runs.select("slide_id", "row", "c0", "c1"), "left_semi", down).drop("row", "col")


def relabel_outside(
    cells: DataFrame, runs: DataFrame, from_class: int = 5, to_class: int = 6, down: int = DOWN_FACTOR
) -> DataFrame:
    """Cells of ``from_class`` not on the mask become ``to_class``."""
    hit = lookup_runs(cells, runs.select("slide_id", "row", "c0", "c1", F.lit(True).alias("_in")), "left", down)
    moved = (F.col("cell_type") == from_class) & F.col("_in").isNull()
    return hit.withColumn("cell_type", F.when(moved, F.lit(to_class)).otherwise(F.col("cell_type"))).drop(
        "_in", "row", "col"
    )


def undo_relabel(cells: DataFrame, from_class: int = 5, to_class: int = 6) -> DataFrame:
    return cells.withColumn(
        "cell_type", F.when(F.col("cell_type") == to_class, F.lit(from_class)).otherwise(F.col("cell_type"))
    )


def population_layers(tumour_runs: DataFrame, band_runs: DataFrame | None = None) -> DataFrame:
    """Tumour and border-band runs as one tagged table, so one join serves both."""
    out = tumour_runs.select("slide_id", "row", "c0", "c1", F.lit(TUMOUR).alias("population"))
    if band_runs is not None:
        out = out.unionByName(band_runs.select("slide_id", "row", "c0", "c1", F.lit(BAND).alias("population")))
    return out


def populations(cells: DataFrame, layers: DataFrame, how: str = "inner", down: int = DOWN_FACTOR) -> DataFrame:
    """One row per (cell, population); a cell may belong to both populations."""
    return lookup_runs(cells, layers, how, down).drop("row", "col")


def tag_cells(cells: DataFrame, segments: DataFrame, relabel: bool = False, down: int = DOWN_FACTOR) -> DataFrame:
    """Each cell once, with ``in_tumour`` and ``in_band``, from one lookup in disjoint segments.

    With ``relabel`` tumour cells outside the tumour layer become epithelial in the same step.
    """
    found = lookup_runs(cells, segments.select("slide_id", "row", "c0", "c1", "in_tumour", "in_band"), "left", down).drop("row", "col")
    flagged = found.withColumn("in_tumour", F.coalesce("in_tumour", F.lit(False))).withColumn("in_band", F.coalesce("in_band", F.lit(False)))
    if not relabel:
        return flagged
    moved = (F.col("cell_type") == 5) & ~F.col("in_tumour")
    return flagged.withColumn("cell_type", F.when(moved, F.lit(6)).otherwise(F.col("cell_type")))


def by_population(tagged: DataFrame) -> DataFrame:
    """Tagged cells as one row per population they are in; a projection without a shuffle."""
    names = F.array_compact(F.array(F.when(F.col("in_tumour"), F.lit(TUMOUR)), F.when(F.col("in_band"), F.lit(BAND))))
    return tagged.withColumn("population", F.explode(names)).drop("in_tumour", "in_band")


def wide_tagged(
    tagged: DataFrame, tumour_classes: Sequence[int] = TUMOUR_CLASSES, band_classes: Sequence[int] | None = BAND_CLASSES
) -> DataFrame:
    """All counts of a slide by one aggregate: w1..w6 of the whole slide, nt and at (area, cut to an integer) in the
    tumour, nb in the band."""
    kind = lambda c: F.col("cell_type") == c
    area = lambda c: F.coalesce(F.sum(F.when(kind(c) & F.col("in_tumour"), F.col("area"))), F.lit(0.0)).cast("bigint")
    aggs = [F.count_if(kind(c)).alias(f"w{c}") for c in range(1, 7)]
    for c in tumour_classes:
        aggs += [F.count_if(kind(c) & F.col("in_tumour")).alias(f"nt{c}"), area(c).alias(f"at{c}")]
    aggs += [F.count_if(kind(c) & F.col("in_band")).alias(f"nb{c}") for c in band_classes or []]
    return tagged.groupBy("slide_id").agg(*aggs)


def wanted(tumour_classes: Sequence[int], band_classes: Sequence[int]) -> Column:
    """The class list of each population."""
    return ((F.col("population") == TUMOUR) & F.col("cell_type").isin(list(tumour_classes))) | (
        (F.col("population") == BAND) & F.col("cell_type").isin(list(band_classes))
    )


def slide_counts(cells: DataFrame, classes: Sequence[int] = (0, 1, 2, 3, 4, 5, 6)) -> DataFrame:
    """Cells per slide and class, zero rows included. Counts are conditional sums of one aggregate."""
    classes = list(classes)
    wide = cells.groupBy("slide_id").agg(*[F.count_if(F.col("cell_type") == c).alias(f"n{c}") for c in classes])
    rows = F.array(*[F.struct(F.lit(c).alias("cell_type"), F.col(f"n{c}").alias("n")) for c in classes])
    return wide.select("slide_id", F.explode(rows).alias("r")).select(
        "slide_id", "r.cell_type", class_name(F.col("r.cell_type")).alias("class_name"), "r.n"
    )


def population_counts(
    measured: DataFrame,
    layers: DataFrame,
    tumour_classes: Sequence[int] = TUMOUR_CLASSES,
    band_classes: Sequence[int] | None = BAND_CLASSES,
    down: int = DOWN_FACTOR,
) -> DataFrame:
    """Counts per population straight from measured cells (slide_id, cx, cy, cell_type, area)."""
    lean = measured.select("slide_id", "cx", "cy", "cell_type", "area")
    return count_tagged(populations(lean, layers, "left", down), tumour_classes, band_classes)


def count_tagged(
    tagged: DataFrame,
    tumour_classes: Sequence[int] = TUMOUR_CLASSES,
    band_classes: Sequence[int] | None = BAND_CLASSES,
) -> DataFrame:
    """Count and total area (cut to an integer) per slide, population and class, zero rows included.

    ``tagged`` comes from a left lookup, so that a slide without any cell inside keeps its zero rows.
    """
    lists = [(TUMOUR, list(tumour_classes))] + ([(BAND, list(band_classes))] if band_classes else [])
    aggs, rows = [], []
    for pop, classes in lists:
        for c in classes:
            hit = (F.col("population") == pop) & (F.col("cell_type") == c)
            aggs.append(F.count_if(hit).alias(f"n_{pop}_{c}"))
            aggs.append(F.coalesce(F.sum(F.when(hit, F.col("area"))), F.lit(0.0)).cast("bigint").alias(f"a_{pop}_{c}"))
            rows.append(
                F.struct(
                    F.lit(pop).alias("population"),
                    F.lit(c).alias("cell_type"),
                    F.col(f"n_{pop}_{c}").alias("n"),
                    F.col(f"a_{pop}_{c}").alias("area"),
                )
            )
    wide = tagged.groupBy("slide_id").agg(*aggs)
    return wide.select("slide_id", F.explode(F.array(*rows)).alias("r")).select("slide_id", "r.*")


def tile_assign(cells: DataFrame, size: int = 1024) -> DataFrame:
    """Non-overlapping square tile under each centroid."""
    return cells.withColumn("tile_x", F.floor(F.col("cx") / F.lit(size)).cast("int")).withColumn(
        "tile_y", F.floor(F.col("cy") / F.lit(size)).cast("int")
    )


def density_grid(cells: DataFrame, size: int = 128) -> DataFrame:
    """Cells per class and grid square, and the total of the square's 3 x 3 neighbourhood."""
    square = ["slide_id", "cell_type", "gx", "gy"]
    place = lambda c: F.floor(F.col(c) / F.lit(size)).cast("int")
    squares = cells.select("slide_id", "cell_type", place("cx").alias("gx"), place("cy").alias("gy")).groupBy(*square).agg(
        F.count("*").alias("n")
    )
    offsets = F.array(
        *[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    )
    # each occupied square adds itself to its neighbours; squares that only receive are kept out
    spread = squares.select(*square, "n", F.explode(offsets).alias("o"))
    return (
        spread.groupBy("slide_id", "cell_type", (F.col("gx") + F.col("o.dx")).alias("gx"), (F.col("gy") + F.col("o.dy")).alias("gy"))
        .agg(
            F.sum(F.when((F.col("o.dx") == 0) & (F.col("o.dy") == 0), F.col("n"))).alias("n"),
            F.sum("n").alias("n_around"),
        )
        .where(F.col("n").isNotNull())
    )
