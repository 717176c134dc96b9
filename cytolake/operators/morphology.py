"""Morphology summaries per class and population."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions.summary import STATS, distribution_summary
from cytolake.operators.cells import BAND, TUMOUR, populations, wanted
from cytolake.runtime import cut
from cytolake.schema import BAND_CLASSES, DOWN_FACTOR, TUMOUR_CLASSES

# Measure column -> prefix of its statistics in feature names.
MEASURES = {"area": "areas", "circularity": "circularities", "aspect": "aspectratios"}


def long_measures(tagged: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(p).alias("measure"), F.col(c).alias("value")) for c, p in MEASURES.items()])
    return tagged.select(*keys, F.explode(rows).alias("m")).select(*keys, "m.measure", "m.value")


def class_grid(slides: DataFrame, lists: Sequence[tuple[str, Sequence[int]]], measures: Sequence[str]) -> DataFrame:
    """Every (slide, population, class, measure) a result must have a row for."""
    rows = F.array(
        *[
            F.struct(F.lit(p).alias("population"), F.lit(c).alias("cell_type"), F.lit(m).alias("measure"))
            for p, classes in lists
            for c in classes
            for m in measures
        ]
    )
    return slides.select("slide_id").distinct().select("slide_id", F.explode(rows).alias("r")).select("slide_id", "r.*")


def morphology(
    measured: DataFrame,
    layers: DataFrame,
    tumour_classes: Sequence[int] = TUMOUR_CLASSES,
    band_classes: Sequence[int] | None = BAND_CLASSES,
    down: int = DOWN_FACTOR,
) -> DataFrame:
    """Morphology straight from measured cells.

    The summaries look at their values more than once, so the cells of the populations are stored: else each look would measure
    all cells, make the layers and look the cells up again.
    """
    lean = measured.select("slide_id", "cx", "cy", "cell_type", *MEASURES)
    members = populations(lean, layers, "inner", down).where(wanted(tumour_classes, band_classes or []))
    return summarise_tagged(cut(members.drop("cx", "cy")), measured, tumour_classes, band_classes)


def summarise_tagged(
    tagged: DataFrame,
    slides: DataFrame,
    tumour_classes: Sequence[int] = TUMOUR_CLASSES,
    band_classes: Sequence[int] | None = BAND_CLASSES,
) -> DataFrame:
    """Seven statistics of area, circularity and aspect ratio; all 0 for an absent class.

    ``tagged`` has one row per cell and population, ``slides`` names the slides that need rows.
    """
    keys = ["slide_id", "population", "cell_type"]
    lists = [(TUMOUR, tumour_classes)] + ([(BAND, band_classes)] if band_classes else [])
    members = tagged.where(wanted(tumour_classes, band_classes or []))
    stats = distribution_summary(long_measures(members, keys), [*keys, "measure"], "value")
    grid = class_grid(slides, lists, list(MEASURES.values()))
    filled = grid.join(stats, [*keys, "measure"], "left")
    absent = F.col("n").isNull()
    return filled.select(
        *keys,
        "measure",
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.when(absent, F.lit(0.0)).otherwise(F.col(s)).alias(s) for s in STATS],
    )
