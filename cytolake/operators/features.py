"""The per-slide feature catalogue: fractions, log ratios, densities, shares, and the long result table."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.geometry import log_ratio
from cytolake.functions.summary import STATS
from cytolake.operators.cells import BAND, TUMOUR, class_name
from cytolake.operators.distance import class_pairs
from cytolake.schema import BAND_CLASSES, FEATURE_NAMES, TUMOUR_CLASSES

# Section and group titles of the result document.
WSI, RATIOS = "CalculationsforWSI", "CalculationsRatiosinsideTumor"
MORPH, DIST, MIXED = "CalculationsMorphinsideTumor", "CalculationsDistinsideTumor", "CalculationsMixed"
WSI_FRACTIONS = "Percentages_of_cell_types_in_WSI"
WSI_RATIOS = "Ratios_between_cell_types_WSI"
REGION_FRACTIONS = "Percentages_of_cell_types_in_Tumor_Regions"
REGION_RATIOS = "Ratios_between_cell_types_Tumor_Regions"
REGION_DENSITY = "Density_of_cell_types_inside_Tumor_Regions"
SHARES = "Percentage_of_Cells_inside_Tumor_regions_for_a_given_cell_type"
REGION_MORPH = "Morphology_of_cells_in_Tumor_Regions"
REGION_DIST = "Distances_of_cells_in_Tumor_Regions"

# Order in which classes serve as denominator of a log ratio, by class code. The
# tumour class of the slide lists is replaced by the epithelial one in the band.
RATIO_ORDER = {"wsi": [5, 2, 3, 1, 4, 6], TUMOUR: [5, 2, 3, 1, 4], BAND: [6, 2, 3, 1, 4]}


def ratio_pairs(order: Sequence[int]) -> list[tuple[int, int]]:
    """(numerator, denominator) pairs: each denominator is set against every class not used as one before."""
    return [(a, b) for i, b in enumerate(order) for a in sorted(order[i + 1 :])]


def ratio_name(a: int, b: int, suffix: str = "") -> str:
    below = FEATURE_NAMES[b]
    if (a, b, suffix) == (6, 4, ""):
        below = "StromalCells"  # fixed value: spelling of this one published name
    return f"LogRatio_{FEATURE_NAMES[a]}_{below}{suffix}"


def _feature(section: str, grp: str, name: str, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        F.lit(grp).alias("grp"),
        F.lit(name).alias("feature"),
        F.array(F.lit(section), F.lit(grp), F.lit(name)).alias("path"),
        value.cast("double").alias("value"),
    )


def unfold(wide: DataFrame, rows: list[Column]) -> DataFrame:
    """One row per slide and feature."""
    return wide.select("slide_id", F.explode(F.array(*rows)).alias("r")).select("slide_id", "r.*")


def wide_counts(slide_counts: DataFrame) -> DataFrame:
    """Whole-slide counts, one column per class: w1..w6."""
    return slide_counts.groupBy("slide_id").agg(
        *[F.sum(F.when(F.col("cell_type") == c, F.col("n"))).alias(f"w{c}") for c in range(1, 7)]
    )


def _total(prefix: str, classes: Sequence[int]) -> Column:
    out = F.col(f"{prefix}{classes[0]}")
    for c in classes[1:]:
        out = out + F.col(f"{prefix}{c}")
    return out


def slide_features() -> list[Column]:
    """6 fractions and 15 log ratios of the whole slide; background does not count."""
    total = _total("w", range(1, 7))
    rows = [
        _feature(WSI, WSI_FRACTIONS, f"{FEATURE_NAMES[c]}_Percentage", F.try_divide(F.col(f"w{c}"), total))
        for c in range(1, 7)
    ]
    rows += [
        _feature(WSI, WSI_RATIOS, ratio_name(a, b), log_ratio(F.col(f"w{a}"), F.col(f"w{b}")))
        for a, b in ratio_pairs(RATIO_ORDER["wsi"])
    ]
    return rows


def region_features(vicinity: bool = True) -> list[Column]:
    """Fractions and log ratios inside the tumour and, with ``vicinity``, in its border band."""
    rows = []
    for pop, prefix, classes, suffix, on in (
        (TUMOUR, "nt", TUMOUR_CLASSES, "inTumor", True),
        (BAND, "nb", BAND_CLASSES, "inTumorVicinity", vicinity),
    ):
        if not on:
            continue
        total = _total(prefix, classes)
        rows += [
            _feature(
                RATIOS,
                REGION_FRACTIONS,
                f"Percentage_{FEATURE_NAMES[c]}_allcells{suffix}",
                F.try_divide(F.col(f"{prefix}{c}"), total),
            )
            for c in classes
        ]
        rows += [
            _feature(
                RATIOS, REGION_RATIOS, ratio_name(a, b, f"_{suffix}"), log_ratio(F.col(f"{prefix}{a}"), F.col(f"{prefix}{b}"))
            )
            for a, b in ratio_pairs(RATIO_ORDER[pop])
        ]
    return rows


def density_features() -> list[Column]:
    """Counts and cell area per tumour area; NULL where the slide has no tumour area. Needs ``area``."""
    rows = [
        _feature(RATIOS, REGION_DENSITY, f"{FEATURE_NAMES[c]}_perTumorarea", F.try_divide(F.col(f"nt{c}"), F.col("area")))
        for c in TUMOUR_CLASSES
    ]
    rows += [
        _feature(
            RATIOS,
            REGION_DENSITY,
            f"{FEATURE_NAMES[c]}Density_insideTumorarea",
            F.try_divide(F.col(f"at{c}"), F.col("area")),
        )
        for c in TUMOUR_CLASSES
    ]
    return rows


def share_features() -> list[Column]:
    """Part of each class that lies inside the tumour."""
    return [
        _feature(MIXED, SHARES, f"Percentage_{FEATURE_NAMES[c]}_insideTumor", F.try_divide(F.col(f"nt{c}"), F.col(f"w{c}")))
        for c in (1, 2, 3, 4)
    ]


def morphology_features(morphology: DataFrame) -> DataFrame:
    """Morphology summaries as features; the full name keeps population and class apart."""
    place = F.when(F.col("population") == TUMOUR, "Morphology_insideTumor").otherwise("Morphology_insideTumorVicinity")
    stats = F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in STATS])
    return (
        morphology.withColumn("place", place)
        .withColumn("cls", class_name(F.col("cell_type")))
        .select("slide_id", "place", "cls", "measure", F.explode(stats).alias("s"))
        .select(
            "slide_id",
            F.lit(MORPH).alias("section"),
            F.lit(REGION_MORPH).alias("grp"),
            F.concat_ws("_", "place", "cls", "measure", "s.stat").alias("feature"),
            F.array(
                F.lit(MORPH), F.lit(REGION_MORPH), F.col("place"), F.col("cls"), F.concat_ws("_", "measure", "s.stat")
            ).alias("path"),
            F.col("s.value").alias("value"),
        )
    )


def distance_name(source: int, target: int) -> str:
    a, b = FEATURE_NAMES[source], FEATURE_NAMES[target]
    if (source, target) == (3, 4):
        a, b = b, a  # fixed value: the one published name with its classes swapped
    return f"DistClosest_{a}_{b}_inTumor"


def distance_features(summary: DataFrame, classes: Sequence[int]) -> DataFrame:
    stats = F.array(*[F.struct(F.lit(f"dist_{s}").alias("stat"), F.col(s).alias("value")) for s in STATS])
    name = None
    for s, t in class_pairs(classes):
        hit = (F.col("source") == s) & (F.col("target") == t)
        name = F.when(hit, distance_name(s, t)) if name is None else name.when(hit, distance_name(s, t))
    return (
        summary.withColumn("pair", name)
        .select("slide_id", "pair", F.explode(stats).alias("s"))
        .select(
            "slide_id",
            F.lit(DIST).alias("section"),
            F.lit(REGION_DIST).alias("grp"),
            F.concat_ws("_", "pair", "s.stat").alias("feature"),
            F.array(F.lit(DIST), F.lit(REGION_DIST), F.col("pair"), F.col("s.stat")).alias("path"),
            F.col("s.value").alias("value"),
        )
    )
