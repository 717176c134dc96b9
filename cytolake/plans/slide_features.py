"""From cells and masks to the long feature table, all slides in one job."""

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.operators import cells as C
from cytolake.operators import distance as D
from cytolake.operators import features as FT
from cytolake.operators import mask as M
from cytolake.operators.morphology import MEASURES, summarise_tagged
from cytolake.operators.regions import label_regions, margin_regions
from cytolake.runtime import cut
from cytolake.schema import BAND_CLASSES, DISTANCE_CLASSES, DOWN_FACTOR, INSIDE, MARGIN, TUMOUR_CLASSES


@dataclass
class Settings:
    """Switches of the analysis; morphology and distances are optional as they cost most."""

    down: int = DOWN_FACTOR
    margin: int = MARGIN
    vicinity: bool = True
    relabel: bool = False  # tumour cells outside the mask become epithelial
    morphology: bool = False
    distances: bool = False
    distance_classes: Sequence[int] = field(default_factory=lambda: list(DISTANCE_CLASSES))
    distance_area: str = "tumour"  # or "margin", the regions grown by their margin, or "slide"


def prepare_mask(mask: DataFrame, down: int = DOWN_FACTOR) -> tuple[DataFrame, DataFrame]:
    """Runs, and size with tumour area, per slide. Both are kept, since the pixel table is the largest
    input and later steps look at it from several sides."""
    profile = mask.groupBy("slide_id").agg(
        (F.max("row") + 1).cast("int").alias("height"),
        (F.max("col") + 1).cast("int").alias("width"),
        (F.count_if(F.col("value") == INSIDE) * F.lit(down * down)).cast("bigint").alias("area"),
    )
    return cut(M.mask_runs(mask)), cut(profile)


def _band(runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame | None:
    frame = profile.select("slide_id", "height", "width")
    return M.border_band(runs, frame, M.band_kernel(cfg.margin, cfg.down)) if cfg.vicinity else None


def population_layers(runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    return C.population_layers(runs, _band(runs, profile, cfg))


def layer_segments(runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    return M.layer_segments(runs, _band(runs, profile, cfg))


def tagged_cells(cells: DataFrame, runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    """Measured cells, each once, with the layers they lie in; outlines are measured in the scan and left there."""
    measured = C.with_measures(cells) if "contour" in cells.columns else cells
    kept = [c for c in ("cell_ord", "cx", "cy", "cell_type", *MEASURES) if c in measured.columns and (c != "cell_ord" or cfg.distances)]
    return C.tag_cells(measured.select("slide_id", *kept), layer_segments(runs, profile, cfg), cfg.relabel, cfg.down)


def counts_side_by_side(tagged: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    """One row per slide with every count and area the catalogue is computed from; a slide without mask has no
    region counts."""
    wide = C.wide_tagged(tagged, TUMOUR_CLASSES, BAND_CLASSES if cfg.vicinity else None)
    joined = wide.join(profile.select("slide_id", "area"), "slide_id", "left")
    regional = [c for c in wide.columns if c[:2] in ("nt", "at", "nb")]
    return joined.withColumns({c: F.when(F.col("area").isNotNull(), F.col(c)) for c in regional})


def _distance_cells(cells: DataFrame, runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    """Cells between which distances are taken, with their region."""
    if cfg.distance_area == "slide":
        return D.whole_slide(cells, cfg.distance_classes)
    if cfg.distance_area not in ("tumour", "margin"):
        raise ValueError(f"distances are taken in the tumour, the margin or the slide, not in {cfg.distance_area}")
    frame = profile.select("slide_id", "height", "width")
    regions = label_regions(runs) if cfg.distance_area == "tumour" else margin_regions(runs, frame, cfg.margin)
    return D.located_cells(cells, regions, cfg.distance_classes, cfg.down)


def tissue_features(cells: DataFrame, mask: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(slide_id, section, grp, feature, path, value) from cells and a dense mask."""
    cfg = settings or Settings()
    runs, profile = prepare_mask(mask, cfg.down)
    return tissue_features_from_runs(cells, runs, profile, cfg)


def tissue_features_from_runs(cells: DataFrame, runs: DataFrame, profile: DataFrame, cfg: Settings) -> DataFrame:
    """Same from foreground runs and (slide_id, height, width, area).

    A slide without mask gets its whole-slide features; its region features are NULL. Cells are read once and looked
    up once; relabelling, whole-slide and region counts follow from that one tagged table.
    """
    band = BAND_CLASSES if cfg.vicinity else None
    tagged = tagged_cells(cells, runs, profile, cfg)
    if cfg.morphology or cfg.distances:
        tagged = cut(tagged)  # read again below
    wide = counts_side_by_side(tagged, profile, cfg)
    out = FT.unfold(
        wide, FT.slide_features() + FT.region_features(cfg.vicinity) + FT.density_features() + FT.share_features()
    )
    if cfg.morphology:
        out = out.unionByName(FT.morphology_features(summarise_tagged(C.by_population(tagged), tagged, TUMOUR_CLASSES, band)))
    if cfg.distances:
        own = tagged.select("slide_id", "cell_ord", "cx", "cy", "cell_type")
        located = cut(_distance_cells(own, runs, profile, cfg))
        nearest = cut(D.nearest_targets(located, cfg.distance_classes, stored=True))
        summary = D.distance_summary(own, located, nearest, cfg.distance_classes)
        out = out.unionByName(FT.distance_features(summary, cfg.distance_classes))
    return out


def class_shares_in_region(cells: DataFrame, mask: DataFrame, down: int = DOWN_FACTOR) -> DataFrame:
    """Count, area and fraction per class of the cells on the mask."""
    measured = C.with_measures(cells)
    counts = C.population_counts(measured, C.population_layers(M.mask_runs(mask)), band_classes=None, down=down)
    total = F.sum("n").over(Window.partitionBy("slide_id"))  # one row per class
    return counts.withColumn("total", total).select(
        "slide_id",
        "cell_type",
        C.class_name(F.col("cell_type")).alias("class_name"),
        "n",
        "area",
        F.try_divide("n", "total").alias("fraction"),
    )
