"""Nearest-neighbour distances between cell classes of one region.

A region may hold millions of cells, so no plan here pairs all sources with all targets. Regions of few cells are
searched whole, one after the other, by the tasks they are dealt to. Of larger ones both sides are reduced to distinct
positions and summarised in a pyramid of grid squares with tight bounding boxes. Starting at the coarsest squares, pairs of squares are refined level by level and a
target square is dropped once its best case is worse than another square's worst case. Only
surviving leaf squares, which hold a bounded number of distinct positions, meet point by point.
The result is exact whatever the density.
"""

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions import geometry as G
from cytolake.functions.joins import counted_side
from cytolake.functions.ordering import last_value_before
from cytolake.functions.summary import STATS, distribution_summary
from cytolake.operators.cells import lookup_runs
from cytolake.operators.regions import region_boxes
from cytolake.runtime import cut
from cytolake.schema import DISTANCE_CLASSES, DOWN_FACTOR

LEAF_BITS = 5  # leaf squares of 32 px
STEP_BITS = 2  # each level is 4 times coarser

#: cells of a region that a task compares with each other directly, and pairs it holds at once
DIRECT = 4096
PAIRS = 1 << 20

_G = ["slide_id", "region_id"]
_TRUNC = ["x0", "x1", "y0", "y1"]
_RAW = ["rx0", "rx1", "ry0", "ry1"]


def class_pairs(classes: Sequence[int]) -> list[tuple[int, int]]:
    """Directed pairs: the lower class code is the source."""
    ordered = sorted(set(classes))
    return [(s, t) for i, s in enumerate(ordered) for t in ordered[i + 1 :]]


def located_cells(
    cells: DataFrame, regions: DataFrame, classes: Sequence[int] = DISTANCE_CLASSES, down: int = DOWN_FACTOR
) -> DataFrame:
    """Cells of the wanted classes with the region under them; outlines are not carried."""
    lean = cells.where(F.col("cell_type").isin(list(classes))).select(
        "slide_id", "cell_ord", "cx", "cy", "cell_type"
    )
    return lookup_runs(lean, regions.select("slide_id", "row", "c0", "c1", "region_id"), "inner", down).drop("row", "col")


def whole_slide(cells: DataFrame, classes: Sequence[int] = DISTANCE_CLASSES) -> DataFrame:
    """All cells of the wanted classes as those of one region, without a mask."""
    wanted = cells.where(F.col("cell_type").isin(list(classes)))
    return wanted.select("slide_id", "cell_ord", "cx", "cy", "cell_type", F.lit(1).alias("region_id"))


def search_boxes(regions: DataFrame, down: int = DOWN_FACTOR, step: float = 0.05) -> DataFrame:
    """Step of the expanding search box per region: a share of the region's bounding box."""
    return region_boxes(regions).select(
        *_G,
        ((F.col("max_col") - F.col("min_col")) * F.lit(step * down)).alias("step_x"),
        ((F.col("max_row") - F.col("min_row")) * F.lit(step * down)).alias("step_y"),
    )


def _steps(dx: Column, dy: Column, box: bool) -> Column:
    """Which expansion of the search box reaches this offset; constant for the exact search."""
    if not box:
        return F.lit(1).cast("bigint")
    ratio = F.greatest(F.abs(dx) / F.col("step_x"), F.abs(dy) / F.col("step_y"))
    return F.greatest(F.ceil(F.round(ratio, 9)), F.lit(1)).cast("bigint")


def _leaves(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys, "gx", "gy").agg(
        F.min("x").alias("x0"),
        F.max("x").alias("x1"),
        F.min("y").alias("y0"),
        F.max("y").alias("y1"),
        F.min("rx").alias("rx0"),
        F.max("rx").alias("rx1"),
        F.min("ry").alias("ry0"),
        F.max("ry").alias("ry1"),
    )


def _coarser(squares: DataFrame, keys: list[str]) -> DataFrame:
    up = lambda c: F.shiftright(F.col(c), STEP_BITS).alias(c)
    low = [F.min(c).alias(c) for c in _TRUNC + _RAW if c.endswith("0")]
    high = [F.max(c).alias(c) for c in _TRUNC + _RAW if c.endswith("1")]
    return squares.groupBy(*keys, up("gx"), up("gy")).agg(*low, *high)


def _named(squares: DataFrame, side: str, keys: list[str], parent: bool) -> DataFrame:
    """Prefix the square's columns by its side; ``parent`` adds the square it came from."""
    cols = [F.col(c).alias(f"{side}_{c}") for c in ["gx", "gy", *_TRUNC, *_RAW]]
    up = (
        [F.shiftright(F.col(c), STEP_BITS).alias(f"{side}_up_{c}") for c in ("gx", "gy")] if parent else []
    )
    return squares.select(*keys, *cols, *up)


def _prune(pairs: DataFrame, box: bool) -> DataFrame:
    """Drop target squares whose best case loses to the worst case of another square."""
    c = F.col
    near = lambda s0, s1, t0, t1: F.greatest(F.lit(0), c(s0) - c(t1), c(t0) - c(s1))
    far = lambda s0, s1, t0, t1: F.greatest(c(s1) - c(t0), c(t1) - c(s0))
    sides = lambda a, r: [(f"s_{r}{a}0", f"s_{r}{a}1", f"t_{a}0", f"t_{a}1")]
    (tx,), (ty,) = sides("x", ""), sides("y", "")
    (rx,), (ry,) = sides("x", "r"), sides("y", "r")
    sq = lambda dx, dy: dx * dx + dy * dy
    best = F.struct(_steps(near(*rx), near(*ry), box).alias("m"), sq(near(*tx), near(*ty)).alias("d2"))
    worst = F.struct(_steps(far(*rx), far(*ry), box).alias("m"), sq(far(*tx), far(*ty)).alias("d2"))
    rivals = Window.partitionBy(*_G, "source", "target", "s_gx", "s_gy")
    return (
        pairs.withColumn("_best", best)
        .withColumn("_limit", F.min(worst).over(rivals))
        .where("_best <= _limit")
        .drop("_best", "_limit")
    )


def _positions(located: DataFrame, box: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct source and target positions; copies of one position are searched once.

    Sources keep the raw centroid only for the box search, whose edges start from it.
    """
    x, y = G.truncated(F.col("cx")), G.truncated(F.col("cy"))
    square = [F.shiftright(F.col(c), LEAF_BITS).alias(g) for c, g in (("x", "gx"), ("y", "gy"))]
    targets = located.select(*_G, F.col("cell_type").alias("target"), x.alias("x"), y.alias("y")).distinct()
    targets = targets.select("*", F.col("x").alias("rx"), F.col("y").alias("ry"), *square)
    raw = [F.col("cx").alias("rx"), F.col("cy").alias("ry")] if box else [x.alias("rx"), y.alias("ry")]
    steps = ["step_x", "step_y"] if box else []
    sources = located.select(
        *_G, F.col("cell_type").alias("source"), x.alias("x"), y.alias("y"), *raw, *steps
    ).distinct()
    return sources.select("*", *square), targets


def _region_search(classes: Sequence[int], box: bool) -> Callable[[pa.Table], pa.Table]:
    """The nearest targets of one region's cells ``(cell_ord, cell_type, x, y)``, with ``rx, ry, step_x, step_y`` by boxes."""
    ordered = sorted(set(classes))

    def search(region: pa.Table) -> pa.Table:
        column = lambda name: region.column(name).to_numpy()
        kind, x, y = column("cell_type"), column("x"), column("y")
        order = np.argsort(kind, kind="stable")
        starts = np.searchsorted(kind[order], [*ordered, ordered[-1] + 1])
        held = [(c, a, b) for c, a, b in zip(ordered, starts, starts[1:]) if a < b]
        found = []
        for i, (_, first, last) in enumerate(held[:-1]):
            begin = held[i + 1][1]
            others, sides = order[begin:], [a - begin for _, a, _ in held[i + 1 :]]
            step = max(1, PAIRS // len(others))
            for at in range(first, last, step):
                own = order[at : min(at + step, last)]
                dx, dy = x[own, None] - x[others], y[own, None] - y[others]
                d2 = dx * dx + dy * dy
                if box:
                    reach = [np.abs(column(r)[own, None] - t[others]) / column(s)[0] for r, t, s in (("rx", x, "step_x"), ("ry", y, "step_y"))]
                    # the ratio is rounded up once it is rounded to nine decimals
                    m = np.maximum(np.floor(np.maximum(*reach) - 5e-10) + 1, 1)
                    least = np.minimum.reduceat(m, sides, axis=1)
                    widths = np.diff([*sides, len(others)])
                    d2 = np.where(m == np.repeat(least, widths, axis=1), d2, np.iinfo(np.int64).max)
                best = np.minimum.reduceat(d2, sides, axis=1)
                found.append((np.repeat(own, len(sides)), np.tile([c for c, _, _ in held[i + 1 :]], len(own)), best.ravel()))
        rows, target, best = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        answer = region.select([*_G, "cell_ord", "cell_type"]).take(pa.array(rows))
        answer = answer.rename_columns([*_G, "cell_ord", "source"])
        answer = answer.append_column("target", pa.array(target, pa.int32()))
        return answer.append_column("dist", pa.array(np.sqrt(best.astype(float)), pa.float64()))

    return search


def _nearest_direct(located: DataFrame, classes: Sequence[int], box: bool) -> DataFrame:
    """Answers of regions that hold at most ``DIRECT`` cells each: one shuffle by region."""
    raw = ["cx as rx", "cy as ry", "step_x", "step_y"] if box else []
    lean = located.select(
        *_G, "cell_ord", F.col("cell_type").cast("int").alias("cell_type"), G.truncated(F.col("cx")).alias("x"), G.truncated(F.col("cy")).alias("y"),
        *[F.expr(c) for c in raw],
    )
    kinds = dict(lean.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*_G, "cell_ord"]) + ", source int, target int, dist double"
    return lean.groupBy(*_G).applyInArrow(_region_search(classes, box), schema)


def nearest_targets(
    located: DataFrame,
    classes: Sequence[int] = DISTANCE_CLASSES,
    boxes: DataFrame | None = None,
    stored: bool = False,
    direct: int = DIRECT,
) -> DataFrame:
    """Nearest cell of each higher class in the same region, one row per source cell and target class.

    Without ``boxes`` the true nearest distance. With ``boxes`` (see :func:`search_boxes`) the answer
    of an expanding-box search: the nearest target within the first box that holds any.
    Sources without a target in their region have no row; cells without a position or region play no part. ``classes`` limits both roles. ``stored`` says that ``located`` is
    a checkpoint or a table already, which is not written once more. Regions of up to ``direct`` cells are searched whole.
    """
    box = boxes is not None
    chosen = located.where(F.col("cell_type").isin(list(classes))).dropna(subset=[*_G, "cx", "cy"])
    # both roles and the final answer start from these rows
    located = chosen if stored and not box else cut(chosen.join(boxes, _G) if box else chosen)
    sizes = located.groupBy(*_G).agg(F.count(F.lit(1)).alias("_cells"))
    largest = sizes.agg(F.max("_cells")).first()[0] or 0
    if largest <= direct:
        return _nearest_direct(located, classes, box)
    crowded = cut(sizes.where(F.col("_cells") > direct).drop("_cells"))
    rows = crowded.count()
    small = located.join(counted_side(crowded, rows), _G, "left_anti")
    large = cut(located.join(counted_side(crowded, rows), _G, "left_semi"))
    return _nearest_direct(small, classes, box).unionByName(_nearest_by_squares(large, box))


def _nearest_by_squares(located: DataFrame, box: bool) -> DataFrame:
    """The same of regions of any size, from stored rows."""
    sources, targets = _positions(located, box)
    reach = targets.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 0
    levels = 0
    while (reach >> (LEAF_BITS + STEP_BITS * levels)) > 3:
        levels += 1

    s_keys = [*_G, "source"] + (["step_x", "step_y"] if box else [])
    t_keys = [*_G, "target"]
    s_pyramid, t_pyramid = [_leaves(sources, s_keys)], [_leaves(targets, t_keys)]
    for _ in range(levels):
        s_pyramid.append(_coarser(s_pyramid[-1], s_keys))
        t_pyramid.append(_coarser(t_pyramid[-1], t_keys))

    # the coarsest squares number at most 8 x 8 per class and region
    frontier = (
        _named(s_pyramid[levels], "s", s_keys, False)
        .join(_named(t_pyramid[levels], "t", t_keys, False), _G)
        .where("source < target")
    )
    frontier = _prune(frontier, box)
    for level in range(levels - 1, -1, -1):
        held = frontier.select(
            *s_keys,
            "target",
            *[F.col(f"{side}_{g}").alias(f"{side}_up_{g}") for side in "st" for g in ("gx", "gy")],
        )
        finer_s = _named(s_pyramid[level], "s", s_keys, True)
        finer_t = _named(t_pyramid[level], "t", t_keys, True)
        frontier = _prune(
            held.join(finer_t, [*t_keys, "t_up_gx", "t_up_gy"])
            .join(finer_s, [*s_keys, "s_up_gx", "s_up_gy"])
            .drop("s_up_gx", "s_up_gy", "t_up_gx", "t_up_gy"),
            box,
        )

    leaf_pairs = frontier.select(*s_keys, "target", "s_gx", "s_gy", "t_gx", "t_gy")
    s_points = sources.select(
        *s_keys, F.col("gx").alias("s_gx"), F.col("gy").alias("s_gy"), "x", "y", "rx", "ry"
    )
    t_points = targets.select(
        *t_keys, F.col("gx").alias("t_gx"), F.col("gy").alias("t_gy"), F.col("x").alias("tx"), F.col("y").alias("ty")
    )
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    met = leaf_pairs.join(t_points, [*t_keys, "t_gx", "t_gy"]).join(s_points, [*s_keys, "s_gx", "s_gy"])
    answer = F.struct(
        _steps(F.col("rx") - F.col("tx"), F.col("ry") - F.col("ty"), box).alias("m"),
        (dx * dx + dy * dy).alias("d2"),
    )
    nearest = (
        met.groupBy(*_G, "source", "target", "rx", "ry")
        .agg(F.min(answer).alias("a"))
        .select(*_G, F.col("source").alias("cell_type"), "target", "rx", "ry", F.sqrt(F.col("a.d2").cast("double")).alias("dist"))
    )
    key = [F.col("cx").alias("rx"), F.col("cy").alias("ry")] if box else [
        G.truncated(F.col("cx")).alias("rx"),
        G.truncated(F.col("cy")).alias("ry"),
    ]
    each = located.select(*_G, "cell_ord", "cell_type", *key)
    return each.join(nearest, [*_G, "cell_type", "rx", "ry"]).select(
        *_G, "cell_ord", F.col("cell_type").alias("source"), "target", "dist"
    )


def carried_distances(located: DataFrame, nearest: DataFrame, classes: Sequence[int] = DISTANCE_CLASSES) -> DataFrame:
    """Distances with the carry-over of a search loop that never resets its last minimum.

    A source without target repeats the previous source's distance (by ``cell_ord``); zero distances are
    dropped. Pairs of which one class is absent from the slide have no rows.
    """
    held = F.array(*[F.lit(c) for c in sorted(set(classes))])
    each = located.select(
        "slide_id",
        "region_id",
        "cell_ord",
        F.col("cell_type").alias("source"),
        F.explode(F.filter(held, lambda t: t > F.col("cell_type"))).alias("target"),
    )
    joined = each.join(nearest, ["slide_id", "region_id", "cell_ord", "source", "target"], "left")
    present = located.select("slide_id", F.col("cell_type").alias("target")).distinct()
    joined = cut(joined.join(present, ["slide_id", "target"], "left_semi"))
    carried = last_value_before(joined, ["slide_id", "source", "target"], "cell_ord", "dist", "carried")
    return carried.where("carried > 0").select(
        "slide_id", "region_id", "cell_ord", "source", "target", F.col("carried").alias("dist")
    )


def distance_summary(
    slides: DataFrame, located: DataFrame, nearest: DataFrame, classes: Sequence[int] = DISTANCE_CLASSES
) -> DataFrame:
    """Seven statistics per slide and class pair.

    A pair with an absent class is all 0; a pair whose classes never share a region is NULL.
    """
    keys = ["slide_id", "source", "target"]
    stats = distribution_summary(nearest, keys, "dist")
    rows = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("target")) for s, t in class_pairs(classes)])
    seen = located.groupBy("slide_id").agg(
        *[F.max(F.col("cell_type") == c).alias(f"has_{c}") for c in sorted(set(classes))]
    )
    has = F.array(*[F.when(F.col(f"has_{c}"), F.lit(c)) for c in sorted(set(classes))])
    grid = (
        slides.select("slide_id")
        .distinct()
        .join(seen.select("slide_id", F.array_compact(has).alias("held")), "slide_id", "left")
        .select("slide_id", "held", F.explode(rows).alias("r"))
        .select("slide_id", "held", "r.source", "r.target")
    )
    held = F.coalesce("held", F.array().cast("array<int>"))
    absent = ~(F.array_contains(held, F.col("source")) & F.array_contains(held, F.col("target")))
    return grid.join(stats, keys, "left").select(
        *keys,
        F.coalesce("n", F.lit(0)).alias("n"),
        *[F.when(absent, F.lit(0.0)).otherwise(F.col(s)).alias(s) for s in STATS],
    )


def mean_distances(nearest: DataFrame) -> DataFrame:
    return nearest.groupBy("slide_id", "source", "target").agg(
        F.count("*").alias("n"), F.avg("dist").alias("mean_dist")
    )
