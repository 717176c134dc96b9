"""Instance segmentation: overlaps, panoptic quality, confusion matrix, class maps.

Pixels are reduced to counts per (tile, truth, prediction) by one partial aggregate; everything after
works on those counts.
"""

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.ordering import positions
from cytolake.runtime import cut


def _check_threshold(threshold: float) -> None:
    if threshold < 0:
        raise ValueError("the IoU threshold must not be negative")


def instance_overlaps(pixels: DataFrame, truth: str = "true_inst", pred: str = "pred_inst") -> DataFrame:
    """Pixels per (tile, truth, prediction), background included: all that the scores need of the pixels."""
    return pixels.groupBy("tile_id", F.col(truth).alias("true_inst"), F.col(pred).alias("pred_inst")).agg(
        F.count("*").alias("n")
    )


def _iou(inter: Column, area_true: Column, area_pred: Column) -> Column:
    return inter / (area_true + area_pred - inter)


def overlap_pairs(overlaps: DataFrame) -> DataFrame:
    """Instance pairs with their intersection over union.

    Areas are window sums over the overlaps of an instance, so pixels are read once. The background, whose area nobody asks
    for, is dealt by its other side: one tile's background may overlap any number of instances.
    """
    area = lambda inst, other: F.sum("n").over(Window.partitionBy("tile_id", inst, F.when(F.col(inst) == 0, F.col(other))))
    return (
        overlaps.withColumn("_at", area("true_inst", "pred_inst"))
        .withColumn("_ap", area("pred_inst", "true_inst"))
        .where("true_inst <> 0 and pred_inst <> 0")
        .select(
            "tile_id",
            "true_inst",
            "pred_inst",
            F.col("n").alias("inter"),
            _iou(F.col("n"), F.col("_at"), F.col("_ap")).alias("iou"),
        )
    )


def iou_pairs(pixels: DataFrame, truth: str = "true_inst", pred: str = "pred_inst") -> DataFrame:
    """Overlapping instance pairs of a pixel table with their intersection over union."""
    return overlap_pairs(instance_overlaps(pixels, truth, pred))


def match_pairs(pairs: DataFrame, threshold: float = 0.5, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One-to-one pairs above the threshold (strictly).

    From 0.5 on, a pair above the threshold excludes every other, so the filter is enough.
    Below, pairs are taken greedily: in each round those that are the best of both their members;
    the rest goes on without the members taken. This gives the best total whenever pairs do not
    compete, and a near-best one otherwise.
    """
    _check_threshold(threshold)
    open_pairs = pairs.where(F.col("iou") > threshold)
    if threshold >= 0.5:
        return open_pairs
    keys = list(keys)
    taken = None
    open_pairs = cut(open_pairs)
    while not open_pairs.isEmpty():
        # a total order, so that every round takes at least the overall best pair
        best = F.struct("iou", (-F.col("true_inst")).alias("t"), (-F.col("pred_inst")).alias("p"))
        ranked = open_pairs.withColumn("_s", best)
        by_truth = ranked.groupBy(*keys, "true_inst").agg(F.max("_s").alias("_bt"))
        by_pred = ranked.groupBy(*keys, "pred_inst").agg(F.max("_s").alias("_bp"))
        won = (
            ranked.join(by_truth, [*keys, "true_inst"])
            .join(by_pred, [*keys, "pred_inst"])
            .where("_s = _bt and _s = _bp")
            .select(*pairs.columns)
        )
        won = cut(won)
        taken = won if taken is None else taken.unionByName(won)
        open_pairs = cut(
            open_pairs.join(won.select(*keys, "true_inst"), [*keys, "true_inst"], "left_anti").join(
                won.select(*keys, "pred_inst"), [*keys, "pred_inst"], "left_anti"
            )
        )
    return taken if taken is not None else pairs.where(F.lit(False))


def best_assignment(pairs: Sequence[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The one-to-one choice of (truth, prediction, worth) with the greatest total.

    Truths join one by one. A new one takes a prediction, its owner another one, and so on, until a free prediction is reached or
    a truth stays alone; the chain that gains most is carried out. Chains follow pairs that exist, so the work hangs on how many
    pairs compete, not on the size of the tile.
    """
    of_truth: dict[int, dict[int, float]] = {}
    for t, p, w in sorted(pairs):
        of_truth.setdefault(t, {})[p] = w
    owner: dict[int, int] = {}
    for start in of_truth:
        gain, via, queue = {start: 0.0}, {}, [start]
        best = (0.0, start, None)  # gain, last truth of the chain, free prediction it takes (none: it stays alone)
        while queue:
            t = queue.pop(0)
            for p, w in of_truth[t].items():
                other, now = owner.get(p), gain[t] + w
                if other is None:
                    best = max(best, (now, t, p), key=lambda x: x[0])
                elif other != t and now - of_truth[other][p] > gain.get(other, -math.inf) + 1e-12:
                    gain[other], via[other] = now - of_truth[other][p], (t, p)
                    queue.append(other)
                    best = max(best, (gain[other], other, None), key=lambda x: x[0])
        _, t, p = best
        if p is not None:
            owner[p] = t
        while t != start:  # whose prediction went to the one before
            t, p = via[t]
            owner[p] = t
    return [(t, p, of_truth[t][p]) for p, t in owner.items()]


def assign_pairs(pairs: DataFrame, threshold: float = 0.0, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One-to-one pairs of the greatest total IoU per tile; of these the ones above the threshold (strictly).

    From 0.5 on they are the pairs above the threshold. Rows are (keys, true_inst, pred_inst, iou); a group is a tile's pairs.
    """
    _check_threshold(threshold)
    keys = list(keys)
    rows = pairs.select(*keys, "true_inst", "pred_inst", "iou")
    if threshold >= 0.5:
        return rows.where(F.col("iou") > threshold)

    def best(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("true_inst", "pred_inst", "iou")]
        chosen = {(t, p) for t, p, _ in best_assignment(list(zip(*columns)))}
        return table.filter(pa.array([(t, p) in chosen for t, p, _ in zip(*columns)], pa.bool_()))

    return rows.groupBy(*keys).applyInArrow(best, rows.schema).where(F.col("iou") > threshold)


def unpaired(pixels: DataFrame, matched: DataFrame) -> DataFrame:
    """Instances without partner: side 'true' are missed, side 'pred' are spurious."""

    def side(inst: str, label: str) -> DataFrame:
        ids = pixels.where(F.col(inst) != 0).select("tile_id", F.col(inst).alias("inst")).distinct()
        used = matched.select("tile_id", F.col(inst).alias("inst"))
        return ids.join(used, ["tile_id", "inst"], "left_anti").select("tile_id", F.lit(label).alias("side"), "inst")

    return side("true_inst", "true").unionByName(side("pred_inst", "pred"))


def _quality(tp: Column, fp: Column, fn: Column, iou_sum: Column) -> tuple[Column, Column]:
    dq = F.try_divide(tp.cast("double"), tp + F.lit(0.5) * fp + F.lit(0.5) * fn)
    return dq, iou_sum / (tp + F.lit(1e-6))


def panoptic_quality(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """DQ, SQ and PQ per tile regardless of class."""
    overlaps = cut(instance_overlaps(pixels))
    pairs = assign_pairs(overlap_pairs(overlaps), threshold)
    hits = pairs.groupBy("tile_id").agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    counts = overlaps.groupBy("tile_id").agg(
        F.countDistinct(F.when(F.col("true_inst") != 0, F.col("true_inst"))).alias("nt"),
        F.countDistinct(F.when(F.col("pred_inst") != 0, F.col("pred_inst"))).alias("np"),
    )
    tp = F.coalesce("tp", F.lit(0))
    dq, sq = _quality(tp, F.col("np") - tp, F.col("nt") - tp, F.coalesce("iou_sum", F.lit(0.0)))
    return counts.join(hits, "tile_id", "left").select(
        "tile_id", dq.alias("dq"), sq.alias("sq"), (dq * sq).alias("pq")
    )


def class_panoptic_quality(pixels: DataFrame, classes: Sequence[int] = (1, 2, 3, 4, 5), threshold: float = 0.5) -> DataFrame:
    """DQ, SQ and PQ per tile and class; all classes in one pass.

    For a class only its own pixels count on either side. A class of the truth the prediction lacks
    scores 0; a class the truth lacks has no score.
    """
    _check_threshold(threshold)
    keys = ["tile_id", "class"]
    # the only look at the pixels
    overlap = cut(
        pixels.groupBy("tile_id", "true_class", "true_inst", "pred_class", "pred_inst").agg(F.count("*").alias("n"))
    )

    def instances(cls: str, inst: str, area: str) -> DataFrame:
        held = overlap.where(F.col(cls).isin(list(classes)))
        return held.groupBy("tile_id", F.col(cls).alias("class"), inst).agg(F.sum("n").alias(area))

    truth, pred = instances("true_class", "true_inst", "_at"), instances("pred_class", "pred_inst", "_ap")
    both = overlap.where(
        (F.col("true_class") == F.col("pred_class")) & (F.col("true_inst") != 0) & (F.col("pred_inst") != 0)
    ).select("tile_id", F.col("true_class").alias("class"), "true_inst", "pred_inst", "n")
    pairs = (
        both.join(truth, [*keys, "true_inst"])
        .join(pred, [*keys, "pred_inst"])
        .select(
            *keys,
            "true_inst",
            "pred_inst",
            _iou(F.col("n"), F.col("_at"), F.col("_ap")).alias("iou"),
        )
    )
    hits = assign_pairs(pairs, threshold, keys).groupBy(*keys).agg(
        F.count("*").alias("tp"), F.sum("iou").alias("iou_sum")
    )
    side = lambda df, inst, n: df.groupBy(*keys).agg(F.count_if(F.col(inst) != 0).alias(n))
    grid = overlap.select("tile_id").distinct().select(
        "tile_id", F.explode(F.array(*[F.lit(c) for c in classes])).alias("class")
    )
    joined = (
        grid.join(side(truth, "true_inst", "nt"), keys, "left")
        .join(side(pred, "pred_inst", "np"), keys, "left")
        .join(hits, keys, "left")
    )
    tp = F.coalesce("tp", F.lit(0))
    dq, sq = _quality(tp, F.col("np") - tp, F.col("nt") - tp, F.coalesce("iou_sum", F.lit(0.0)))
    missed = F.col("nt").isNotNull() & F.col("np").isNull()
    scored = (F.col("nt") > 0) & (F.col("np") > 0)
    value = lambda e: F.when(missed, F.lit(0.0)).when(scored, e)
    return joined.select(*keys, value(dq).alias("dq"), value(sq).alias("sq"), value(dq * sq).alias("pq"))


def mean_panoptic_quality(per_tile: DataFrame) -> DataFrame:
    return per_tile.groupBy("class").agg(F.count("pq").alias("n_tiles"), F.avg("pq").alias("mean_pq"))


def instance_geometry(pixels: DataFrame, inst: str) -> DataFrame:
    """Area, cut mean position and half-open bounding box per instance."""
    return (
        pixels.where(F.col(inst) != 0)
        .groupBy("tile_id", F.col(inst).alias("inst"))
        .agg(
            F.count("*").alias("area"),
            F.floor(F.avg("row")).cast("int").alias("row"),
            F.floor(F.avg("col")).cast("int").alias("col"),
            F.min("row").alias("min_row"),
            F.min("col").alias("min_col"),
            (F.max("row") + 1).alias("max_row"),
            (F.max("col") + 1).alias("max_col"),
        )
    )


def class_at_centroid(pixels: DataFrame, inst: str, cls: str) -> DataFrame:
    """(tile_id, inst, class) with the class of the pixel under the instance's mean position.

    Pixels that are dealt by tile are looked up where they are, as in :func:`stack_layers`; only positions, a row per instance, are
    held, no pixel is sorted.
    """
    pixels.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spots = instance_geometry(pixels, inst).select("tile_id", "inst", "row", "col").hint("shuffle_hash")
    under = pixels.select("tile_id", "row", "col", F.col(cls).alias("class"))
    return spots.join(under, ["tile_id", "row", "col"]).select("tile_id", "inst", "class")


def paired_classes(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Centroid classes of matched instances; pairs with a background class are left out."""
    pairs = assign_pairs(iou_pairs(pixels), threshold).select("tile_id", "true_inst", "pred_inst")
    named = lambda inst, cls, out: class_at_centroid(pixels, inst, cls).select(
        "tile_id", F.col("inst").alias(inst), F.col("class").alias(out)
    )
    return (
        pairs.join(named("true_inst", "true_class", "t"), ["tile_id", "true_inst"])
        .join(named("pred_inst", "pred_class", "p"), ["tile_id", "pred_inst"])
        .where("t <> 0 and p <> 0")
        .select("tile_id", "true_inst", "pred_inst", "t", "p")
    )


def confusion_matrix(labels: DataFrame) -> DataFrame:
    """Truth ``t`` x prediction ``p``: count, row and column shares, and ``"n (p%)"`` texts.

    All labels seen on either side make up the matrix; it has one row per label pair, so the
    windows run over a handful of rows.
    """
    counts = cut(labels.groupBy("t", "p").agg(F.count("*").alias("n")))  # read twice
    seen = counts.select(F.explode(F.array("t", "p")).alias("c")).distinct().agg(F.sort_array(F.collect_set("c")).alias("cs"))
    grid = seen.select(F.explode("cs").alias("t"), "cs").select("t", F.explode("cs").alias("p"))
    full = grid.join(counts, ["t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = lambda by: F.coalesce(
        F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(by))), F.lit(0.0)
    )
    text = lambda c: F.format_string("%d (%.2f%%)", F.col("n"), F.col(c) * 100)
    out = full.withColumn("of_truth", share("t")).withColumn("of_pred", share("p"))
    return out.withColumn("truth_text", text("of_truth")).withColumn("pred_text", text("of_pred"))


def cell_counts(pixels: DataFrame, inst: str = "true_inst", cls: str = "true_class") -> DataFrame:
    """Instances per image and class with class totals and the grand total (NULL = all)."""
    named = class_at_centroid(pixels, inst, cls).where(F.col("class") != 0)
    return (
        named.groupBy("tile_id", "class")
        .agg(F.count("*").alias("n"))
        .groupingSets([[F.col("tile_id"), F.col("class")], [F.col("class")], []], "tile_id", "class")
        .agg(F.sum("n").alias("n"))
    )


def image_class_counts(pixels: DataFrame, inst: str = "true_inst", cls: str = "true_class") -> DataFrame:
    named = class_at_centroid(pixels, inst, cls).where(F.col("class") != 0)
    return named.groupBy("tile_id", "class").agg(F.count("*").alias("n"))


def class_map_from_vector(pixels: DataFrame, inst: str, classes: DataFrame) -> DataFrame:
    """Pixel class from a per-tile instance -> class table; background stays 0."""
    named = classes.select("tile_id", F.col("inst").alias(inst), F.col("class").alias("_c"))
    return (
        pixels.join(named, ["tile_id", inst], "left")
        .withColumn("class_map", F.when(F.col(inst) == 0, F.lit(0)).otherwise(F.col("_c")))
        .drop("_c")
    )


def per_class_instances(pixels: DataFrame, inst: str, cls: str, classes: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """Instance maps restricted to one class each, kept sparse: pixels of other classes would be 0."""
    return pixels.where(F.col(cls).isin(list(classes)) & (F.col(inst) != 0)).select(
        "tile_id", "row", "col", F.col(cls).alias("class"), F.col(inst).alias("inst")
    )


def majority_class(pixels: DataFrame, inst: str = "pred_inst", cls: str = "true_class") -> DataFrame:
    """Class of each instance: the most frequent non-background class among its pixels, on a tie the one
    met first in raster order; without any, the tile's most frequent class (smallest on a tie)."""
    # one row per (instance, class) is all that is needed of the pixels
    tally = cut(
        pixels.where((F.col(inst) != 0) | (F.col(cls) != 0))
        .groupBy("tile_id", F.col(inst).alias("inst"), F.col(cls).alias("class"))
        .agg(F.count("*").alias("n"), F.min(F.struct("row", "col")).alias("first"))
    )
    classed = tally.where("class <> 0")
    first = F.struct((-F.col("first.row")).alias("r"), (-F.col("first.col")).alias("c"))
    best = (
        classed.where("inst <> 0")
        .groupBy("tile_id", "inst")
        .agg(F.max_by("class", F.struct("n", first.alias("f"))).alias("_own"))
    )
    tile_votes = classed.groupBy("tile_id", "class").agg(F.sum("n").alias("n"))
    dominant = tile_votes.groupBy("tile_id").agg(
        F.max_by("class", F.struct("n", (-F.col("class")).alias("c"))).alias("_tile")
    )
    ids = tally.where("inst <> 0").select("tile_id", "inst").distinct()
    return (
        ids.join(best, ["tile_id", "inst"], "left")
        .join(dominant, "tile_id", "left")
        .select("tile_id", "inst", F.coalesce("_own", "_tile").alias("class"))
    )


def layers_from_channels(channels: DataFrame, background: int) -> DataFrame:
    """Instance and type layer from one instance mask per class channel.

    Input (tile_id, row, col, channel, value). The background channel is skipped, a later channel
    overwrites an earlier one; afterwards values equal to 1 become 0 in both layers.
    """
    used = (F.col("value") != 0) & (F.col("channel") < background)
    layer = channels.groupBy("tile_id", "row", "col").agg(
        F.coalesce(F.max_by(F.when(used, F.col("value")), F.when(used, F.col("channel"))), F.lit(0)).alias("inst"),
        F.coalesce(F.max(F.when(used, F.col("channel") + 1)), F.lit(0)).alias("type"),
    )
    clear = lambda c: F.when(F.col(c) == 1, F.lit(0)).otherwise(F.col(c)).alias(c)
    return layer.select("tile_id", "row", "col", clear("inst"), clear("type"))


def stack_layers(rgb: DataFrame, instances: DataFrame, classes: DataFrame) -> DataFrame:
    """Training rows: colour, instance and class of every pixel all three layers have.

    Layers that are dealt by tile into equally many partitions are joined where they are: without the setting a join by pixel
    would deal all pixels again.
    """
    at = ["tile_id", "row", "col"]
    rgb.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return rgb.join(instances, at).join(classes, at)


def grouped_labels(pixels: DataFrame) -> DataFrame:
    """(tile_id, inst_map, type_map) of (tile_id, row, col, inst, type): both layers of a tile as arrays of rows, in order.

    A row is put together first, so no more than a tile's rows meet in the last step.
    """
    cells = F.sort_array(F.collect_list(F.struct("col", "inst", "type")))
    lines = pixels.groupBy("tile_id", "row").agg(cells.alias("cells")).select(
        "tile_id", F.struct("row", F.transform("cells", lambda c: c["inst"]).alias("inst"), F.transform("cells", lambda c: c["type"]).alias("type")).alias("line")
    )
    whole = lines.groupBy("tile_id").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    layer = lambda c: F.transform("lines", lambda x: x[c])
    return whole.select("tile_id", layer("inst").alias("inst_map"), layer("type").alias("type_map"))


def grouped_pixels(grouped: DataFrame) -> DataFrame:
    """(tile_id, row, col, inst, type) of :func:`grouped_labels`; rows and columns count from 0."""
    lines = grouped.select("tile_id", F.posexplode(F.arrays_zip("inst_map", "type_map")).alias("row", "line"))
    cells = lines.select("tile_id", "row", F.posexplode(F.arrays_zip("line.inst_map", "line.type_map")).alias("col", "cell"))
    return cells.select("tile_id", "row", "col", F.col("cell.inst_map").alias("inst"), F.col("cell.type_map").alias("type"))


def remap_labels(ids: DataFrame, by_size: bool = False) -> DataFrame:
    """Contiguous ids per tile from (tile_id, inst, area), by old id or by area descending; 0 is not listed.

    The rows are instances, one tile's worth per window.
    """
    order = [F.col("area").desc(), F.col("inst")] if by_size else [F.col("inst")]
    w = Window.partitionBy("tile_id").orderBy(*order)
    return ids.where(F.col("inst") != 0).select("tile_id", "inst", F.row_number().over(w).alias("new_inst"))


def relabel_global(ids: DataFrame) -> DataFrame:
    """Contiguous ids over all distinct values of one large map (inst), however many there are."""
    return positions(ids.where(F.col("inst") != 0).select("inst").distinct(), [], "inst", "new_inst")
