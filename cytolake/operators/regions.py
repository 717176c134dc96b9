"""Connected regions of a mask."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytolake.functions.graph import connected_components
from cytolake.operators.mask import dilate
from cytolake.runtime import cut

# runs are cut at multiples of this many columns wherever they meet something by equi join
BLOCK = 256

# image rows labelled together
STRIP = 64

# node id of a run: row in the high bits, first column in the low bits (raster order)
_ROW_SHIFT = 31


def blocks(c0, c1):
    """Column blocks a run touches."""
    return F.sequence(F.floor(c0 / F.lit(BLOCK)).cast("int"), F.floor(c1 / F.lit(BLOCK)).cast("int"))


def _label(runs: pd.DataFrame) -> pd.DataFrame:
    """Local components of whole strips (sorted): smallest node id of each run's component."""
    strip, row, c0, c1 = (runs[c].to_numpy(dtype=np.int64) for c in ("_strip", "row", "c0", "c1"))
    slide = runs["slide_id"].to_numpy()
    fresh = np.append(True, (strip[1:] != strip[:-1]) | (slide[1:] != slide[:-1]))
    # one line number per (strip, row), a spare one between strips so that they never touch
    line = (np.cumsum(fresh) * (STRIP + 1) + row % STRIP) << _ROW_SHIFT
    # runs are disjoint, so their starts and their ends are both sorted
    above = line - (1 << _ROW_SHIFT)
    first = np.searchsorted(line + c1, above + c0 - 1, side="left")
    n = np.maximum(np.searchsorted(line + c0, above + c1 + 1, side="right") - first, 0)
    v = np.repeat(np.arange(len(row)), n)
    u = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = np.arange(len(row))
    while True:
        before = root.copy()
        low = np.minimum(root[u], root[v])
        # hook the roots of both ends onto the smaller one, then shorten all chains
        np.minimum.at(root, before[u], low)
        np.minimum.at(root, before[v], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            break
    return runs.assign(_local=runs["_id"].to_numpy()[root])


def _label_strips(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Label sorted batches; the strip a batch ends in waits for its remaining runs."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pd.concat([held, batch], ignore_index=True)
        last = batch.iloc[-1]
        tail = (batch["slide_id"] == last["slide_id"]) & (batch["_strip"] == last["_strip"])
        held = batch[tail]
        if not tail.all():
            yield _label(batch[~tail])
    if held is not None:
        yield _label(held)


def label_regions(runs: DataFrame) -> DataFrame:
    """8-connected regions: ``runs`` with ``region_id`` 1.. in raster order of first pixels.

    Nodes are runs, not pixels; runs of adjacent rows touch when their columns overlap or meet
    diagonally. An image is cut into strips of ``STRIP`` rows, whose size is bounded by the image width, and
    each strip is labelled by itself. Only contacts across strip borders go through the distributed
    component search, on a graph about ``STRIP`` times smaller and shallower.
    """
    nodes = runs.select(
        "slide_id",
        F.floor(F.col("row") / F.lit(STRIP)).cast("int").alias("_strip"),
        "row",
        "c0",
        "c1",
        (F.shiftleft(F.col("row").cast("bigint"), _ROW_SHIFT) + F.col("c0")).alias("_id"),
    )
    schema = T.StructType(nodes.schema.fields + [T.StructField("_local", T.LongType())])
    # a fixed number of tasks: the work per byte is too high for tasks to be merged by size
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = nodes.repartition(tasks, "slide_id", "_strip").sortWithinPartitions("slide_id", "_strip", "_id")
    local = cut(sorted_runs.mapInPandas(_label_strips, schema))
    upper = local.where(F.pmod("row", F.lit(STRIP)) == STRIP - 1).select(
        "slide_id",
        (F.col("row") + 1).alias("row"),
        F.explode(blocks(F.greatest(F.col("c0") - 1, F.lit(0)), F.col("c1") + 1)).alias("_blk"),
        F.col("c0").alias("_u0"),
        F.col("c1").alias("_u1"),
        F.col("_local").alias("_up"),
    )
    lower = local.where(F.pmod("row", F.lit(STRIP)) == 0).select(
        "slide_id", "row", F.explode(blocks(F.col("c0"), F.col("c1"))).alias("_blk"), "c0", "c1", "_local"
    )
    touching = lower.join(upper, ["slide_id", "row", "_blk"]).where("_u0 <= c1 + 1 and _u1 >= c0 - 1")
    edges = touching.select(
        F.struct("slide_id", F.col("_local").alias("id")).alias("u"),
        F.struct("slide_id", F.col("_up").alias("id")).alias("v"),
    )
    roots = connected_components(edges).select(
        F.col("node.slide_id").alias("slide_id"), F.col("node.id").alias("_local"), F.col("root.id").alias("_root")
    )
    parts = local.select("slide_id", "_local").distinct().join(roots, ["slide_id", "_local"], "left")
    parts = parts.withColumn("_root", F.coalesce("_root", "_local"))
    # only one row per strip component reaches this window
    order = Window.partitionBy("slide_id").orderBy("_root")
    ids = parts.withColumn("region_id", F.dense_rank().over(order)).drop("_root")
    return local.join(ids, ["slide_id", "_local"]).select("slide_id", "row", "c0", "c1", "region_id")


def region_boxes(regions: DataFrame) -> DataFrame:
    """Half-open bounding box and pixel count per region, in mask pixels."""
    return regions.groupBy("slide_id", "region_id").agg(
        F.min("row").alias("min_row"),
        F.min("c0").alias("min_col"),
        (F.max("row") + 1).alias("max_row"),
        (F.max("c1") + 1).alias("max_col"),
        F.sum(F.col("c1") - F.col("c0") + 1).alias("n_pixels"),
    )


def margin_regions(runs: DataFrame, frame: DataFrame, margin: int) -> DataFrame:
    """Regions of the mask grown by its margin: the kernel is half the margin in mask pixels, not down-scaled, and regions that meet
    become one."""
    return label_regions(dilate(runs, frame, int(margin / 2)))
