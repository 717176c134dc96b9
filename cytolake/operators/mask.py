"""Mask algebra on run-length rows.

A mask has about as many pixels as a slide has cells, but only a few runs per image row.
All mask operators therefore work on ``runs(slide_id, row, c0, c1)``; pixels are
folded into runs once. Every step is keyed by (slide_id, row), so one large slide spreads over
as many tasks as it has image rows.
"""

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.schema import DOWN_FACTOR, INSIDE, MARGIN

_ROW = ["slide_id", "row"]


def remap_pixels(mask: DataFrame, old: Sequence[int] = (1, 2), new: Sequence[int] = (0, 255)) -> DataFrame:
    """Replace pixel values simultaneously: tests always see the original value."""
    if len(old) != len(new):
        raise ValueError("old and new values must pair up")
    value = F.col("value")
    out = None
    for o, n in reversed(list(zip(old, new))):  # of repeated old values the last pair wins
        hit = value == F.lit(o)
        out = F.when(hit, F.lit(n)) if out is None else out.when(hit, F.lit(n))
    return mask if out is None else mask.withColumn("value", out.otherwise(value).cast("int"))


def pixel_area(mask: DataFrame, value: int = INSIDE, down: int = DOWN_FACTOR) -> DataFrame:
    """Area of ``value`` per slide, in slide pixels."""
    return mask.groupBy("slide_id").agg(
        (F.count_if(F.col("value") == value) * F.lit(down * down)).cast("bigint").alias("area")
    )


def runs_area(runs: DataFrame, down: int = DOWN_FACTOR) -> DataFrame:
    return runs.groupBy("slide_id").agg(
        (F.sum(F.col("c1") - F.col("c0") + 1) * F.lit(down * down)).cast("bigint").alias("area")
    )


def mask_frame(mask: DataFrame) -> DataFrame:
    """Image size per slide of a dense pixel table."""
    return mask.groupBy("slide_id").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )


def mask_runs(mask: DataFrame, value: int | None = INSIDE) -> DataFrame:
    """Maximal horizontal runs of ``value`` (``None``: of any non-zero pixel)."""
    hit = F.col("value") != 0 if value is None else F.col("value") == value
    w = Window.partitionBy(*_ROW).orderBy("col")
    return (
        mask.where(hit)
        .select(*_ROW, "col")
        .withColumn("_island", F.col("col") - F.row_number().over(w))
        .groupBy(*_ROW, "_island")
        .agg(F.min("col").cast("int").alias("c0"), F.max("col").cast("int").alias("c1"))
        .drop("_island")
    )


def run_pixels(runs: DataFrame) -> DataFrame:
    """Foreground pixels of runs."""
    keep = [c for c in runs.columns if c not in ("c0", "c1")]
    return runs.select(*keep, F.explode(F.sequence("c0", "c1")).alias("col"))


def covered(runs: DataFrame, depth: int = 1) -> DataFrame:
    """Runs of pixels that at least ``depth`` input runs cover, by a sweep over run ends."""
    ends = runs.select(
        *_ROW,
        F.explode(
            F.array(
                F.struct(F.col("c0").alias("pos"), F.lit(1).alias("step")),
                F.struct((F.col("c1") + 1).alias("pos"), F.lit(-1).alias("step")),
            )
        ).alias("e"),
    ).select(*_ROW, "e.pos", "e.step")
    # openings come first at equal positions, so touching runs merge
    w = Window.partitionBy(*_ROW).orderBy(F.col("pos"), F.col("step").desc())
    total = F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0))
    crossing = (
        ends.withColumn("_now", total)
        .withColumn("_was", F.col("_now") - F.col("step"))
        .where(((F.col("_now") >= depth) != (F.col("_was") >= depth)))
    )
    return (
        crossing.withColumn("c1", F.lead("pos").over(w) - 1)
        .where((F.col("step") > 0) & (F.col("c1") >= F.col("pos")))
        .select(*_ROW, F.col("pos").cast("int").alias("c0"), F.col("c1").cast("int").alias("c1"))
    )


def layer_segments(tumour: DataFrame, band: DataFrame | None = None) -> DataFrame:
    """Disjoint runs ``(slide_id, row, c0, c1, in_tumour, in_band)`` of the pixels in at least one layer.

    Every pixel lies in one run at most, so a lookup gives one row per cell with all it needs to know.
    """

    def ends(runs: DataFrame, tumour_step: int, band_step: int) -> DataFrame:
        spots = F.array(
            F.struct(F.col("c0").alias("pos"), F.lit(1).alias("step")), F.struct((F.col("c1") + 1).alias("pos"), F.lit(-1).alias("step"))
        )
        return runs.select(*_ROW, F.explode(spots).alias("e")).select(
            *_ROW, "e.pos", (F.col("e.step") * tumour_step).alias("t"), (F.col("e.step") * band_step).alias("b")
        )

    every = ends(tumour, 1, 0) if band is None else ends(tumour, 1, 0).unionByName(ends(band, 0, 1))
    spots = every.groupBy(*_ROW, "pos").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    w = Window.partitionBy(*_ROW).orderBy("pos")  # one image row
    until = w.rowsBetween(Window.unboundedPreceding, 0)
    return (
        spots.select(
            *_ROW, F.col("pos").cast("int").alias("c0"), (F.lead("pos").over(w) - 1).cast("int").alias("c1"),
            (F.sum("t").over(until) > 0).alias("in_tumour"), (F.sum("b").over(until) > 0).alias("in_band"),
        )
        .where("in_tumour or in_band")
    )


def complement(runs: DataFrame, frame: DataFrame) -> DataFrame:
    """Background runs inside the image; ``runs`` must be disjoint."""
    rows = frame.select("slide_id", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"), "width")
    stops = rows.select(*_ROW, F.col("width").alias("c0"), F.col("width").alias("c1"))
    w = Window.partitionBy(*_ROW).orderBy("c0")
    return (
        runs.select(*_ROW, "c0", "c1")
        .unionByName(stops)
        .select(
            *_ROW,
            (F.coalesce(F.lag("c1").over(w), F.lit(-1)) + 1).cast("int").alias("c0"),
            (F.col("c0") - 1).cast("int").alias("c1"),
        )
        .where("c0 <= c1")
    )


def _check_kernel(k: int) -> None:
    if k < 1:
        raise ValueError("kernel side must be at least 1")


def _merged(one: list[tuple[int, int]], other: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of two sorted lists of disjoint runs, touching runs joined."""
    out: list[tuple[int, int]] = []
    for c0, c1 in sorted(one + other):
        if out and c0 <= out[-1][1] + 1:
            if c1 > out[-1][1]:
                out[-1] = (out[-1][0], c1)
        else:
            out.append((c0, c1))
    return out


def strip_unions(rows: Sequence[tuple[int, list[tuple[int, int]]]], first: int, last: int) -> Iterator[tuple[int, int, int, int, bool]]:
    """``(y0, y1, c0, c1, downwards)`` for the rows with runs, in order, of the strip ``first .. last``.

    Downwards, the runs are the union of the strip from ``first`` to each of the rows ``y0 .. y1``; upwards, from each of them to ``last``.
    """
    for downwards in (True, False):
        held: list[tuple[int, int]] = []
        order = list(rows) if downwards else list(rows)[::-1]
        for i, (row, runs) in enumerate(order):
            held = _merged(held, runs)
            if downwards:
                span = (row, order[i + 1][0] - 1 if i + 1 < len(order) else last)
            else:
                span = (order[i + 1][0] + 1 if i + 1 < len(order) else first, row)
            for c0, c1 in held:
                yield (*span, c0, c1, downwards)


def dilate(runs: DataFrame, frame: DataFrame, k: int) -> DataFrame:
    """k x k all-ones dilation; pixels beyond the image border do not count.

    A pixel is set when a foreground pixel lies within ``[-k//2, k-1-k//2]`` of it on both axes. Runs first grow along their
    row. Image rows are cut into strips of k rows, so the k rows a pixel looks at are the end of one strip and the beginning of the
    next: unions of runs from each row to either end of its strip, at most two per row, hold all of them. A strip's unions grow
    row by row in one task, and the work does not depend on k.
    """
    _check_kernel(k)
    a, b = k // 2, k - 1 - k // 2
    grown = runs.join(frame, "slide_id").select(
        "slide_id", "height", F.floor(F.col("row") / k).cast("int").alias("strip"), F.col("row").cast("int").alias("row"),
        F.greatest(F.lit(0), F.col("c0") - b).cast("int").alias("c0"), F.least(F.col("width") - 1, F.col("c1") + a).cast("int").alias("c1"),
    )
    kind = grown.schema["slide_id"].dataType.simpleString()

    def unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slide_type, key, held, out = None, None, [], []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 5
            out.clear()
            names = ["slide_id", "y0", "y1", "c0", "c1"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [slide_type] + [pa.int32()] * 4)], names=names)

        def closed() -> Iterator[pa.RecordBatch]:
            slide, strip, height = key
            rows = [(r, [(c0, c1) for _, c0, c1 in own]) for r, own in groupby(held, key=lambda x: x[0])]
            for y0, y1, c0, c1, downwards in strip_unions(rows, strip * k, strip * k + k - 1):
                move = -b if downwards else a  # the pixel row that looks this far
                y0, y1 = max(0, y0 + move), min(height - 1, y1 + move)
                if y0 <= y1:
                    out.append((slide, y0, y1, c0, c1))
                if len(out) >= 10_000:
                    yield batch_of()

        for batch in batches:
            slide_type = batch.column("slide_id").type
            columns = [batch.column(c).to_pylist() for c in ("slide_id", "strip", "height", "row", "c0", "c1")]
            for slide, strip, height, row, c0, c1 in zip(*columns):
                if key is None or (slide, strip) != key[:2]:
                    if key is not None:
                        yield from closed()
                    key, held = (slide, strip, height), []
                held.append((row, c0, c1))
        if key is not None:
            yield from closed()
            yield batch_of()

    dealt = grown.repartition("slide_id", "strip").sortWithinPartitions("slide_id", "strip", "row", "c0")
    boxes = dealt.mapInArrow(unions, f"slide_id {kind}, y0 int, y1 int, c0 int, c1 int")
    return covered(boxes.select("slide_id", F.explode(F.sequence("y0", "y1")).alias("row"), "c0", "c1"))


def erode(runs: DataFrame, frame: DataFrame, k: int) -> DataFrame:
    """k x k erosion: what is left when the background is dilated."""
    return complement(dilate(complement(runs, frame), frame, k), frame)


def band_kernel(margin: int = MARGIN, down: int = DOWN_FACTOR) -> int:
    """Kernel side in mask pixels for a border band ``margin`` slide pixels across."""
    k = int((margin / down) / 2)
    _check_kernel(k)
    return k


def border_band(runs: DataFrame, frame: DataFrame, k: int) -> DataFrame:
    """Pixels set by dilation but cleared by erosion, on both sides of the region border.

    Cleared by erosion = set when the background is dilated, so the band is where the two dilations
    overlap and no subtraction is needed.
    """
    outer = dilate(runs, frame, k)
    inner = dilate(complement(runs, frame), frame, k)
    return covered(outer.unionByName(inner), depth=2)
