"""Embedding near-dedup by an epsilon grid order join.

Unit vectors with a cosine of at least ``c`` lie within ``eps = sqrt(2 - 2 c)`` of each other. Vectors are turned onto
their principal axes and sorted by the grid cells of width ``eps`` of the leading ones; the sorted sequence of each label is cut
into blocks. Pairs of sequence intervals are refined from the whole sequence down to blocks, four parts at
a time, and a pair whose boxes on the leading axes are more than ``eps`` apart is dropped with all that lies in it. Only
the remaining pairs of blocks exchange vectors, and each pair is one matrix product in double precision.

Equal vectors of a label are one class with a weight, so a vector that makes up a third of the table is compared once. A
pair of blocks gives each class the number of its links and a spanning forest of the links, never the
links themselves.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytolake.functions.graph import connected_components
from cytolake.runtime import cut

#: leading principal axes that grid cells and boxes use
AXES = 6
FAN_OUT = 4
#: rows of a batch that hold two blocks each
PAIRS_PER_BATCH = 8


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Python gets batches of so many rows; for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def unit_vector_column(embedding: Column | str) -> Column:
    """The vector as bytes of doubles; null if it is null, empty, zero or has a null or non-finite component."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = np.zeros(0) if v is None else np.array([np.nan if e is None else e for e in v], float)
            good = len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
            out.append(x.astype("<f8").tobytes() if good else None)
        return pd.Series(out, dtype=object)

    return run(embedding)


def unit(raw: bytes) -> np.ndarray:
    x = np.frombuffer(raw, "<f8")
    x = x / np.abs(x).max()  # neither overflow nor underflow of the squares
    return x / np.sqrt(x @ x)


def principal_axes(classes: DataFrame, width: int) -> np.ndarray:
    """Axes of unit vectors of ``width`` components, most variance first; ``width^2`` sums reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            rows = [unit(r) for r in batch.column("raw").to_pylist()]
            if rows:
                x = np.stack(rows)
                n, first, second = n + len(x), first + x.sum(axis=0), second + x.T @ x
        total = np.concatenate([[n], first, second.ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(total))), "part": pa.array(total)})

    parts = classes.where(F.col("width") == width).select("raw").mapInArrow(sums, "place bigint, part double")
    total = np.zeros(1 + width + width * width)
    for r in parts.groupBy("place").agg(F.sum("part").alias("part")).collect():
        total[r["place"]] = r["part"]
    mean = total[1 : 1 + width] / max(total[0], 1)
    covariance = total[1 + width :].reshape(width, width) / max(total[0], 1) - np.outer(mean, mean)
    return np.linalg.eigh(covariance)[1][:, ::-1]


def _spanning(rows: np.ndarray, columns: np.ndarray, n: int) -> list[int]:
    """Positions of links that connect what all the given links between ``n`` nodes connect."""
    parent = list(range(n))
    kept = []
    for k, (a, b) in enumerate(zip(rows.tolist(), columns.tolist())):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append(k)
    return kept


def _blocks(classes: DataFrame, eps: float, block_rows: int) -> DataFrame:
    """Sorted sequence cut into blocks ``(label, width, block, lo, hi, classes, weights, vectors)``."""
    widths = classes.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    main = widths["width"] if widths else 0
    axes = principal_axes(classes, main) if main else np.eye(1)
    used = lambda x: (x @ axes if len(x) == main else x)[:AXES]

    @F.pandas_udf("array<double>")
    def turned(raws: pd.Series) -> pd.Series:
        fill = np.zeros(AXES)
        return pd.Series([np.concatenate([used(unit(r)), fill])[:AXES] for r in raws], dtype=object)

    cells = [F.floor(F.col("y")[k] / eps).alias(f"cell{k}") for k in range(AXES)]
    order = ["label", "width", *[f"cell{k}" for k in range(AXES)], "rep", "hash"]
    ordered = cut(classes.withColumn("y", turned("raw"))).select("*", *cells)  # ranges are sampled from what is stored
    schema = pa.schema([
        ("label", pa.int64()), ("width", pa.int32()), ("block", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
        ("reps", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())), ("vectors", pa.binary()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, waiting = TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            y = np.stack([w[5] for w in waiting])
            row = {
                "label": waiting[0][0], "width": waiting[0][1], "block": base + number, "lo": y.min(axis=0).tolist(), "hi": y.max(axis=0).tolist(),
                "reps": [w[2] for w in waiting], "hashes": [w[3] for w in waiting], "weights": [w[4] for w in waiting],
                "vectors": np.stack([unit(w[6]) for w in waiting]).astype("<f8").tobytes(),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("label", "width", "rep", "hash", "weight", "y", "raw")]
            for row in zip(*columns):
                if waiting and (row[:2] != waiting[0][:2] or len(waiting) >= block_rows):
                    yield close()
                    number, waiting = number + 1, []
                waiting.append(row)
        if waiting:
            yield close()

    return cut(
        ordered.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
            run,
            "label bigint, width int, block bigint, lo array<double>, hi array<double>, reps array<bigint>, hashes array<bigint>,"
            " weights array<bigint>, vectors binary",
        )
    )


def near_intervals(blocks: DataFrame, eps: float) -> DataFrame:
    """``(label, width, a, b)`` numbers of blocks, a <= b, whose boxes are not provably more than ``eps`` apart."""
    sequence = Window.partitionBy("label", "width").orderBy("block")
    numbered = cut(blocks.withColumn("number", F.row_number().over(sequence) - 1).select("label", "width", "number", "block", "lo", "hi"))
    longest = numbered.agg(F.max("number")).first()[0] or 0
    levels = 0
    while longest >= FAN_OUT**levels:
        levels += 1

    def boxes(level: int, side: str) -> DataFrame:
        corner = [F.min(F.col("lo")[k]) for k in range(AXES)] + [F.max(F.col("hi")[k]) for k in range(AXES)]
        rows = numbered.groupBy("label", "width", F.floor(F.col("number") / FAN_OUT**level).alias(side)).agg(
            F.array(*corner[:AXES]).alias(f"lo_{side}"), F.array(*corner[AXES:]).alias(f"hi_{side}")
        )
        return rows.withColumn(f"up_{side}", F.floor(F.col(side) / FAN_OUT))

    gap = [F.greatest(F.col("lo_a")[k] - F.col("hi_b")[k], F.col("lo_b")[k] - F.col("hi_a")[k], F.lit(0.0)) for k in range(AXES)]
    distance = sum((g * g for g in gap[1:]), gap[0] * gap[0])
    pairs = numbered.select("label", "width", F.lit(0).cast("bigint").alias("up_a"), F.lit(0).cast("bigint").alias("up_b")).distinct()
    for level in range(max(levels - 1, 0), -1, -1):
        parts = pairs.join(boxes(level, "a"), ["label", "width", "up_a"]).join(boxes(level, "b"), ["label", "width", "up_b"])
        near = parts.where((F.col("a") <= F.col("b")) & (distance <= F.lit(eps * eps)))
        pairs = near.select("label", "width", F.col("a").alias("up_a"), F.col("b").alias("up_b"))
        if level % 3 == 2:
            pairs = cut(pairs)
    block_of = lambda side: numbered.select("label", "width", F.col("number").alias(f"up_{side}"), F.col("block").alias(side))
    return pairs.join(block_of("a"), ["label", "width", "up_a"]).join(block_of("b"), ["label", "width", "up_b"]).select("a", "b")


def _links(blocks: DataFrame, pairs: DataFrame, cosine: float) -> DataFrame:
    """``(u, hash, v, n)``: with ``v`` null, class ``(u, hash)`` has links to ``n`` vectors; otherwise a link of a spanning forest."""
    schema = pa.schema([("u", pa.int64()), ("hash", pa.int64()), ("v", pa.int64()), ("n", pa.int64())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors_a"], "<f8").reshape(len(row["reps_a"]), -1)
                y = np.frombuffer(row["vectors_b"], "<f8").reshape(len(row["reps_b"]), -1)
                same = row["a"] == row["b"]
                near = x @ y.T >= cosine
                if same:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                reps = np.array(row["reps_a"] + row["reps_b"])
                hashes = np.array(row["hashes_a"] + row["hashes_b"])
                weights = np.array(row["weights_a"] + row["weights_b"])
                left, right = i, j + (0 if same else len(x))
                links = np.bincount(left, weights[right], len(reps)) + np.bincount(right, weights[left], len(reps))
                own = np.flatnonzero(links)
                kept = _spanning(left, right, len(reps))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([reps[own], reps[left[kept]]])), pa.array(np.concatenate([hashes[own], np.zeros(len(kept), np.int64)])),
                    pa.array([None] * len(own) + reps[right[kept]].tolist(), pa.int64()),
                    pa.array(np.concatenate([links[own].astype(np.int64), np.zeros(len(kept), np.int64)])),
                ], schema=schema)

    side = lambda s: blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("reps", "hashes", "weights", "vectors")])
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = pairs.repartition(tasks, "a", "b")  # a pair is much work: AQE would go by its few bytes
    with batch_rows(blocks.sparkSession, PAIRS_PER_BATCH):
        return cut(spread.join(side("a"), "a").join(side("b"), "b").mapInArrow(join, "u bigint, hash bigint, v bigint, n bigint"))


def near_vectors(
    embeddings: DataFrame,
    cosine: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    block_rows: int = 512,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``embeddings``.

    Vectors link when their labels are equal and not null, they have as many components and their cosine is at least
    ``cosine``. Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link
    with nothing. Equal vectors of a label are links of each other; rows that repeat an id are vectors of their own
    in one component. An empty table gives an empty result; other columns are not read.
    """
    eps = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    rows = cut(
        embeddings.select(
            F.col(id_column).alias("id"), F.col(label_column).cast("bigint").alias("label"), unit_vector_column(vector_column).alias("raw")
        )
    )
    usable = rows.where("id is not null and label is not null and raw is not null").withColumn("hash", F.xxhash64("label", "raw"))
    classes = cut(
        usable.groupBy("label", "hash", "raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
        .withColumn("width", F.expr("cast(length(raw) / 8 as int)"))
    )
    blocks = _blocks(classes, eps, block_rows)
    links = _links(blocks, near_intervals(blocks, eps), cosine)
    counts = links.where("v is null").groupBy(F.col("u").alias("rep"), "hash").agg(F.sum("n").alias("n"))
    roots = connected_components(links.where("v is not null").select("u", "v")).select(F.col("node").alias("rep"), "root")
    # a class is told by its label, hash and bytes; its rows take over what it has
    known = classes.join(counts, ["rep", "hash"], "left").join(roots, "rep", "left").select(
        "label", "hash", "raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id")
    )
    linked = usable.join(known, ["label", "hash", "raw"]).select("id", "n_links", "component_id")
    alone = rows.where("id is null or label is null or raw is null").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
