"""The driver tables seen as slides, masks, feature matrices and tiles.

Integer arithmetic only, so that the same projection can be written in any SQL engine. Every view covers
its whole source table: one slide per supplier, one tile per part.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK_SIDE = 100
DOWN = 32
TILE_SIDE = 20

#: pixels that a task makes
TASK_PIXELS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame, key: str, pixels: int) -> DataFrame:
    """Rows dealt to as many tasks as the ``pixels`` made of each of them ask for: a table of short rows is one split, whose task would
    make and count the pixels of all."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() * pixels // TASK_PIXELS))
    return rows.repartition(tasks, key)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cell per line item; the slide is its supplier, the outline a rectangle."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(
        F.col("l_suppkey").alias("slide_id"),
        # increasing along (orderkey, linenumber, partkey, quantity), which tells all line items apart
        (
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 640000000
            + F.col("l_partkey") * 64
            + F.col("l_quantity").cast("bigint")
        ).alias("cell_ord"),
        ((F.col("l_partkey") * 7919 + F.col("l_orderkey") * 31) % 3200 + F.col("l_discount")).alias("cx"),
        (
            (F.col("l_orderkey") * 6151 + F.col("l_suppkey") * 17 + F.col("l_linenumber") * 101) % 3200
            + F.col("l_tax")
        ).alias("cy"),
        (1 + (F.col("l_partkey") + F.col("l_linenumber") * 2 + F.col("l_orderkey")) % 5).cast("int").alias("cell_type"),
        (2 + F.col("l_quantity").cast("int") % 4).alias("hw"),
        (2 + F.col("l_linenumber") % 3).alias("hh"),
    )
    x, y = F.col("cx").cast("bigint"), F.col("cy").cast("bigint")
    corner = lambda sx, sy: F.array(
        (x + sx * F.col("hw")).cast("double"), (y + sy * F.col("hh")).cast("double")
    )
    return base.select(
        "slide_id",
        "cell_ord",
        F.concat_ws("-", F.lit("n"), F.col("cell_ord").cast("string")).alias("cell_id"),
        "cx",
        "cy",
        "cell_type",
        F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("contour"),
    )


def raw_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 100 x 100 mask per supplier: 2 is tumour, 1 background. The last block touches the second
    region at a corner only."""
    slides = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("slide_id"), (F.col("s_suppkey") % 20).cast("int").alias("s")
    )
    side = F.sequence(F.lit(0), F.lit(MASK_SIDE - 1))
    dealt = _dealt(slides, "slide_id", MASK_SIDE * MASK_SIDE)
    px = dealt.select("*", F.explode(side).alias("row")).select("*", F.explode(side).alias("col"))
    s, r, c = F.col("s"), F.col("row"), F.col("col")
    first = r.between(10 + s % 5, 44 + s % 7) & c.between(F.lit(15), 50 + s)
    second = r.between(60, 85) & c.between(20 + 2 * (s % 10), F.lit(80))
    corner = r.between(86, 90) & c.between(81, 85)
    return px.select("slide_id", "row", "col", F.when(first | second | corner, 2).otherwise(1).alias("value"))


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 20 x 20 tile per part with four square instances; predictions are shifted by size % 4."""
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("tile_id"), (F.col("p_size") % 4).cast("int").alias("sh")
    )
    side = F.sequence(F.lit(0), F.lit(TILE_SIDE - 1))
    dealt = _dealt(parts, "tile_id", TILE_SIDE * TILE_SIDE)
    px = dealt.select("*", F.explode(side).alias("row")).select("*", F.explode(side).alias("col"))
    r, c, sh, t = F.col("row"), F.col("col"), F.col("sh"), F.col("tile_id")
    inst = lambda cc: (F.floor(r / 10) * 2 + F.floor(cc / 10) + 1).cast("int")
    px = px.select(
        "tile_id",
        "row",
        "col",
        F.when((r % 10 < 8) & (c % 10 < 8), inst(c)).otherwise(0).alias("true_inst"),
        F.when((c >= sh) & (r % 10 < 8) & ((c - sh) % 10 < 8), inst(c - sh)).otherwise(0).alias("pred_inst"),
    )
    odd = ((t % 3 == 0) & (F.col("pred_inst") % 4 == 0)).cast("int")
    cls = lambda i, extra: F.when(F.col(i) == 0, 0).otherwise((1 + (F.col(i) + t + extra) % 5).cast("int"))
    return px.withColumn("true_class", cls("true_inst", F.lit(0))).withColumn("pred_class", cls("pred_inst", odd))


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long matrix: one sample per embedding, one feature per position."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("slide_id"), F.posexplode("embedding").alias("pos", "v")).select(
        "slide_id", F.format_string("f%02d", "pos").alias("feature"), F.col("v").cast("double").alias("value")
    )


def sample_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("slide_id"),
        (F.col("label") % 2).alias("label"),
        F.floor(F.col("label") / 2).cast("int").alias("cohort_id"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("slide_id"),
        (F.col("user_id") % 3).cast("int").alias("fold"),
        (F.col("event_type") == "purchase").cast("int").alias("label"),
        F.col("value").alias("score"),
    )
