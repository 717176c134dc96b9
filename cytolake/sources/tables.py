"""Small companions of the slide data: lookups, rankings, result documents, pairing."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.functions.text import file_stem

# Tokens that mark files which are results, not inputs, and hidden files.
RESULT_TOKENS = ["data", "analysed", "cellnbr"]
RESULT_NAME = "analysed"
HIDDEN_TOKENS = ["._", ".DS_S"]


def input_sources(files: DataFrame, name: str = "name") -> DataFrame:
    """Inputs only: drop names holding a result token."""
    hit = None
    for token in RESULT_TOKENS:
        one = F.contains(F.col(name), F.lit(token))
        hit = one if hit is None else hit | one
    return files.where(~hit)


def result_sources(files: DataFrame, name: str = "name") -> DataFrame:
    """Result documents only, hidden companions left out."""
    keep = F.contains(F.col(name), F.lit(RESULT_NAME))
    for token in HIDDEN_TOKENS:
        keep = keep & ~F.contains(F.col(name), F.lit(token))
    return files.where(keep)


def unprocessed(inputs: DataFrame, done: DataFrame, key: str = "slide_id") -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def pair_slides(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Slides of the cell table, flagged by whether a mask of the same name exists."""
    return (
        cells.select("slide_id")
        .distinct()
        .join(mask.select("slide_id").distinct().withColumn("_m", F.lit(True)), "slide_id", "left")
        .select("slide_id", F.col("_m").isNotNull().alias("has_mask"))
    )


def last_per_key(pairs: DataFrame, key: str = "k", value: str = "v", pos: str = "pos") -> DataFrame:
    return pairs.groupBy(key).agg(F.max_by(value, pos).alias(value))


def read_id_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Headerless two-column CSV; of repeated keys the last row counts, files in order of their names."""
    rows = spark.read.schema("k string, v string").csv(path, header=False)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("record"))
    return last_per_key(rows.select("k", "v", place.alias("pos")))


def with_sample_ids(slides: DataFrame, lookup: DataFrame, key: str, name: str) -> DataFrame:
    return slides.join(lookup.select(F.col("k").alias(key), F.col("v").alias(name)), key, "left")


def read_feature_docs(spark: SparkSession, path: str) -> DataFrame:
    """Result documents, one small JSON object per file: (slide_id, doc)."""
    return spark.read.text(path, wholetext=True).select(
        file_stem(F.col("_metadata.file_path")).alias("slide_id"), F.col("value").alias("doc")
    )


def ranking_from_documents(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Ordered keys of a JSON object -> (feature, rank), rank from 1."""
    keep = [c for c in docs.columns if c != doc]
    return docs.select(*keep, F.posexplode(F.json_object_keys(doc)).alias("rank", "feature")).withColumn(
        "rank", F.col("rank") + 1
    )


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """Ranking documents, one JSON object per file: (name, rank, feature)."""
    text = spark.read.text(path, wholetext=True).select(file_stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("doc"))
    return ranking_from_documents(text)


def read_tile_pixels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
