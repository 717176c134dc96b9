"""Exact dedup as a stream with disk-backed keyed state.

The state has one entry per digest, lives in RocksDB, never expires, and holds the digest of the normalised
text, the stable identifier (the id that stays so far), the locator of its content (the source file that holds the
row with that id) and the number of rows seen. The stream's aggregate is folded on the map side first, so a text that
makes up a third of all rows reaches its state entry as one row per task.

Digests only propose: afterwards the bytes of every document whose digest was seen more than once are read
again and compared in full, so a digest shared by different texts never merges them.
"""

import hashlib
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.joins import broadcast_if_few
from cytolake.llm.text import as_bytes, lowered
from cytolake.runtime import cut, shared_dir

#: session settings of the stream's state
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # files are not pre-allocated: many small state partitions would hold megabytes each
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def digest_column(text: Column | str) -> Column:
    """SHA-256 of the text with A-Z lower-cased, as 32 bytes; null counts as empty."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(lowered(t)).digest() for t in texts], dtype=object)

    return run(as_bytes(text))


def normalised_column(text: Column | str) -> Column:
    """The whole bytes that are compared: A-Z lower-cased, null as empty."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([lowered(t) for t in texts], dtype=object)

    return run(as_bytes(text))


def _state_row(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, where its content is, how many rows were seen."""
    return rows.groupBy("digest").agg(
        F.max(F.struct("id", "locator")).alias("stays"), F.count(F.lit(1)).alias("seen")
    )


def stream_state(
    spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int = 64
) -> DataFrame:
    """``(digest, stays: struct<id, locator>, seen)`` after streaming every file of a Parquet table once.

    Each micro-batch writes the entries it changed under its own batch number; writing a batch again after a lost
    driver replaces it. The last version of each entry is the state.
    """
    folder = f"{shared_dir(spark)}/exact-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(_as_glob(path))
        marked = arriving.select(
            F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col("_metadata.file_path").alias("locator")
        ).select("id", "locator", digest_column("text").alias("digest"))

        def save(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

        query = (
            _state_row(marked)
            .writeStream.outputMode("update")
            .foreachBatch(save)
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    kinds = f"digest binary, stays struct<id: {schema[id_column].dataType.simpleString()}, locator: string>, seen bigint, batch int"
    changes = spark.read.schema(kinds).parquet(f"{folder}/changes") if _has_rows(spark, path) else spark.createDataFrame([], kinds)
    last = changes.groupBy("digest").agg(F.max_by(F.struct("stays", "seen"), "batch").alias("s"))
    return last.select("digest", "s.stays", "s.seen")


def _as_glob(path: str) -> str:
    """The path as a pattern that only it matches: a stream then takes one file as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _has_rows(spark: SparkSession, path: str) -> bool:
    return bool(spark.read.parquet(path).take(1))


def exact_copies(
    spark: SparkSession, path: str, id_column: str = "doc_id", text_column: str = "text", files_per_batch: int = 64
) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of the table at ``path``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of equal texts
    stays; a null id stays only where all are null; rows that repeat the id that stays are all marked kept.
    Columns other than the two named are not read. An empty table gives an empty result.
    """
    state = cut(stream_state(spark, path, id_column, text_column, files_per_batch))
    docs = spark.read.parquet(path).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    marked = docs.select("id", digest_column("text").alias("digest"))
    groups = state.select("digest", F.col("stays.id").alias("keep_id"), F.col("seen").alias("group_size"), "stays.locator")

    # the hits again, grouped by their whole bytes: a digest with two different texts shows as two groups; where the digests are few
    # they travel, and copies meet in the task that reads them, so only one text of each moves
    hits = broadcast_if_few(state.where("seen > 1").select("digest"))
    again = docs.select("id", normalised_column("text").alias("bytes"), digest_column("text").alias("digest"))
    by_bytes = again.join(hits, "digest", "left_semi").groupBy("digest", "bytes").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    mixed = cut(by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"))
    shown = [
        F.col("id").alias("doc_id"), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("locator").alias("keep_locator"),
    ]
    if mixed.isEmpty():
        return marked.join(groups, "digest").select(*shown)
    plain = marked.join(mixed, "digest", "left_anti").join(groups, "digest").select(*shown)
    own = by_bytes.join(mixed, "digest", "left_semi").withColumn("locator", F.lit(None).cast("string"))
    return plain.unionByName(again.join(own, ["digest", "bytes"]).select(*shown))
