"""From raw documents to training tokens: five stages, each written as Parquet and read again by the next.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``. A stage sees all
rows that its predecessor kept.
"""

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm import bpe, line_dedup, mixing, quality, simhash
from cytolake.runtime import apply_session_rules, shared_dir

TOKENIZER = "byte_bpe_50k.json"
#: text of a block of the encoder: half as much as its default, as the workers also hold what earlier stages left
ENCODER_BLOCK = 16 << 20


def _rules(spark: SparkSession, broadcast_limit: str = "10MB") -> None:
    """Session settings of a stage. Rows are whole documents, so few of them go to Python at a time."""
    apply_session_rules(spark, broadcast_limit)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of texts that a stage has changed."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier rejects go.

    Null, empty and white texts have a score like any other. Repeated rows and rows of one id are judged each by its own
    text; extra columns stay as they are. An empty table, or one without a labelled document, loses no document.
    """
    _rules(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand in an earlier document or above go, and documents of which no line is left.

    Documents are ordered by id, null ids first. Null, empty and white texts have no line to lose and stay; rows equal in id and
    text count as one document. Extra columns stay as they are; an empty table stays empty.
    """
    _rules(spark)
    return _recounted(line_dedup.drop_lines(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are similar by 0.8 or more.

    The one with the smallest id stays, with all rows of that id in the group. Texts without a word, null ones too, are copies of each
    other; shorter texts than five words are one shingle. Documents without an id stay only in a group without any. Extra
    columns stay as they are; an empty table stays empty.
    """
    _rules(spark, "-1")  # dozens of small joins: their broadcasts would pile up in the driver
    return simhash.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the sources in their target shares; a document is there once for each repeat.

    A null source is a source of its own, the last. Texts without a word have nothing to take and go. Extra columns stay as
    they are; an empty table stays empty.
    """
    _rules(spark)
    return _recounted(mixing.mixed_documents(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)``: token ids of every text, and the text they decode to.

    Null texts count as empty and have no ids. Repeated rows stay repeated; extra columns are left out. An empty table gives no row.
    """
    _rules(spark)
    return bpe.encode_documents(docs, public_tokenizers.path(TOKENIZER), block_bytes=ENCODER_BLOCK, with_decoded=True)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("bpe", encode),
]

#: hashing, the classifier and the tokenizer have no SQL counterpart; tests compare each stage with a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
