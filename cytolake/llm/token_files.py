"""Token ids in binary files: bit-plane shuffled, compressed blocks with an index.

A file (one shard) holds the ids of consecutive documents, cut into blocks of ``block_ids`` ids. A block is transposed
into its 4 byte planes or 32 bit planes, and each plane is compressed on its own with zstandard: the high planes are
nearly constant and almost vanish. Layout, little-endian:

    magic 8 bytes | planes, block_ids, blocks, documents: 4 x u32 | ids: u64
    block index: for each block its number of ids and the lengths of its planes, u32
    length of the document index: u32 | document index (zstandard): null flags u8, ids i64, lengths i64
    planes of block 0, planes of block 1, ...

Spark writes one file image per row of a Parquet table, so that its commit protocol decides which attempt of a task
counts and any store Spark can write to will do; :func:`file_image` makes the bytes of a stand-alone file.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytolake.llm.bpe import read_tokenizer, worker_encoder
from cytolake.llm.text import as_bytes
from cytolake.llm.workers import tidy

MAGIC = b"TOKPLANE"
IMAGE = "part int, number int, ids_before bigint, n_ids bigint, n_documents bigint, content binary"
_IMAGE_ARROW = pa.schema([
    ("part", pa.int32()), ("number", pa.int32()), ("ids_before", pa.int64()), ("n_ids", pa.int64()),
    ("n_documents", pa.int64()), ("content", pa.binary()),
])


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of unsigned 32-bit ids, low plane first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == 4:
        return [raw[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").ravel()


def file_image(
    documents: list[tuple[int | None, bytes]], planes: int = 4, block_ids: int = 65_536, level: int = 1
) -> bytes:
    """File with the ids (bytes of unsigned 32-bit integers) of documents in this order."""
    press = zstandard.ZstdCompressor(level=level).compress
    ids = np.frombuffer(b"".join(d for _, d in documents), "<u4")
    blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
    parts = [[press(p) for p in to_planes(b, planes)] for b in blocks]
    index = np.array([[len(b), *map(len, p)] for b, p in zip(blocks, parts)], "<u4").tobytes()
    names = np.array([n or 0 for n, _ in documents], "<i8").tobytes()
    about = press(bytes(n is None for n, _ in documents) + names + np.array([len(d) // 4 for _, d in documents], "<i8").tobytes())
    head = np.array([planes, block_ids, len(blocks), len(documents)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    return b"".join([MAGIC, head, index, np.array([len(about)], "<u4").tobytes(), about, *(p for own in parts for p in own)])


def read_image(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their lengths in ids, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    planes, _, blocks, documents = (int(x) for x in np.frombuffer(content, "<u4", 4, 8))
    at = 32
    index = np.frombuffer(content, "<u4", blocks * (planes + 1), at).reshape(blocks, planes + 1)
    at += index.nbytes
    size = int(np.frombuffer(content, "<u4", 1, at)[0])
    unpress = zstandard.ZstdDecompressor().decompress
    about = unpress(content[at + 4 : at + 4 + size])
    names = np.frombuffer(about, "<i8", documents, documents).tolist()
    names = [None if null else n for null, n in zip(about[:documents], names)]
    lengths = np.frombuffer(about, "<i8", documents, 9 * documents)
    at += 4 + size
    out = [np.zeros(0, "<u4")]
    for row in index:
        parts = []
        for length in row[1:].tolist():
            parts.append(unpress(content[at : at + length]))
            at += length
        out.append(from_planes(parts, int(row[0])))
    return names, lengths, np.concatenate(out)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = 0,
    planes: int = 4,
    block_ids: int = 65_536,
    file_ids: int = 1_000_000,
) -> None:
    """Encode all texts, end each with ``end_id`` and write them in ascending order of their ids.

    Documents are dealt out by ranges of ids and each range is cut into files of about ``file_ids`` ids, so no task
    holds more than a file. Null and empty texts are the end id alone; null ids come first; rows that repeat an
    id are ordered by text; an empty table writes an empty folder. Other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before, held, waiting, encode = TaskContext.get().partitionId(), 0, 0, 0, [], None

        def close() -> pa.RecordBatch:
            row = [part, number, before, held, len(waiting), file_image(waiting, planes, block_ids)]
            return pa.RecordBatch.from_pylist([dict(zip(_IMAGE_ARROW.names, row))], schema=_IMAGE_ARROW)

        for batch in batches:
            encode = encode or worker_encoder(shipped.value)
            names, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for start in range(0, len(names), 500):
                for name, ids in zip(names[start : start + 500], encode(texts[start : start + 500])):
                    waiting.append((name, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= file_ids:
                        yield close()
                        number, before, held, waiting = number + 1, before + held, 0, []
        if waiting:
            yield close()

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), as_bytes(text_column).alias("text"))
    images = rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(tidy(files), IMAGE)
    images.write.mode("errorifexists").option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files; ``start`` counts the ids of all before it.

    A file is read where it is stored, without a shuffle. Each knows how many ids of its range come before it; one sum
    per range reaches the driver and gives the range its place.
    """
    images = spark.read.schema(IMAGE).parquet(path)
    sums = images.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()  # a row per range of the writing job
    range_start, total = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in sums):
        range_start[part], total = total, total + n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(*[batch.column(c).to_pylist() for c in ("part", "ids_before", "content")]):
                names, lengths, ids = read_image(content)
                ends, raw = np.cumsum(lengths), ids.tobytes()
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(names, pa.int64()), "start": pa.array(range_start[part] + before + ends - lengths, pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids": pa.array(own, pa.binary()),
                })

    return images.select("part", "ids_before", "content").mapInArrow(
        documents, "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    )
