"""Mask images as pixel or run tables."""

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cytolake.functions.text import file_stem
from cytolake.sources.files import write_files

_PIXELS = "slide_id string, row int, col int, value int"
_RUNS = "slide_id string, height int, width int, row int, c0 int, c1 int, value int"


def _plane(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Single plane of an image: itself, or the red channel of a 3-channel one (stored B, G, R)."""
    if channels not in (1, 3):
        raise ValueError(f"a mask image has 1 or 3 channels, not {channels}")
    flat = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return flat[:, :, 0] if channels == 1 else flat[:, :, 2]


def _images(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .load(path)
        .select(
            file_stem(F.col("image.origin")).alias("slide_id"),
            "image.height",
            "image.width",
            "image.nChannels",
            "image.data",
        )
    )


def read_masks(spark: SparkSession, path: str, rows_per_batch: int = 64) -> DataFrame:
    """Dense pixel table; an image is emitted a few rows at a time."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for img in batch.itertuples(index=False):
                plane = _plane(img.height, img.width, img.nChannels, img.data)
                for top in range(0, img.height, rows_per_batch):
                    part = plane[top : top + rows_per_batch]
                    yield pd.DataFrame(
                        {
                            "slide_id": img.slide_id,
                            "row": np.repeat(np.arange(top, top + len(part), dtype=np.int32), img.width),
                            "col": np.tile(np.arange(img.width, dtype=np.int32), len(part)),
                            "value": part.reshape(-1).astype(np.int32),
                        }
                    )

    return _images(spark, path).mapInPandas(emit, _PIXELS)


def read_mask_runs(spark: SparkSession, path: str, rows_per_batch: int = 1024) -> DataFrame:
    """Runs of equal value with the image size on every row; far fewer rows than pixels."""

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for img in batch.itertuples(index=False):
                plane = _plane(img.height, img.width, img.nChannels, img.data)
                for top in range(0, img.height, rows_per_batch):
                    part = plane[top : top + rows_per_batch]
                    starts = np.ones(part.shape, bool)
                    starts[:, 1:] = part[:, 1:] != part[:, :-1]
                    row, c0 = np.nonzero(starts)
                    last = np.append(row[1:] != row[:-1], True)  # of its image row
                    c1 = np.where(last, img.width, np.append(c0[1:], 0)) - 1
                    yield pd.DataFrame({
                        "slide_id": img.slide_id, "height": np.int32(img.height), "width": np.int32(img.width), "row": (row + top).astype(np.int32),
                        "c0": c0.astype(np.int32), "c1": c1.astype(np.int32), "value": part[row, c0].astype(np.int32),
                    })

    return _images(spark, path).mapInPandas(emit, _RUNS)


# Fixed values of the PNG format: its first bytes, and 8 bits of grey per pixel without interlacing.
PNG_START = b"\x89PNG\r\n\x1a\n"
PNG_GREY = bytes([8, 0, 0, 0, 0])


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_image(height: int, width: int, rows: Iterable[tuple[int, list[tuple[int, int, int]]]]) -> bytes:
    """A grey image from the rows, in order, that have runs ``(c0, c1, value)``; all else is 0. One row is held at a time."""
    press, parts, empty, at = zlib.compressobj(6), [], bytes(width + 1), 0  # a row begins with its filter, none
    for row, runs in rows:
        parts.extend(press.compress(empty) for _ in range(at, row))
        line = bytearray(empty)
        for c0, c1, value in runs:
            line[c0 + 1 : c1 + 2] = bytes([value]) * (c1 - c0 + 1)
        parts.append(press.compress(bytes(line)))
        at = row + 1
    parts.extend(press.compress(empty) for _ in range(at, height))
    body = b"".join([*parts, press.flush()])
    return PNG_START + _chunk(b"IHDR", struct.pack(">II", width, height) + PNG_GREY) + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def write_masks(runs: DataFrame, frame: DataFrame, folder: str) -> DataFrame:
    """Lossless images ``<slide_id>.png``, one per slide of ``frame`` (slide_id, height, width); gives the names written.

    ``runs`` are ``(slide_id, row, c0, c1)`` with a ``value`` of 0 to 255, 255 where there is none; they are disjoint and lie within the
    image. A slide's runs stream through one task in order; its compressed image is held.
    """
    value = F.col("value") if "value" in runs.columns else F.lit(255)
    kinds = "slide_id {kind}, height int, width int, row int, c0 int, c1 int, value int"
    kinds = kinds.format(kind=frame.schema["slide_id"].dataType.simpleString())
    sizes = frame.select("slide_id", "height", "width", *[F.lit(-1).alias(c) for c in ("row", "c0", "c1", "value")])
    spots = runs.select("slide_id", F.lit(0).alias("height"), F.lit(0).alias("width"), "row", "c0", "c1", value.alias("value"))
    every = sizes.unionByName(spots).to(StructType.fromDDL(kinds)).repartition("slide_id").sortWithinPartitions("slide_id", "row", "c0")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cells() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in batch.schema.names])

        stream = cells()
        cell = next(stream, None)
        while cell is not None:
            slide, height, width, *_ = cell  # the size comes first
            following: list[tuple] = []

            def rows() -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
                at, held = None, []
                for other in stream:
                    if other[0] != slide:
                        following.append(other)
                        break
                    if other[3] != at:
                        if held:
                            yield at, held
                        at, held = other[3], []
                    held.append(other[4:])
                if held:
                    yield at, held

            content = png_image(height, width, rows())
            yield pa.RecordBatch.from_pydict({"name": pa.array([f"{slide}.png"]), "content": pa.array([content], pa.binary())})
            cell = following[0] if following else None

    return write_files(every.mapInArrow(images, "name string, content binary"), folder)
