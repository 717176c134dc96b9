"""Words of a document table numbered within blocks of documents.

A scan task takes its documents in order and closes a block whenever their texts reach ``block_bytes``. Within a
block each distinct word has a number, so a word travels once per block instead of once per occurrence, and a
document travels as its sequence of numbers, about a byte and a half per word. A block fits in memory whatever the
size of the table; a word has at most one row per block, so no word is a hot key.

Both tables of a block come from the same walk over the same scan, once for the words and once for the documents: the
documents have to be a plain scan of files (or a checkpoint), whose tasks give the same rows in the same order each time.
"""

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cytolake.llm.workers import tidy

#: blocks of one scan task, at most
_SEQUENCE_BITS = 24

_ARROW = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def pack(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as variable-length bytes, seven bits each, low bits first."""
    numbers = np.asarray(numbers)
    most = -(-int(numbers.max(initial=0)).bit_length() // 7) or 1  # bytes of the largest
    if most == 1:
        return numbers.astype(np.uint8).tobytes()
    numbers = numbers.astype(np.uint32 if most < 5 else np.uint64)
    parts = np.empty((len(numbers), most), np.uint8)
    used = np.empty((len(numbers), most), bool)
    for k in range(most):
        left = numbers >> (7 * k)
        used[:, k] = left > 0 if k else True
        parts[:, k] = (left & 0x7F).astype(np.uint8) | ((left > 0x7F).view(np.uint8) << 7)
    return parts[used].tobytes()


def unpack(data: bytes) -> np.ndarray:
    """What :func:`pack` packed, as int64."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    last = raw < 0x80
    starts = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << (7 * place), starts)


def _blocks(batches: Iterable[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, list[tuple]]]:
    """``(block, rows)``: rows are the batch's columns, the text last."""
    context = TaskContext.get()
    base = (context.partitionId() if context else 0) << _SEQUENCE_BITS
    rows, held, block = [], 0, 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            rows.append(row)
            held += len(row[-1] or b"") + 64
            if held >= block_bytes:
                yield base + block, rows
                rows, held, block = [], 0, block + 1
    if rows:
        yield base + block, rows


def _counted(rows: list[tuple], split: Callable[[bytes], list]) -> Counter:
    """How often each word of a block occurs, in order of first occurrence."""
    found: Counter = Counter()
    for row in rows:
        found.update(split(row[-1] or b""))
    return found


def _order(totals: np.ndarray) -> np.ndarray:
    """Places of the words of a block by number: most frequent first, then by first occurrence."""
    return np.argsort(-totals, kind="stable")


def _numbered(rows: list[tuple], split: Callable[[bytes], list]) -> list[np.ndarray]:
    """The numbers of the words of every row. Takes the texts away from ``rows``."""
    first: defaultdict = defaultdict(count().__next__)
    texts = []
    for i, row in enumerate(rows):
        texts.append(np.fromiter(map(first.__getitem__, split(row[-1] or b"")), np.int32))
        rows[i] = row[:-1]  # the text is not needed any more
    total = np.zeros(len(first), np.int64)
    for start in range(0, len(texts), 1000):
        total += np.bincount(np.concatenate(texts[start : start + 1000]), minlength=len(first))
    order = _order(total)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return [rank[t] for t in texts]


def _word_batches(words: list, name: str, numbers: np.ndarray, block: int | None = None) -> Iterator[pa.RecordBatch]:
    words = [w.encode() for w in words] if words and isinstance(words[0], str) else words
    for start in range(0, len(words), 50_000):
        own = pa.array(words[start : start + 50_000], pa.binary())
        named = {} if block is None else {"block": pa.array(np.full(len(own), block, np.int64))}
        yield pa.RecordBatch.from_pydict(named | {name: pa.array(numbers[start : start + 50_000]), "word": own})


def word_counts(docs: DataFrame, split: Callable[[bytes], list], block_bytes: int) -> DataFrame:
    """``(n, word)``: how often the distinct words of every block occur; the one column of ``docs`` is the text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches, block_bytes):
            found = _counted(rows, split)
            yield from _word_batches(list(found), "n", np.fromiter(found.values(), np.int64, len(found)))

    return docs.mapInArrow(tidy(run), "n bigint, word binary")


def block_words(docs: DataFrame, split: Callable[[bytes], list], block_bytes: int) -> DataFrame:
    """``(block, number, word)``: the distinct words of every block; ``docs`` ends with the text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, block_bytes):
            found = _counted(rows, split)
            order = _order(np.fromiter(found.values(), np.int64, len(found)))
            words = list(found)
            del found, rows
            yield from _word_batches([words[i] for i in order.tolist()], "number", np.arange(len(words), dtype=np.int32), block)

    return docs.mapInArrow(tidy(run), "block bigint, number int, word binary")


def block_documents(
    docs: DataFrame,
    split: Callable[[bytes], list],
    block_bytes: int,
    carried: str = "id bigint",
    score: Callable[[list[bytes | None]], Sequence[float]] | None = None,
) -> DataFrame:
    """``(block, *carried, numbers)``: every document as the packed numbers of its words.

    ``carried`` is the schema of the columns of ``docs`` before its last one, the text as bytes. ``score`` gives texts a number
    each, column ``score``, on the same walk: a second Python worker per task would hold the texts again.
    """
    names = [c.split()[0] for c in carried.split(",")]
    kinds = [_ARROW[c.split()[1]] for c in carried.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches, block_bytes):
            press = zstandard.ZstdCompressor(level=1).compress
            parts = range(0, len(rows) if score else 0, 200)
            scores = [float(x) for at in parts for x in score([row[-1] for row in rows[at : at + 200]])]
            texts = _numbered(rows, split)
            for start in range(0, len(rows), 500):
                some = rows[start : start + 500]
                columns = {"block": pa.array(np.full(len(some), block, np.int64))}
                columns |= {n: pa.array([r[i] for r in some], kinds[i]) for i, n in enumerate(names)}
                columns["numbers"] = pa.array([press(pack(t)) for t in texts[start : start + 500]], pa.binary())
                if score:
                    columns["score"] = pa.array(scores[start : start + 500], pa.float64())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(tidy(run), f"block bigint, {carried}, numbers binary" + (", score double" if score else ""))


def numbers_of(data: bytes) -> np.ndarray:
    """The numbers of a document, as :func:`block_documents` gives them."""
    return unpack(zstandard.ZstdDecompressor().decompress(data))
