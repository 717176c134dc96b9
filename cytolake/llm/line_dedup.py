"""Dropping repeated lines: exact copies and lines within one word edit of an earlier one.

A line is its sequence of lower-cased words. Two long lines are near when one word inserted, deleted or replaced
turns one into the other. The deletion neighbourhood of a line is the line itself and the line without any one of its words,
as hashed keys. Lines that emit an equal key are joined: a line and one that is a word longer meet where the
longer one leaves the extra word out, and lines that differ in one word meet where both leave it out at the same
place. Within such a group nobody is compared with everybody: it is enough to know its earliest member.

Distinct lines alone are looked at, and before the neighbourhoods are made, lines are left out that cannot have a
near line: an edit leaves the first or the second half of a line as it is, so a near line shares one of the hashes of
halves. This loses nothing and saves most of the neighbourhoods.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.llm.joins import broadcast_if_few
from cytolake.llm.text import as_bytes, lowered
from cytolake.llm.workers import tidy, tidy_series
from cytolake.runtime import cut

#: odd multipliers of the two polynomial hashes
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def line_words(line: bytes) -> list[bytes]:
    return lowered(line).split()


def line_digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def half_keys(words: list[bytes], min_words: int) -> list[int]:
    """Hashes of the halves a line of as many words, or of one word less, would have to share."""
    out = set()
    for m in (len(words), len(words) - 1):
        if m >= min_words:
            first = m // 2
            for side, part in ((0, words[:first]), (1, words[len(words) - (m - first) :])):
                out.add(xxhash.xxh3_64_intdigest(b" ".join(part), 2 * m + side))
    return [k - (1 << 64) if k >> 63 else k for k in sorted(out)]


def neighbourhood(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys, as two rows of longs, of the line and of the line without its i-th word; linear in its length."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    out = []
    for base in BASES:
        powers = np.cumprod(np.full(len(words), base, np.uint64), dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers, dtype=np.uint64)])
        back = np.uint64(pow(base, -1, 1 << 64))
        without = sums[:-1] + (sums[-1] - sums[1:]) * back
        out.append(np.concatenate([sums[-1:], without]).view(np.int64))
    return np.stack(out), np.arange(-1, len(words))


def within_one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _lines(docs: DataFrame, min_words: int, with_words: bool) -> DataFrame:
    """Lines that have words, of rows ``(id, text_key, text as bytes)``.

    ``(id, text_key, line_no, line, halves)``, or ``(line, words)`` of the lines long enough to have a near one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, key, text in zip(*[batch.column(c).to_pylist() for c in ("id", "text_key", "text")]):
                for number, line in enumerate((text or b"").split(b"\n")):
                    words = line_words(line)
                    if with_words and len(words) >= min_words:
                        rows.append((line_digest(words), b" ".join(words)))
                    elif words and not with_words:
                        rows.append((name, key, number, line_digest(words), half_keys(words, min_words)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema
            )

    if with_words:
        schema = pa.schema([("line", pa.binary()), ("words", pa.binary())])
        return docs.mapInArrow(tidy(run), "line binary, words binary")
    schema = pa.schema([
        ("id", pa.int64()), ("text_key", pa.int64()), ("line_no", pa.int32()), ("line", pa.binary()), ("halves", pa.list_(pa.int64())),
    ])
    return docs.mapInArrow(tidy(run), "id bigint, text_key bigint, line_no int, line binary, halves array<bigint>")


def _near_earlier(firsts: DataFrame, docs: DataFrame, min_words: int) -> DataFrame:
    """``(line, near)``: for lines that have an earlier near line, the place of one such line.

    ``firsts`` has each distinct line once with the place ``first`` of its first occurrence.
    """
    halves = firsts.select("line", F.explode("halves").alias("half"))
    shared = cut(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half"))
    possible = cut(halves.join(broadcast_if_few(shared), "half", "left_semi").select("line").distinct())
    texts = _lines(docs, min_words, True).join(broadcast_if_few(possible), "line", "left_semi").groupBy("line").agg(
        F.first("words").alias("words")
    )
    known = cut(texts.join(firsts.select("line", "first"), "line"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, words in zip(batch.column("line").to_pylist(), batch.column("words").to_pylist()):
                (k0, k1), places = neighbourhood(words.split(b" "))
                yield pa.RecordBatch.from_pydict({
                    "line": pa.array([line] * len(places), pa.binary()), "k0": pa.array(k0), "k1": pa.array(k1),
                    "place": pa.array(places.astype(np.int32)),
                })

    keys = known.select("line", "words").mapInArrow(emit, "line binary, k0 bigint, k1 bigint, place int")
    # an equal key at the same place means one word replaced; a whole line (place -1) meets longer ones without a word
    both = keys.withColumn("role", F.when(F.col("place") < 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(-2), F.col("place"))))
    tagged = both.withColumn("role", F.explode("role")).select(
        "line", "k0", "k1", F.greatest("role", F.lit(-1)).alias("slot"), (F.col("role") == -1).alias("whole")
    )
    placed = tagged.join(known.select("line", "first"), "line")
    earliest = placed.groupBy("k0", "k1", "slot").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(F.col("whole"), F.col("first"))).alias("of_whole"),
        F.min(F.when(~F.col("whole"), F.col("first"))).alias("of_others"),
    ).where("members > 1")
    partner = F.when((F.col("slot") == -1) & ~F.col("whole"), F.col("of_whole")).otherwise(F.col("of_others"))
    pairs = placed.join(earliest.drop("members"), ["k0", "k1", "slot"]).withColumn("near", partner).where("near < first")
    other = known.select(F.col("first").alias("near"), F.col("words").alias("near_words"))
    checked = pairs.select("line", "near").distinct().join(known.select("line", "words"), "line").join(other, "near")

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x.split(b" "), y.split(b" ")) for x, y in zip(a, b)], dtype=bool)

    return checked.where(verified("words", "near_words")).groupBy("line").agg(F.min("near").alias("near"))


def line_decisions(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 10, edits: int = 1
) -> DataFrame:
    """``(doc_id, text_key, line_no, kept, earlier)`` of every line that has a word.

    Lines are ordered by id (null first), then a hash of the text, then their number from 0. A line goes when an equal
    one, or with ``edits=1`` one within a word edit if both have ``min_words`` words, stands earlier; ``earlier`` is the place of such a
    line. The rule looks at what stands in the input, whether or not that line goes itself. Blank
    lines and null and empty texts have no rows; rows equal in id and text count as one document; an empty table
    gives an empty result; other columns are not read.
    """
    if edits not in (0, 1):
        raise ValueError("edits is 0 or 1")
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"), text_key_column(text_column).alias("text_key"), as_bytes(text_column).alias("text")
    )
    lines = cut(_lines(rows, min_words if edits else 1 << 30, False))
    place = F.struct("id", "text_key", "line_no")
    firsts = lines.groupBy("line").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves"))
    if edits:
        firsts = cut(firsts)
        near = cut(_near_earlier(firsts, rows, min_words))
        firsts = firsts.join(broadcast_if_few(near), "line", "left")
    else:
        firsts = firsts.withColumn("near", F.lit(None).cast("struct<id:bigint,text_key:bigint,line_no:int>"))
    # a line that stands once and has no near one needs no more look
    repeated = cut(firsts.where("times > 1 or near is not null").select("line", "first", "near"))
    return lines.drop("halves").join(broadcast_if_few(repeated), "line", "left").select(
        F.col("id").alias("doc_id"), "text_key", "line_no",
        (F.col("first").isNull() | (F.col("near").isNull() & (place == F.col("first")))).alias("kept"),
        F.coalesce("near", F.when(place != F.col("first"), F.col("first"))).alias("earlier"),
    )


def text_key_column(text: Column | str) -> Column:
    """Hash by which texts that share an id are told apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))


def drop_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = 10, edits: int = 1
) -> DataFrame:
    """``docs`` without the lines that :func:`line_decisions` lets go, all columns kept.

    A document that loses all its lines goes. Null texts and texts without a word stay as they are.
    """
    dropped = cut(
        line_decisions(docs, id_column, text_column, min_words, edits).where(~F.col("kept"))
        .groupBy(F.struct("doc_id", "text_key").alias("_place")).agg(F.collect_set("line_no").alias("_gone"))  # lines of one document
    )
    many = dropped.agg(F.sum(F.size("_gone") + 1)).first()[0] or 0
    dropped = broadcast_if_few(dropped, many)

    @F.pandas_udf("string")
    @tidy_series
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, numbers in zip(texts, gone):
            if numbers is None:
                out.append(None if text is None else text.decode("utf-8", "replace"))
                continue
            away = set(numbers)
            left = [x for i, x in enumerate(text.split(b"\n")) if i not in away]
            out.append(b"\n".join(left).decode("utf-8", "replace") if any(x.strip() for x in left) else None)
        return pd.Series(out, dtype=object)

    text = F.col(f"_row.`{text_column}`")
    keyed = docs.select(F.struct("*").alias("_row")).withColumn(
        "_place", F.struct(F.col(f"_row.`{id_column}`").cast("bigint").alias("doc_id"), text_key_column(text).alias("text_key"))
    )
    marked = keyed.join(dropped, keyed["_place"].eqNullSafe(dropped["_place"]), "left").select("_row", "_gone")
    cleaned = marked.withColumn("_text", rest(as_bytes(text), "_gone")).where("_gone is null or _text is not null")
    return cleaned.select(*[F.col("_text").alias(c) if c == text_column else F.col(f"_row.`{c}`") for c in docs.columns])
