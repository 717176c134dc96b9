"""SimHash fingerprints of word shingles and the links between near fingerprints.

Two fingerprints that differ in at most ``radius`` bits (even) meet in the middle: each is within ``radius / 2``
bits of some common value. So every distinct fingerprint emits all values of its ball of half the radius, and
fingerprints that emit the same value are shuffled together. Any two members of such a group differ in at most
``radius`` bits, and a group holds at most as many fingerprints as a half ball has values (65 for radius 2),
whatever the data: linking all members with the smallest one loses no component and never emits all pairs.

Copies meet as one fingerprint before anything is emitted, so a group of a million copies costs one row.

Two bits find few edited copies, so :func:`drop_similar` looks wider: besides the fingerprints it compares ``BANDS`` sketches a
text, each of the smallest values of ``BAND_ROWS`` hash functions over its five-word shingles. Texts of Jaccard similarity s share
a sketch with chance ``1 - (1 - s ** BAND_ROWS) ** BANDS``, 0.999 at 0.8. Every candidate is verified by the shingles themselves.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.functions.graph import connected_components
from cytolake.llm.joins import broadcast_if_few
from cytolake.llm.text import as_bytes, words_of
from cytolake.llm.workers import tidy
from cytolake.runtime import cut

SEED = 42
BITS = 64
BANDS = 24
BAND_ROWS = 6
#: texts of a group that meet as many others in a task
CELL = 64
#: pairs of one leader that meet in a task
LEADER_ROWS = 500


def _spread() -> np.ndarray:
    """256 words of 64 bits: the bits of a byte, one per byte lane, lowest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8).reshape(-1, 1), axis=1, bitorder="little")
    return bits.view(np.uint64).ravel()


def bit_majority(hashes: np.ndarray) -> int:
    """The value whose bits are set where over half of ``hashes`` (unsigned 64-bit) have them set."""
    n = len(hashes)
    lanes = _spread()[hashes.astype("<u8").view(np.uint8).reshape(n, 8)]  # a byte lane counts to 255
    ones = np.zeros(BITS, np.int64)
    for start in range(0, n, 255):
        ones += lanes[start : start + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(data: bytes | None, shingle_words: int = 3) -> int:
    """Unsigned fingerprint of a text; 0 when it has no word."""
    words = words_of(data)
    if not words:
        return 0
    joined = b" ".join(words)
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle_words:
        hashes = [hash_of(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle_words + 1]
        hashes = [hash_of(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle_words - 1 :].tolist())]
    return bit_majority(np.array(hashes, np.uint64))


def fingerprint_column(text: Column | str, shingle_words: int = 3) -> Column:
    """Fingerprint of a string column as a signed long with the same bits; null counts as empty."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle_words) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return run(as_bytes(text))


def half_ball(radius: int) -> list[int]:
    """XOR masks, as signed longs, of at most ``radius / 2`` bits."""
    if radius % 2 or not 0 <= radius <= 4:
        raise ValueError("radius is 0, 2 or 4: the meeting point has to lie in the middle")
    masks = [sum(1 << b for b in flips) for k in range(radius // 2 + 1) for flips in combinations(range(BITS), k)]
    return [m - (1 << BITS) if m >> 63 else m for m in masks]


def near_links(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """``(u, v)`` links between distinct values of column ``fp``, u < v, that connect all values within ``radius`` bits.

    Every link is verified. Within a group that shares a ball value only the links to its smallest member are
    given; the others follow, as all members lie within ``radius`` of each other.
    """
    masks = F.array(*[F.lit(m) for m in half_ball(radius)])
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of tasks of its own: the balls are 65 times as many rows as the fingerprints, whose size AQE goes by
    spread = fingerprints.select("fp").repartition(tasks, "fp").distinct().withColumn(
        "variant", F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("fp"))))
    )
    groups = spread.groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("members"))  # <= half ball
    pairs = groups.where(F.size("members") > 1).select(
        F.col("members")[0].alias("u"), F.explode(F.slice("members", 2, len(half_ball(radius)))).alias("v")
    )
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).distinct()


def _rooted(firsts: DataFrame, roots: DataFrame) -> DataFrame:
    """``(fp, component_id)`` for distinct ``(fp, first_id)`` and the ``(node, root)`` of those values of ``fp`` that are linked."""
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def components(fingerprints: DataFrame, radius: int = 2) -> DataFrame:
    """``(fp, component_id)`` for rows ``(id, fp)``: the smallest id reachable over links of at most ``radius`` bits.

    Null ids are never a component's id unless it has no other.
    """
    firsts = cut(fingerprints.groupBy("fp").agg(F.min("id").alias("first_id")))
    return _rooted(firsts, connected_components(near_links(firsts, radius)))


def simhash_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    ``fingerprint`` is a long. Null and empty texts have fingerprint 0, which links like any other; texts shorter
    than a shingle are one shingle; repeated rows stay repeated; an empty table gives an empty result. Other
    columns of ``docs`` are not read, whatever their names.
    """
    marked = cut(docs.select(F.col(id_column).alias("id"), fingerprint_column(text_column, shingle_words).alias("fp")))
    return marked.join(components(marked, radius), "fp").select(
        F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id"
    )


def drop_near_copies(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 3, radius: int = 2
) -> DataFrame:
    """``docs`` with one document of each SimHash group: the one with the smallest id, all columns as they were.

    Rows that repeat an id within a group count as one document and stay together. Documents without an id stay
    only where no document of their group has one.
    """
    marked = cut(docs.select(F.col(id_column).alias("id"), fingerprint_column(text_column, shingle_words).alias("fp")))
    again = fingerprint_column(F.col(f"_row.`{text_column}`"), shingle_words)
    return _one_of_each(docs, id_column, marked, components(marked, radius), again)


def _one_of_each(docs: DataFrame, id_column: str, marked: DataFrame, groups: DataFrame, again: Column) -> DataFrame:
    """``docs`` with the first document of each group; ``again`` gives the ``fp`` of a ``_row``."""
    ids = marked.join(groups, "fp").withColumn("stays", F.col("id").eqNullSafe(F.col("component_id")))
    of_id = cut(ids.groupBy("id").agg(F.max("stays").alias("some"), F.min("stays").alias("all")).where("not all"))
    rows = docs.select(F.struct("*").alias("_row"))
    own_id = F.col(f"_row.`{id_column}`")
    # an id whose rows have different texts can stay with one and go with another: its rows are told apart again
    split = of_id.where("some").select(F.col("id").alias("_split_id"))
    gone = of_id.where("not some").select(F.col("id").alias("_gone_id"))
    left = rows.join(broadcast_if_few(gone), own_id.eqNullSafe(F.col("_gone_id")), "left_anti")
    if split.isEmpty():
        return left.select("_row.*")
    stays = ids.where("stays").select(F.col("id").alias("_stays_id"), F.col("fp").alias("_stays_fp")).distinct()
    whole = left.join(broadcast_if_few(split), own_id.eqNullSafe(F.col("_split_id")), "left_anti")
    parts = left.join(broadcast_if_few(split), own_id.eqNullSafe(F.col("_split_id")), "left_semi").withColumn("_fp", again)
    matched = parts.join(stays, own_id.eqNullSafe(F.col("_stays_id")) & (F.col("_fp") == F.col("_stays_fp")), "left_semi")
    return whole.select("_row").unionByName(matched.select("_row")).select("_row.*")


def shingle_hashes(words: list[bytes], shingle_words: int = 5) -> np.ndarray:
    """Distinct unsigned hashes of the runs of ``shingle_words`` words; a shorter text is one shingle, no word is none."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], np.uint64)
    n = max(1, len(words) - shingle_words + 1)
    out = np.full(n, min(len(words), shingle_words), np.uint64)
    for k in range(min(len(words), shingle_words)):
        out = (out ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """``BANDS`` longs of which similar sets share some; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    random = np.random.default_rng(SEED)
    factors = random.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(len(factors), ~np.uint64(0))
    for start in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[start : start + 1024, None] * factors).min(axis=0), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64)


def words_key(words: list[bytes]) -> bytes:
    """128 bits that texts of the same words share."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def _sketched(docs: DataFrame, id_column: str, text_column: str, shingle_words: int) -> DataFrame:
    """``(id, text_hash, key, fp, bands)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, bands = [], [], []
            for text in batch.column("text"):
                data = text.as_py()
                words = words_of(data)
                keys.append(words_key(words))
                prints.append(fingerprint(data))
                bands.append(sketches(shingle_hashes(words, shingle_words)))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "text_hash": batch.column("text_hash"), "key": pa.array(keys, pa.binary()),
                "fp": pa.array(np.array(prints, np.uint64).view(np.int64)), "bands": pa.array(bands, pa.list_(pa.int64())),
            })

    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), as_bytes(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"id {kind}, text_hash bigint, key binary, fp bigint, bands array<bigint>")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, text_column: str, shingle_words: int) -> DataFrame:
    """``(key, shingles)`` of the texts whose ``text_hash`` is ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                words = words_of(text.as_py())
                shingles = shingle_hashes(words, shingle_words).view(np.int64)
                yield pa.RecordBatch.from_pydict({"key": pa.array([words_key(words)], pa.binary()), "shingles": pa.array([shingles], pa.list_(pa.int64()))})

    texts = docs.select(as_bytes(text_column).alias("text"), F.xxhash64(text_column).alias("text_hash"))
    some = texts.join(broadcast_if_few(wanted), "text_hash", "left_semi").select("text")
    return some.mapInArrow(tidy(run), "key binary, shingles array<bigint>").groupBy("key").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``(u, v)`` whose sets are as similar; one ``u`` with many ``v`` is dealt over tasks."""
    salts = pairs.groupBy("u").agg(F.floor(F.count(F.lit(1)) / LEADER_ROWS).cast("int").alias("_salts"))
    left = salts.join(sets.withColumnRenamed("key", "u"), "u").withColumn("_salt", F.explode(F.sequence(F.lit(0), "_salts")))
    right = pairs.join(salts, "u").withColumn("_salt", F.pmod(F.xxhash64("v"), F.col("_salts") + 1).cast("int")).drop("_salts")
    met = right.join(sets.withColumnRenamed("key", "v").withColumnRenamed("shingles", "_of_v"), "v").join(left, ["u", "_salt"])
    both = F.size(F.array_intersect("shingles", "_of_v"))
    return met.where(both >= similarity * (F.size("shingles") + F.size("_of_v") - both) - 1e-9).select("u", "v")


def _similar(one: np.ndarray, other: np.ndarray, similarity: float) -> bool:
    small, large = sorted((len(one), len(other)))
    if small < similarity * large - 1e-9:
        return False
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both >= similarity * (small + large - both) - 1e-9


def _across(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)`` roots that a similar pair links, for ``(token, key, root, first)``: all pairs of a token with different roots.

    ``first`` is the root that most texts of the token are expected to have. These are dealt to cells of about ``CELL``, and only
    the others go to each of the cells; among each other the others are compared by pairs of their own cells. Links come out alone.
    """
    marked = members.withColumn("other", F.col("root") != F.col("first"))
    sizes = marked.groupBy("token").agg(F.count_if("other").alias("others"), F.count_if(~F.col("other")).alias("many"))
    cells = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / CELL).cast("int"))
    placed = marked.join(sizes, "token").withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("other"), cells("others")).otherwise(cells("many"))).cast("int"))
    place = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, none = F.col("own"), F.lit(-1)
    every = F.transform(F.sequence(F.lit(0), cells("many") - 1), lambda c: place(none, c))
    among = F.transform(F.sequence(F.lit(0), cells("others") - 1), lambda c: place(F.least(own, c), F.greatest(own, c)))
    met = F.when(F.col("other"), F.when(F.col("many") > 0, F.concat(every, among)).otherwise(among)).otherwise(F.array(place(none, own)))
    dealt = placed.withColumn("met", F.explode(met)).join(sets, "key")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        owns, roots, others = (table.column(c).to_pylist() for c in ("own", "root", "other"))
        shingles = [s.values.to_numpy() for s in table.column("shingles")]
        i, j = key[1].as_py(), key[2].as_py()
        found = set()
        for x, y in combinations(range(len(owns)), 2):
            if roots[x] == roots[y] or (others[x] == others[y] if i < 0 else i != j and owns[x] == owns[y]):
                continue
            if tuple(sorted((roots[x], roots[y]))) not in found and _similar(shingles[x], shingles[y], similarity):
                found.add(tuple(sorted((roots[x], roots[y]))))
        return pa.table({"u": pa.array([u for u, _ in found], pa.binary()), "v": pa.array([v for _, v in found], pa.binary())})

    flat = dealt.select("token", F.col("met.i").alias("i"), F.col("met.j").alias("j"), "own", "root", "other", "shingles")
    return flat.groupBy("token", "i", "j").applyInArrow(compare, "u binary, v binary").distinct()


def similar_roots(texts: DataFrame, docs: DataFrame, text_column: str, shingle_words: int, similarity: float) -> DataFrame:
    """``(node, root)`` of the linked ones of distinct ``texts``: ``(key, text_hash, fp, bands)``; roots are the smallest linked keys.

    Candidates share a token, which is one of their sketches or their fingerprint, or have fingerprints within 2 bits. First each
    token's smallest text is compared with its others, which joins nearly all that belongs together. Then the texts of a token that
    still have different roots are compared pair by pair, so no pair that shares a token is left out.
    """
    own = F.array_append("bands", F.xxhash64(F.lit("fingerprint"), "fp"))
    tokens = texts.select("key", F.explode(own).alias("token"))
    shared = tokens.groupBy("token").agg(F.min("key").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    member = cut(tokens.join(shared, "token"))
    stars = member.where("key <> leader").select(F.col("leader").alias("u"), F.col("key").alias("v"))
    prints = cut(texts.groupBy("fp").agg(F.min("key").alias("first")))
    one, other = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in ("u", "v"))
    near = near_links(prints).join(one, "u").join(other, "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    pairs = cut(stars.unionByName(near).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct()
    sets = cut(_shingle_sets(docs, cut(texts.join(wanted, "key", "left_semi").select("text_hash").distinct()), text_column, shingle_words))
    roots = connected_components(_verified(pairs, sets, similarity))
    placed = member.join(roots, F.col("key") == F.col("node"), "left").select("token", "key", "leader", F.coalesce("root", "key").alias("root"))
    of_leader = F.max(F.when(F.col("key") == F.col("leader"), F.col("root"))).alias("first")
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), of_leader).where("low <> high").select("token", "first")
    more = connected_components(_across(placed.join(mixed, "token"), sets, similarity)).toDF("_low", "_high")
    known = roots.join(more, F.col("root") == F.col("_low"), "left").select("node", F.coalesce("_high", "root").alias("root"))
    alone = more.join(roots, F.col("_low") == F.col("node"), "left_anti").select(F.col("_low").alias("node"), F.col("_high").alias("root"))
    return known.unionByName(alone)


def drop_similar(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle_words: int = 5, similarity: float = 0.8
) -> DataFrame:
    """``docs`` with one document of each group of texts linked by a Jaccard similarity of their word shingles.

    As :func:`drop_near_copies` otherwise; texts without a word are copies of each other.
    """
    every = cut(_sketched(docs, id_column, text_column, shingle_words))
    texts = cut(every.groupBy("key").agg(F.min("id").alias("first_id"), *[F.first(c).alias(c) for c in ("text_hash", "fp", "bands")]))
    roots = similar_roots(texts, docs, text_column, shingle_words, similarity)
    marked = every.select("id", F.col("key").alias("fp"))
    groups = _rooted(texts.select(F.col("key").alias("fp"), "first_id"), roots)

    @F.pandas_udf("binary")
    def key(data: pd.Series) -> pd.Series:
        return pd.Series([words_key(words_of(t)) for t in data], dtype=object)

    return _one_of_each(docs, id_column, marked, groups, key(as_bytes(F.col(f"_row.`{text_column}`"))))
