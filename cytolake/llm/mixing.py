"""Mixing sources to target weights with blocks of equal size.

Every source's documents are laid end to end, in seeded order, on a few long tapes (shards), and each tape is cut
into blocks of ``block_words`` words. A source's target in words is a number of blocks; Sainte-Lague
apportionment gives all blocks of the mix to the sources by highest quotients ``target / (2 k + 1)``, and
then a source's blocks to its tapes in the same way. So each (source, shard) has an integer quota. With ``n`` blocks on a
tape and a quota of ``q``, every block is taken ``q // n`` times and ``q % n`` seeded blocks once more.

Only sums per source and per (source, shard) reach the driver; there are at most ``max_shards`` shards of a
source, and the number of sources is that of the mixing weights. A document never leaves its row: the blocks
it overlaps follow from its place on its tape.
"""

import re
from collections.abc import Callable, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytolake.llm.text import as_bytes
from cytolake.llm.workers import tidy_series
from cytolake.runtime import cut

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: blocks a source has at least, if it has as many words
SOURCE_BLOCKS = 100


def sainte_lague(votes: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> np.ndarray:
    """Seats by the highest quotients ``votes / (2 k + 1)``; at most ``caps`` seats each; ties go to the first.

    The quotients above a divisor give ``floor(votes / divisor + 1/2)`` seats, so the last quotient that gets a seat is
    found by bisection and only seats at that very quotient are dealt one by one.
    """
    votes = np.asarray(votes, float)
    caps = np.asarray(caps if caps is not None else np.full(len(votes), seats), np.int64)
    seats = int(min(seats, caps[votes > 0].sum()))
    if seats <= 0 or not len(votes):
        return np.zeros(len(votes), np.int64)
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = votes[votes > 0].min() / (2 * seats + 2), 2 * votes.max() + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() >= seats:
            low = middle
        else:
            high = middle
    out = given(high)
    while out.sum() < seats:
        quotient = np.where((out < caps) & (votes > 0), votes / (2 * out + 1), -1.0)
        out[int(np.argmax(quotient))] += 1
    return out


def capped_targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> np.ndarray:
    """Targets in proportion to ``weights`` that sum to the sum of ``sizes``, none above ``most`` times its size.

    What a full source leaves is shared out again among the others by weight until no source is above its limit.
    """
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_, rest = np.zeros(len(sizes)), np.ones(len(sizes), bool), sizes.sum()
    while open_.any() and weights[open_].sum() > 0:
        share = np.where(open_, rest * weights / weights[open_].sum(), 0.0)
        full = open_ & (share > most * sizes)
        if not full.any():
            return np.where(open_, share, out)
        out[full] = most * sizes[full]
        rest -= out[full].sum()
        open_ &= ~full
    return out


def cycle_weights(names: Sequence[str | None], cycle: Sequence[float] = (5.0, 2.0, 1.0)) -> list[float]:
    """Weights 5, 2, 1, repeating, over the sources in code point order, null last."""
    ranked = sorted(range(len(names)), key=lambda i: (names[i] is None, [ord(c) for c in names[i] or ""]))
    out = [0.0] * len(names)
    for place, i in enumerate(ranked):
        out[i] = float(cycle[place % len(cycle)])
    return out


def size_column(text: Column | str) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null counts 0."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint"), F.lit(0).cast("bigint"))


def plan_mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Callable[[Sequence[str | None]], Sequence[float]] = cycle_weights,
    seed: int = 42,
    block_words: int = 64,
    shard_words: int = 1_000_000,
    max_shards: int = 4096,
    most: float = 3.0,
    carry_rows: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: what the mix takes of it and, to cut its text, where it lies on its tape.

    Columns ``id, source, size, source_size, target, taken`` (words, repeats counted), then ``start`` (place of the first word),
    ``width, blocks, full, extra, turn, shift`` (the tape's rule) and, with ``carry_rows``, ``row`` (the whole row of ``docs``).
    Null and empty texts have size 0 and nothing taken; null is a source of its own; an empty table gives an
    empty result. Repeated rows share their order key: they may change places, which leaves the result as it is.
    """
    spark = docs.sparkSession
    digest = F.xxhash64(F.coalesce(F.col(text_column), F.lit("")))
    carried = [F.struct("*").alias("row")] if carry_rows else []
    picked = docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), size_column(text_column).alias("size"),
        digest.alias("digest"), *carried,
    )
    small = cut(picked.drop("row"))
    totals = small.groupBy("source").agg(F.sum("size").alias("words")).collect()  # a row per source
    names, sizes = [r["source"] for r in totals], [int(r["words"]) for r in totals]
    targets = capped_targets(sizes, weights(names), most)
    about = spark.createDataFrame(
        [(n, s, float(t), int(min(max_shards, max(1, -(-s // shard_words))))) for n, s, t in zip(names, sizes, targets)],
        "about string, source_size bigint, target double, tapes bigint",
    )

    def placed(rows: DataFrame) -> DataFrame:
        shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id"), F.col("digest")), F.col("tapes"))
        return rows.join(F.broadcast(about), F.col("source").eqNullSafe(F.col("about"))).withColumn("shard", shard)

    tapes = placed(small).groupBy("source", "shard").agg(F.sum("size").alias("words")).where("words > 0")
    rules = spark.createDataFrame(
        _rules(tapes.collect(), names, sizes, targets, block_words, most, seed),  # at most max_shards rows per source
        "rule_source string, rule_shard bigint, width bigint, blocks bigint, full bigint, extra bigint, turn bigint, shift bigint",
    )
    before = (
        Window.partitionBy("source", "shard")
        .orderBy(F.xxhash64(F.lit(seed), F.col("id"), F.col("digest")), "digest", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        placed(picked if carry_rows else small)
        .withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0).cast("bigint")))
        .join(
            F.broadcast(rules),
            F.col("source").eqNullSafe(F.col("rule_source")) & (F.col("shard") == F.col("rule_shard")), "left",
        )
        .withColumn("taken", _taken())
        .select(
            "id", "source", "size", "source_size", "target", "taken", "start", "width", "blocks", "full", "extra", "turn", "shift",
            *(["row"] if carry_rows else []),
        )
    )


def block_width(size: int, block_words: int) -> int:
    """Words of a block of a source: ``block_words``, or less, so that a source has a hundred blocks and a last, shorter one weighs little."""
    return max(1, min(block_words, size // SOURCE_BLOCKS))


def _rules(
    tapes: Sequence, names: Sequence[str | None], sizes: Sequence[int], targets: np.ndarray, block_words: int, most: float, seed: int
) -> list[tuple]:
    """Width of the blocks of every tape, its quota as ``full`` passes and ``extra`` blocks, and its seeded permutation of blocks.

    Sources with blocks of ``block_words`` words share the seats of all of them; one with shorter blocks takes its own target in those.
    """
    widths = [block_width(s, block_words) for s in sizes]
    width_of = dict(zip(names, widths))
    by_source: dict[str | None, list[tuple[int, int]]] = {n: [] for n in names}
    for r in tapes:
        by_source[r["source"]].append((int(r["shard"]), -(-int(r["words"]) // width_of[r["source"]])))
    held = [sum(b for _, b in by_source[n]) for n in names]
    whole = [i for i, w in enumerate(widths) if w == block_words]
    shared = [float(targets[i]) for i in whole]
    seats = [round(float(t) / w) for t, w in zip(targets, widths)]
    for i, n in zip(whole, sainte_lague(shared, round(sum(shared) / block_words), [int(most * held[i]) for i in whole])):
        seats[i] = int(n)
    out = []
    for name, width, total in zip(names, widths, seats):
        own = sorted(by_source[name])
        quotas = sainte_lague([b for _, b in own], int(total), [int(most * b) for _, b in own])
        for (shard, blocks), quota in zip(own, quotas):
            random = np.random.default_rng([seed, shard, blocks])
            turn = int(random.integers(1, blocks + 1))
            while gcd(turn, blocks) > 1:
                turn = int(random.integers(1, blocks + 1))
            full, extra = divmod(int(quota), blocks)
            out.append((name, shard, width, blocks, full, extra, turn, int(random.integers(0, blocks))))
    return out


def times_taken(block: Column) -> Column:
    """How often the mix takes a block: ``full`` times, and once more where the permutation puts it below ``extra``."""
    place = (block * F.col("turn") + F.col("shift")) % F.col("blocks")
    return F.col("full") + (place < F.col("extra")).cast("bigint")


def _taken() -> Column:
    """Words of the row in each block it overlaps, times how often that block is taken."""
    width, end = F.col("width"), F.col("start") + F.col("size")
    first, last = F.floor(F.col("start") / width), F.floor((end - 1) / width)
    words = F.aggregate(
        F.sequence(first, last),
        F.lit(0).cast("bigint"),
        lambda sum_, b: sum_ + times_taken(b) * (F.least(end, (b + 1) * width) - F.greatest(F.col("start"), b * width)),
    )
    return F.when((F.col("size") > 0) & F.col("blocks").isNotNull(), words).otherwise(F.lit(0).cast("bigint"))


def taken_passages(
    data: bytes | None, start: int, rule: Sequence[int], block_words: int, size: int
) -> list[str]:
    """The text's words that are taken at least once, twice, ...: one passage list each, blocks in text order."""
    if not size:
        return []
    blocks, full, extra, turn, shift = rule
    spans = [m.span() for m in WORD.finditer(data)]
    places = range(start // block_words, (start + size - 1) // block_words + 1)
    times = [full + ((b * turn + shift) % blocks < extra) for b in places]
    out = []
    for least in range(1, max(times) + 1):
        pieces, open_ = [], None
        for b, t in zip([*places, None], [*times, 0]):
            if t >= least and open_ is None:
                open_ = max(start, b * block_words) - start
            if t < least and open_ is not None:
                last = (size if b is None else b * block_words - start) - 1
                pieces.append(data[spans[open_][0] : spans[last][1]])
                open_ = None
        out.append(b"\n".join(pieces).decode("utf-8", "replace"))
    return out


def mixed_documents(
    docs: DataFrame, text_column: str = "text", block_words: int = 64, **options
) -> DataFrame:
    """The mix itself: rows of ``docs`` whose text is what is taken, a row for each repeat, all columns kept.

    The first row of a document holds the words taken at least once, the next those taken at least twice, and so
    on; runs of blocks that touch stay as they stand in the text. Documents of which nothing is taken go, as do
    null and empty texts.
    """
    plan = plan_mix(docs, text_column=text_column, block_words=block_words, carry_rows=True, **options)

    @F.pandas_udf("array<string>")
    @tidy_series
    def passages(
        text: pd.Series, start: pd.Series, size: pd.Series, width: pd.Series, blocks: pd.Series, full: pd.Series, extra: pd.Series, turn: pd.Series, shift: pd.Series
    ) -> pd.Series:
        rows = zip(text, start, size, width, blocks, full, extra, turn, shift)
        return pd.Series([taken_passages(t, int(s), [int(x) for x in rule], int(w), int(n)) for t, s, n, w, *rule in rows], dtype=object)

    kept = plan.where("taken > 0").withColumn(
        "passage", passages(as_bytes(F.col(f"row.`{text_column}`")), "start", "size", "width", "blocks", "full", "extra", "turn", "shift")
    )
    rows = kept.select("row", F.explode("passage").alias("passage"))
    return rows.select(*[F.col("passage").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])
