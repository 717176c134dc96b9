"""Language model scores by a probabilistic suffix tree.

Symbols are the bytes of the normalised text (A-Z lower-cased, words joined by one space) and one end symbol, so a text is
the same sequence of words and end whichever symbols are counted. A context is the last 1 to ``depth`` symbols. It becomes
a state when it makes up at least ``least_share`` of all training symbols and its next-symbol distribution diverges from that of its suffix
by at least ``divergence`` nats a symbol, and over all its occurrences by more than its number of next symbols explains (``evidence`` times
that number times the log of the occurrences); all parts of a state's context are states as well. A state's
distribution is smoothed with that of its suffix, the root's with a uniform one. Each symbol is
scored by the state of the longest suffix of what precedes it.

At most ``depth / least_share`` contexts can reach the share, whatever the size of the corpus, so the finished tree has a
proven bound and travels to the tasks as a table of transitions. Counting covers all training texts and is one
shuffle of the distinct (context, next) pairs of each task.

The unigram base of the words has no such bound: its counts stay distributed and meet the documents by blocks.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.llm.blocks import block_documents, block_words, numbers_of, word_counts
from cytolake.llm.text import as_bytes, crc_mod, words_of
from cytolake.llm.workers import give_back, tidy
from cytolake.runtime import cut

END = 256
SPACE = 32
SYMBOLS = 257
#: bits of a symbol in a packed context
WIDTH = 9
MASK = (1 << WIDTH) - 1
BLOCK_BYTES = 32 << 20


def symbols_of(data: bytes | None) -> np.ndarray:
    """Bytes of the normalised text, then the end."""
    raw = np.frombuffer(b" ".join(words_of(data)), np.uint8).astype(np.int64)
    return np.append(raw, END)


def grams(texts: list[bytes | None], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of ``depth + 1`` symbols, packed with the last one lowest, and their counts.

    Before a text stand spaces, as if a word had just ended.
    """
    pad = np.full(depth, SPACE, np.int64)
    parts = [np.concatenate([pad, symbols_of(t)]) for t in texts]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    whole = np.concatenate(parts)
    is_pad = np.zeros(len(whole), bool)
    starts = np.array([0, *accumulate(map(len, parts))][:-1])
    for k in range(depth):
        is_pad[starts + k] = True
    packed = np.zeros(len(whole), np.int64)
    for k in range(depth + 1):
        packed[k:] |= whole[: len(whole) - k] << (WIDTH * k)
    return np.unique(packed[~is_pad], return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], np.concatenate([n for _, n in parts])[order]
    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def count_grams(texts: DataFrame, depth: int, chunk_bytes: int = 2 << 20, most_keys: int = 2_000_000) -> DataFrame:
    """``(gram, n)`` over the one column of ``texts`` (bytes); counts are added up in chunks before the shuffle.

    A task holds up to ``most_keys`` counted grams and about half as many that wait to be added to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        held, size, total, waiting = [], 0, none, []

        def out(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 200_000):
                yield pa.RecordBatch.from_pydict({"gram": pa.array(keys[at : at + 200_000]), "n": pa.array(counts[at : at + 200_000])})

        for batch in batches:
            for text in batch.column(0):
                held.append(text.as_py())
                size += len(held[-1] or b"")
                if size < chunk_bytes:
                    continue
                waiting.append(grams(held, depth))
                held, size = [], 0
                if sum(len(k) for k, _ in waiting) > most_keys // 2:
                    total, waiting = added([total, *waiting]), []
                    if len(total[0]) > most_keys:  # the rest is added up in the shuffle
                        yield from out(*total)
                        total = none
        yield from out(*added([total, *waiting, grams(held, depth)]))

    return texts.mapInArrow(tidy(run), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def tree_rows(counts: DataFrame, depth: int, least_share: float, divergence: float, evidence: float) -> DataFrame:
    """``(depth, context, next, n)`` of all states of depth 1 and more, and of the root as depth 0.

    ``context`` is packed with the latest symbol lowest. Kept are the contexts that pass both tests, and all parts of theirs.
    """
    levels = counts.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"), "gram", "n").select(
        "depth",
        F.expr(f"(gram >> {WIDTH}) & (shiftleft(1L, {WIDTH} * depth) - 1)").alias("context"),
        F.col("gram").bitwiseAND(F.lit(MASK)).alias("next"), "n",
    )
    rows = cut(levels.groupBy("depth", "context", "next").agg(F.sum("n").alias("n")))
    total = rows.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    sums = rows.groupBy("depth", "context").agg(F.sum("n").alias("all_n")).where(F.col("all_n") >= max(1.0, least_share * total))
    frequent = cut(rows.join(sums, ["depth", "context"]))
    of_parent = frequent.select(
        (F.col("depth") + 1).alias("depth"), F.col("context").alias("parent"), "next", (F.col("n") / F.col("all_n")).alias("q")
    )
    parent = F.expr(f"context & (shiftleft(1L, {WIDTH} * (depth - 1)) - 1)")
    tested = (
        frequent.where("depth > 0").withColumn("parent", parent).join(of_parent, ["depth", "parent", "next"])
        .groupBy("depth", "context").agg(
            F.sum(F.col("n") / F.col("all_n") * F.log(F.col("n") / F.col("all_n") / F.col("q"))).alias("gain"),
            F.first("all_n").alias("all_n"), F.count(F.lit(1)).alias("symbols"),
        )
        .where((F.col("gain") >= divergence) & (F.col("gain") * F.col("all_n") >= evidence * F.col("symbols") * F.log("all_n")))
    )
    # every run of symbols inside a kept context: from i symbols back, of length d
    parts = tested.select("depth", "context", F.explode(F.expr("sequence(1, depth)")).alias("d")).select(
        "context", "d", F.explode(F.expr("sequence(0, depth - d)")).alias("i")
    )
    states = parts.select(F.col("d").alias("depth"), F.expr(f"(context >> ({WIDTH} * i)) & (shiftleft(1L, {WIDTH} * d) - 1)").alias("context")).distinct()
    inner = frequent.join(states, ["depth", "context"], "left_semi").select("depth", "context", "next", "n")
    return inner.unionByName(frequent.where("depth = 0").select("depth", "context", "next", "n"))


@dataclass
class SuffixTree:
    """Transitions and log10 probabilities of states (rows, root first) and symbol classes (columns).

    ``column`` gives the class of a symbol; symbols never seen in training share the last one.
    """

    depth: int
    column: np.ndarray
    following: np.ndarray
    log10: np.ndarray

    def score(self, texts: list[bytes | None], lane: int = 256) -> np.ndarray:
        """log10 probability of each text with its end.

        Texts are cut into lanes of equal length that all step at once; a lane starts with the ``depth``
        symbols before it, which determine its state whatever came earlier.
        """
        return Steps.of(self).score(texts, lane)


@dataclass
class Steps:
    """A tree as it is scored: each state and class has one number, the place of the next state below and the bits of the log10 probability
    above, so a step looks up once. The class after the last one stands behind a text's end and costs nothing."""

    depth: int
    column: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, tree: SuffixTree) -> "Steps":
        states, classes = tree.log10.shape
        if states * (classes + 1) > np.iinfo(np.int32).max:
            raise ValueError("more states than a step can name")
        both = np.zeros((states, classes + 1, 2), "<i4")
        both[:, :classes, 0] = tree.following * np.int32(classes + 1)
        both[:, :classes, 1] = tree.log10.astype("<f4", copy=False).view("<i4")
        return cls(tree.depth, tree.column.astype(np.int32), both.view("<i8")[..., 0])

    def score(self, texts: list[bytes | None], lane: int = 256) -> np.ndarray:
        sequences = [np.frombuffer(b" ".join(words_of(t)), np.uint8) for t in texts]
        lengths = np.array([len(s) + 1 for s in sequences], np.int64)
        lanes = -(-lengths // lane)
        first = np.concatenate([[0], np.cumsum(lanes)])
        out = np.zeros(len(texts))
        if not len(texts):
            return out
        none = self.places.shape[1] - 1
        table = np.full((int(first[-1]), self.depth + lane), none, np.int32)
        table[:, : self.depth] = self.column[SPACE]
        for s, at in zip(sequences, first[:-1].tolist()):
            n = -(-(len(s) + 1) // lane)
            padded = np.full(n * lane, none, np.int32)
            padded[: len(s)] = self.column[s]
            padded[len(s)] = self.column[END]
            table[at : at + n, self.depth :] = padded.reshape(n, lane)
            if n > 1:
                table[at + 1 : at + n, : self.depth] = table[at : at + n - 1, lane:]
        places = self.places.ravel()
        sums = np.zeros(len(table))
        for at in range(0, len(table), 8192):
            steps = np.ascontiguousarray(table[at : at + 8192].T)
            state = np.zeros(steps.shape[1], np.int32)
            total = np.zeros(steps.shape[1])
            for k, step in enumerate(steps):
                found = places.take(state + step)
                state = found.view("<i4")[::2]
                if k >= self.depth:
                    total += found.view("<f4")[1::2]
            sums[at : at + 8192] = total
        return np.add.reduceat(sums, first[:-1])


def build_tree(rows: pd.DataFrame, depth: int, smoothing: float = 3.0) -> SuffixTree:
    """Tree of ``(depth, context, next, n)``.

    Each distinct symbol seen after a context lends ``smoothing`` counts to the distribution of its suffix: contexts that
    are followed by many different symbols rely more on what is shorter.
    """
    seen = np.unique(np.concatenate([rows["next"].to_numpy(np.int64), [SPACE, END]]))
    classes = len(seen) + 1
    column = np.full(SYMBOLS, classes - 1, np.int64)
    column[seen] = np.arange(len(seen))
    unseen = SYMBOLS - len(seen)
    own = rows[rows["depth"] > 0][["depth", "context"]].drop_duplicates().sort_values(["depth", "context"])
    depths, contexts = own["depth"].to_numpy(np.int64), own["context"].to_numpy(np.int64)
    key = lambda d, c: (np.asarray(d, np.int64) << 56) | np.asarray(c, np.int64)
    keys = np.concatenate([[0], key(depths, contexts)])  # ascending, root first
    find = lambda d, c: np.searchsorted(keys, key(d, c))
    all_depths, all_contexts = np.concatenate([[0], depths]), np.concatenate([[0], contexts])
    counts = np.zeros((len(keys), classes), np.float32)  # a probability is asked for, not a count
    np.add.at(counts, (find(rows["depth"], rows["context"]), column[rows["next"].to_numpy(np.int64)]), rows["n"].to_numpy(np.float32))
    chance, following = np.zeros_like(counts), np.zeros(counts.shape, np.int32)
    total = counts[0].sum(dtype=float)
    chance[0] = (counts[0] + 0.5) / (total + 0.5 * SYMBOLS)  # the last class holds any one unseen symbol
    up = find(np.maximum(all_depths - 1, 0), all_contexts & ((1 << (WIDTH * np.maximum(all_depths - 1, 0))) - 1))
    before = find(np.maximum(all_depths - 1, 0), all_contexts >> WIDTH)  # the context without its latest symbol
    latest = column[all_contexts & MASK]
    if unseen == 0:
        chance[0, -1] = 0.5 / (total + 0.5 * SYMBOLS)
    for d in range(depth + 1):
        level = np.flatnonzero(all_depths == d)
        if d:
            n = counts[level].sum(axis=1, keepdims=True)
            weight = smoothing * (counts[level] > 0).sum(axis=1, keepdims=True)
            chance[level] = (counts[level] + weight * chance[up[level]]) / (n + weight)
            following[level] = following[up[level]]
        longer = np.flatnonzero(all_depths == d + 1)  # reached from a state of this depth by one symbol
        following[before[longer], latest[longer]] = longer
    return SuffixTree(depth, column, following, np.log10(chance, out=chance))


def train_tree(
    texts: DataFrame, depth: int = 6, least_share: float = 5e-6, divergence: float = 0.02, evidence: float = 0.25,
    smoothing: float = 3.0,
) -> SuffixTree:
    """Tree of the one column of ``texts`` (bytes). The rows that reach the driver are those of its states alone."""
    rows = tree_rows(count_grams(texts, depth), depth, least_share, divergence, evidence).toArrow()  # columns, not a row object each
    return build_tree(rows.to_pandas(), depth, smoothing)


def model_scores(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    held_out_remainder: int = 1,
    depth: int = 6,
    least_share: float = 5e-6,
    divergence: float = 0.02,
    evidence: float = 0.25,
    smoothing: float = 3.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    Learned from the documents that are not held out. Tokens are the words and one end. Null and empty texts
    are the end alone; rows that repeat count as often; without training texts the base is 0 for each token and the tree
    is uniform; an empty table gives an empty result; other columns are not read. ``docs`` is a scan of files or a
    checkpoint.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("id"),
        (crc_mod(id_column) == held_out_remainder).alias("held_out"),
        as_bytes(text_column).alias("text"),
    )
    tree = train_tree(rows.where(~F.col("held_out")).select("text"), depth, least_share, divergence, evidence, smoothing)
    tables = spark.sparkContext.broadcast(Steps.of(tree))
    del tree

    def score(texts: list[bytes | None]) -> np.ndarray:
        return tables.value.score(texts)

    learned = rows.where(~F.col("held_out")).select("text")
    counts = cut(word_counts(learned, words_of, block_bytes).groupBy("word").agg(F.sum("n").alias("c")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = learned.count()
    n, v = int(sums[0]) + ends, int(sums[1]) + (ends > 0)
    scale = float(n + 0.5 * (v + 1))
    # words of held-out texts alone have no row: their count is 0
    placed = block_words(rows, words_of, block_bytes).join(counts, "word").select("block", "number", "c")

    def base(numbered: pa.Table, documents: pa.Table) -> pa.Table:
        named = numbered.column("number").to_numpy()
        known = np.zeros(int(named.max(initial=-1)) + 2, np.int64)  # the last one is that of all words beyond: 0
        known[named] = numbered.column("c").to_numpy()
        chance = np.log10((known + 0.5) / scale)
        end = float(np.log10((ends + 0.5) / scale))
        tokens, seen, scores = [], [], []
        for packed in documents.column("numbers").to_pylist():
            own = numbers_of(packed)
            tokens.append(len(own) + 1)
            seen.append(int((known.take(own, mode="clip") > 0).sum()) + (ends > 0))
            scores.append(float(chance.take(own, mode="clip").sum()) + end)
        give_back()
        return pa.table({
            "doc_id": documents.column("id"), "held_out": documents.column("held_out"), "n_tokens": pa.array(tokens, pa.int64()),
            "n_known": pa.array(seen, pa.int64()), "train_tokens": pa.array([n] * len(tokens), pa.int64()),
            "base_score": pa.array(scores, pa.float64()), "score": documents.column("score"),
        })

    documents = block_documents(rows, words_of, block_bytes, "id bigint, held_out boolean", score)
    return placed.groupBy("block").cogroup(documents.groupBy("block")).applyInArrow(
        base, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
