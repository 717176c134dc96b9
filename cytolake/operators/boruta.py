"""Boruta feature selection: forests of many rounds grown together, level by level.

Values become bins, one byte each, and samples are dealt by hash to blocks, so a block of a feature is a short run of bytes. A shadow
is a feature whose blocks change places and whose samples are permuted within them. The trees of a batch of rounds take one
aggregate per level: every task adds up class weights by (round, tree, node, feature, bin), Spark sums them, finds the best
bin of each row of sums and the best row of each node. Only chosen splits reach the driver.

Rounds hang on each other only through rejections, as rejected features leave the forest. A batch is grown as if there were none; if a round
rejects a feature, the later rounds of the batch are thrown away and grown again without it. Where a round is work for the whole
cluster, a batch ends with the first round that can reject one, so none is thrown away. The result is that of one round after the other.
"""

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cytolake.functions.ordering import positions
from cytolake.operators.matrix import feature_names
from cytolake.runtime import cut

BINS = 32
#: samples of a block
BLOCK_SAMPLES = 4096
#: trees whose sums go to Spark together
TREES_PER_BATCH = 500
#: decimals of a gain that count: sums of tasks may meet in any order
GAIN_DECIMALS = 9


def _dice(*numbers: int) -> np.random.Generator:
    return np.random.default_rng(numbers)


def shadow_order(seed: int, round_no: int, feature: int, block: int, size: int) -> np.ndarray:
    """Order in which a shadow takes the samples of a block."""
    return _dice(seed, 1, round_no, feature, block).permutation(size)


def drawn(seed: int, round_no: int, tree: int, block: int, size: int) -> np.ndarray:
    """How often a tree draws each sample of a block."""
    return _dice(seed, 2, round_no, tree, block).poisson(1.0, size)


def tried(seed: int, round_no: int, tree: int, node: int, columns: int) -> np.ndarray:
    """The columns that a node may split by: as many as the root of their number."""
    return np.sort(_dice(seed, 3, round_no, tree, node).choice(columns, max(1, math.isqrt(columns)), replace=False))


def forest_size(columns: int, max_depth: int) -> int:
    """Trees so that each of ``columns`` columns is tried about a hundred times."""
    return max(1, int(100 * math.sqrt(columns) / max_depth))


def binomial_tail(hits: int, rounds: int) -> float:
    """P(X >= hits) for X ~ Binomial(rounds, 1/2)."""
    return sum(math.comb(rounds, i) for i in range(hits, rounds + 1)) / 2.0**rounds


def _fdr(ps: dict[str, float], alpha: float) -> set[str]:
    """Benjamini-Hochberg."""
    ordered = sorted(ps, key=ps.get)
    kept = 0
    for i, name in enumerate(ordered, 1):
        if ps[name] <= alpha * i / len(ordered):
            kept = i
    return set(ordered[:kept])


def decide(hits: dict[str, int], decision: dict[str, str], done: int, alpha: float) -> dict[str, str]:
    """Decisions after ``done`` rounds: hits improbable under a fair coin, by FDR over features and Bonferroni over rounds."""
    active = [f for f in hits if decision[f] != "rejected"]
    high = {f: binomial_tail(hits[f], done) for f in active}
    low = {f: binomial_tail(done - hits[f], done) for f in active}
    keep, drop = _fdr(high, alpha), _fdr(low, alpha)
    out = dict(decision)
    for f in active:
        if decision[f] == "tentative" and f in keep and high[f] <= alpha / done:
            out[f] = "confirmed"
        elif decision[f] == "tentative" and f in drop and low[f] <= alpha / done:
            out[f] = "rejected"
    return out


def open_rounds(hits: dict[str, int], decision: dict[str, str], done: int, alpha: float, rounds: int) -> int:
    """The first round, at most ``rounds``, after which a feature can be rejected or none be tentative, whatever the rounds up to it find."""
    left = [f for f in hits if decision[f] == "tentative"]

    def first(passes: Callable[[str, int], float], f: str) -> int:
        return next((d for d in range(done + 1, rounds) if passes(f, d) <= alpha / d), rounds)

    rejected = min(first(lambda f, d: binomial_tail(d - hits[f], d), f) for f in left)  # no hits from here on
    confirmed = max(first(lambda f, d: binomial_tail(hits[f] + d - done, d), f) for f in left)  # hits only
    return min(rejected, confirmed)


# --- layout -----------------------------------------------------------------------------------


def binned(labelled: DataFrame, names: Sequence[str], seed: int, bins: int, block_samples: int) -> tuple[DataFrame, DataFrame, int]:
    """``(block, feature, bins)`` and ``(block, size, labels)``, a byte per sample in the same order, and the number of blocks.

    A sample without a value of some feature is an error.
    """
    samples = labelled.select("slide_id", "label").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "slide_id"))
    order = cut(positions(samples, [], "_h", "sample_ord").withColumn("sample_ord", F.col("sample_ord") - 1).drop("_h"))
    n = order.count()
    blocks = max(1, -(-n // block_samples))
    block = F.floor(F.col("sample_ord") * blocks / n)
    order = order.withColumn("block", block)
    bounds = labelled.groupBy("feature").agg(F.percentile_approx("value", [k / bins for k in range(1, bins)], 10_000).alias("bounds"))
    index = labelled.sparkSession.createDataFrame(list(enumerate(names)), "f int, feature string")
    looked_up = F.broadcast(bounds.join(index, "feature"))  # a row per feature, as many numbers as bins
    place = F.size(F.filter("bounds", lambda b: b < F.col("value"))).cast("tinyint")
    values = labelled.select("slide_id", "feature", "value").where("value is not null").join(looked_up, "feature")
    told = values.join(order, "slide_id").select("block", "f", "sample_ord", place.alias("bin"))
    cells = told.groupBy("block", "f").agg(F.sort_array(F.collect_list(F.struct("sample_ord", "bin"))).alias("cells"))
    labels = order.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("sample_ord", F.col("label").cast("tinyint").alias("label")))).alias("own"))
    labels = labels.select("block", F.size("own").alias("size"), F.transform("own", lambda c: c["label"]).alias("labels"))
    whole = cells.join(labels.select("block", "size"), "block").select(
        "block", "f", F.when(F.size("cells") == F.col("size"), F.transform("cells", lambda c: c["bin"]))
        .otherwise(F.raise_error(F.lit("a sample lacks a value of a feature")).cast("array<tinyint>")).alias("bins"),
    )
    return cut(whole), cut(labels), blocks


def _steps(modulus: int, dice: np.random.Generator) -> tuple[int, int]:
    """(factor, shift) of a permutation of 0..modulus-1."""
    factor = int(dice.integers(1, max(2, modulus)))
    while math.gcd(factor, modulus) != 1:
        factor = int(dice.integers(1, max(2, modulus)))
    return factor, int(dice.integers(0, max(1, modulus)))


def _layout(columns: DataFrame, labels: DataFrame, blocks: int, samples: int, active: Sequence[int], rounds: Sequence[int], seed: int) -> DataFrame:
    """``(round, block, labels, real, shadows)``: for each round the bins of the active features and of their shadows.

    A shadow's block comes from another block of the same size: blocks differ by one sample, and each size has its own permutation.
    """
    large = samples - (samples // blocks) * blocks  # so many blocks have a sample more
    moves = []
    for r in rounds:
        for f in active:
            dice = _dice(seed, 4, r, f)
            moves.append((r, f, *_steps(max(1, large), dice), *_steps(max(1, blocks - large), dice)))
    table = columns.sparkSession.createDataFrame(moves, "round int, f int, a bigint, b bigint, c bigint, d bigint")
    by_size = Window.partitionBy(F.lit(0)).orderBy(F.col("size").desc(), "block")  # a row per block
    ranked = labels.select("block", F.row_number().over(by_size).alias("rank"))
    place = (F.col("rank") - 1).cast("bigint")
    to = F.when(place < large, F.pmod(place * F.col("a") + F.col("b"), F.lit(max(1, large)))).otherwise(
        F.pmod((place - large) * F.col("c") + F.col("d"), F.lit(max(1, blocks - large))) + large
    )
    placed = columns.join(F.broadcast(table), "f").join(ranked.select("block", "rank"), "block").select("round", "f", "bins", to.alias("to"))
    targets = ranked.select(F.col("block"), place.alias("to"))
    shadows = placed.join(targets, "to").groupBy("round", "block").agg(F.sort_array(F.collect_list(F.struct("f", "bins"))).alias("shadows"))
    real = columns.where(F.col("f").isin(list(active))).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("f", "bins"))).alias("real"))
    bytes_of = lambda c: F.flatten(F.transform(c, lambda x: x["bins"]))
    # the blocks of a round meet in a few tasks, as each of these sends the sums of all trees of the round
    spread = -(-2 * columns.sparkSession.sparkContext.defaultParallelism // len(rounds))
    both = shadows.join(real, "block").join(labels.select("block", "labels"), "block")
    both = both.repartitionById(len(rounds) * spread, ((F.col("round") - rounds[0]) * spread + F.col("block") % spread).cast("int"))
    return cut(both.select("round", "block", "labels", bytes_of("real").alias("real"), bytes_of("shadows").alias("shadows")))


# --- trees ------------------------------------------------------------------------------------

Trees = dict[tuple[int, int], dict[int, tuple[int, int]]]


def _nodes(matrix: np.ndarray, splits: dict[int, tuple[int, int]], depth: int) -> np.ndarray:
    """Node of every sample after ``depth`` levels, numbered 1, 2 and 3, 4 to 7 ..; 0 in a leaf above."""
    at = np.ones(matrix.shape[1], np.int64)
    if depth == 0:
        return at
    numbers = np.array(sorted(splits) or [0])
    columns = np.array([splits[n][0] for n in sorted(splits)] or [0])
    limits = np.array([splits[n][1] for n in sorted(splits)] or [0])
    samples = np.arange(matrix.shape[1])
    for _ in range(depth):
        k = np.minimum(np.searchsorted(numbers, at), len(numbers) - 1)
        right = matrix[columns[k], samples] > limits[k]
        at = np.where((numbers[k] == at) & (at > 0), 2 * at + right, 0)
    return at


def level_sums(cells: np.ndarray, weights: np.ndarray, at: np.ndarray, frontier: np.ndarray, candidates: np.ndarray, bins: int) -> np.ndarray:
    """Weights by (node of the frontier, candidate column, bin, class) of one tree; ``cells`` has twice the bin plus the class of (column, sample)."""
    if frontier[0] == 1:  # the root holds all samples
        return np.stack([np.bincount(cells[c], weights, bins * 2) for c in candidates[0].tolist()])[None]
    held = np.flatnonzero((weights > 0) & np.isin(at, frontier))
    node = np.searchsorted(frontier, at[held])
    tries = candidates.shape[1]
    keys = (node[None, :] * tries + np.arange(tries)[:, None]) * (bins * 2) + cells[candidates[node].T, held[None, :]]  # (tries, samples)
    size = len(frontier) * tries * bins * 2
    return np.bincount(keys.ravel(), np.broadcast_to(weights[held], keys.shape).ravel(), size).reshape(len(frontier), tries, bins * 2)


def best_bins(sums: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of (bin, class) weights the last bin of the left side of the best split, and its gain: weight times Gini decrease."""
    by = sums.reshape(-1, bins, 2)
    left = np.cumsum(by, axis=1)
    total = left[:, -1:, :]
    right = total - left

    def impure(w: np.ndarray) -> np.ndarray:
        n = w.sum(axis=-1)
        return np.where(n > 0, 2 * w[..., 0] * w[..., 1] / np.where(n > 0, n, 1), 0.0)

    gain = impure(total) - impure(left) - impure(right)
    empty = (left.sum(axis=-1) <= 0) | (right.sum(axis=-1) <= 1e-9)
    gain = np.round(np.where(empty, 0.0, gain), GAIN_DECIMALS)
    at = gain.argmax(axis=1)
    return at, gain[np.arange(len(gain)), at]


@dataclass(frozen=True)
class Forests:
    """What all trees of a batch of rounds share. Columns are the active features, then their shadows."""

    active: tuple[int, ...]
    balance: tuple[float, float]
    seed: int
    trees: int
    max_depth: int
    bins: int

    @property
    def columns(self) -> int:
        return 2 * len(self.active)

    def importances(self, layout: DataFrame, rounds: Sequence[int]) -> dict[int, np.ndarray]:
        """By round the mean over its trees of each column's share in the tree's gains."""
        splits: Trees = {(r, t): {} for r in rounds for t in range(self.trees)}
        gains: dict[tuple[int, int], list[tuple[int, float]]] = {k: [] for k in splits}
        frontier = {k: np.array([1]) for k in splits}
        for depth in range(self.max_depth):
            for tree, node, column, last, gain in self._level(layout, depth, splits, frontier):
                splits[tree][node] = (column, last)
                gains[tree].append((column, gain))
            children = {k: [c for n in v.tolist() if n in splits[k] for c in (2 * n, 2 * n + 1)] for k, v in frontier.items()}
            frontier = {k: np.array(sorted(v)) for k, v in children.items() if v}
            if not frontier:
                break
        out = {r: np.zeros(self.columns) for r in rounds}
        for (r, _), own in gains.items():
            shares = np.bincount([c for c, _ in own] or [0], [g for _, g in own] or [0.0], self.columns)
            out[r] += shares / shares.sum() if own else 0
        return {r: np.round(v / self.trees, 12) for r, v in out.items()}

    def _matrix(self, round_no: int, block: int, real: np.ndarray, shadows: np.ndarray) -> np.ndarray:
        size = real.shape[1]
        moved = [s[shadow_order(self.seed, round_no, f, block, size)] for f, s in zip(self.active, shadows)]
        return np.concatenate([real, np.stack(moved)])

    def _level(self, layout: DataFrame, depth: int, splits: Trees, frontier: dict[tuple[int, int], np.ndarray]):
        """``((round, tree), node, column, last bin on the left, gain)`` of the nodes of a level that are split."""
        shipped = layout.sparkSession.sparkContext.broadcast((splits, frontier))  # nodes of one batch of rounds
        names = [f"h{i}" for i in range(2 * self.bins)]
        keys = ["round", "tree", "node", "column"]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done, open_now = shipped.value
            of_round: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            for (r, t), nodes in open_now.items():
                of_round.setdefault(r, []).append((t, nodes))
            total, tries = {}, {}
            for batch in batches:
                for r, block, labels, real, shadows in zip(*[batch.column(c) for c in ("round", "block", "labels", "real", "shadows")]):
                    r, block, labels = r.as_py(), block.as_py(), labels.values.to_numpy().astype(np.int64)
                    if r not in of_round:
                        continue
                    matrix = self._matrix(r, block, *(x.values.to_numpy().reshape(-1, len(labels)) for x in (real, shadows)))
                    weight_of = np.array(self.balance)[labels]
                    cells = matrix.astype(np.int64) * 2 + labels
                    for t, nodes in of_round[r]:
                        if (r, t) not in tries:
                            tries[r, t] = np.stack([tried(self.seed, r, t, int(node), self.columns) for node in nodes])
                        weights = drawn(self.seed, r, t, block, len(labels)) * weight_of
                        now = level_sums(cells, weights, _nodes(matrix, done[r, t], depth), nodes, tries[r, t], self.bins)
                        total[r, t] = total[r, t] + now if (r, t) in total else now
            grown = list(total)
            for start in range(0, len(grown), TREES_PER_BATCH):  # many rows to a batch, as each has many columns
                some = grown[start : start + TREES_PER_BATCH]
                flat = np.concatenate([total[k].reshape(-1, 2 * self.bins) for k in some])
                rows = [tries[k].size for k in some]
                own = [np.repeat(np.array([k[i] for k in some], np.int32), rows) for i in (0, 1)]
                own += [np.concatenate([np.repeat(open_now[k], tries[k].shape[1]) for k in some]), np.concatenate([tries[k].ravel() for k in some]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, *np.ascontiguousarray(flat.T))], names=[*keys, *names])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, gain = best_bins(np.stack([batch.column(n).to_numpy() for n in names], axis=1), self.bins)
                columns = [*(batch.column(c) for c in keys), pa.array(at.astype(np.int32)), pa.array(gain)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "last", "gain"])

        kinds = "round int, tree int, node bigint, column int"
        parts = layout.mapInArrow(sums, f"{kinds}, " + ", ".join(f"{n} double" for n in names))
        whole = parts.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
        found = whole.mapInArrow(best, f"{kinds}, last int, gain double").where("gain > 0")
        choice = F.max(F.struct("gain", (-F.col("column")).alias("column"), (-F.col("last")).alias("last"))).alias("best")
        for row in found.groupBy("round", "tree", "node").agg(choice).collect():  # a row per open node of a batch
            yield (row["round"], row["tree"]), row["node"], -row["best"]["column"], -row["best"]["last"], row["best"]["gain"]


def boruta(
    labelled: DataFrame,
    rounds: int = 100,
    max_depth: int = 15,
    trees: int | None = 100,
    seed: int = 1,
    alpha: float = 0.05,
    bins: int = BINS,
    batch: int = 10,
    block_samples: int = BLOCK_SAMPLES,
) -> DataFrame:
    """(feature, hits, rounds, decision): forest importance against that of shuffled copies.

    A feature scores a hit when its importance beats every shadow's. It is confirmed or rejected once its
    hits are improbable under a fair coin (FDR over features, Bonferroni over rounds); rejected
    features leave the forest. An empty selection is a valid result. Classes are balanced by weights, samples drawn with
    replacement for each tree. ``trees=None`` grows as many as let each column be tried about a hundred times.
    ``batch`` rounds are grown together at first, more while none is thrown away; it changes the time, not the result.
    """
    names = feature_names(labelled)
    columns, labels, blocks = binned(labelled, names, seed, bins, block_samples)
    counts = labels.select(F.explode("labels").alias("label")).groupBy("label").count()
    sizes = {r["label"]: r["count"] for r in counts.collect()}
    n = sum(sizes.values())
    balance = tuple(n / (2 * sizes[c]) if c in sizes else 0.0 for c in (0, 1))
    hits, decision, done, together = dict.fromkeys(names, 0), dict.fromkeys(names, "tentative"), 0, batch
    while done < rounds and "tentative" in decision.values():
        active = tuple(i for i, f in enumerate(names) if decision[f] != "rejected")
        last = min(rounds, done + together)
        if blocks >= labelled.sparkSession.sparkContext.defaultParallelism:  # a round fills the cluster: none is grown in vain
            last = min(last, open_rounds(hits, decision, done, alpha, rounds))
        numbers = list(range(done + 1, last + 1))
        size = trees or forest_size(2 * len(active), max_depth)
        forests = Forests(active, balance, seed, size, max_depth, bins)
        found = forests.importances(_layout(columns, labels, blocks, n, active, numbers, seed), numbers)
        for done in numbers:
            importance = found[done]
            bar = importance[len(active) :].max()
            for i, f in enumerate(active):
                hits[names[f]] += int(importance[i] > bar)
            before, decision = decision, decide(hits, decision, done, alpha)
            left = [f for f in names if decision[f] == "rejected"] != [f for f in names if before[f] == "rejected"]
            if left or "tentative" not in decision.values():
                together = batch
                break  # later rounds have another forest
        else:
            together = min(2 * together, 4 * batch)
    rows = [(f, hits[f], done, decision[f]) for f in names]
    return labelled.sparkSession.createDataFrame(rows, "feature string, hits int, rounds int, decision string")
