"""Linear models on the first k features of a ranking, for every k and every fold together.

The models of a sweep differ by fold and by how many ranked features they see, and read the same rows. One pass over the rows adds up what all
of them need, by (fold, k), so a sweep takes a handful of jobs, whatever the number of folds and counts.

Ridge regression needs one Gram matrix per fold; its Cholesky factor holds those of all prefixes. Logistic regression is
fitted by Newton steps: a pass adds up loss, gradient and Hessian of every model, and one task per model takes the step. Steps
that do not lower the loss are halved. Only coefficients reach the driver, about ``folds * features^2 / 2`` numbers.
"""

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.operators.models import DEFAULT_ALPHA, DEFAULT_C
from cytolake.runtime import cut

#: largest change of a coefficient in the last step, and a bound of steps that convex losses stay far below
CONVERGED = 1e-9
STEPS = 100
#: feature values of a task
TASK_VALUES = 1 << 22

Order = Mapping[int, Sequence[str]]
Key = tuple[int, int]


def sample_rows(labelled: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(slide_id, fold, label, x)`` of long rows (slide_id, fold, label, feature, value), ``x`` in the order of ``names``.

    A sample without a value of some feature is an error.
    """
    index = F.broadcast(labelled.sparkSession.createDataFrame(list(enumerate(names)), "i int, feature string"))  # a row per feature
    cells = labelled.where("value is not null").join(index, "feature").groupBy("slide_id", "fold", "label")
    held = cells.agg(F.sort_array(F.collect_list(F.struct("i", F.col("value").cast("double").alias("value")))).alias("cells"))
    whole = F.when(F.size("cells") == len(names), F.transform("cells", lambda c: c["value"]))
    missing = F.raise_error(F.lit("a sample lacks a value of a feature")).cast("array<double>")
    return held.select("slide_id", "fold", "label", whole.otherwise(missing).alias("x"))


def _by_fold(rows: DataFrame, folds: Sequence[int]) -> dict[int, tuple[int, dict[int, float]]]:
    """Size of each fold's training part and its balanced class weights."""
    counts = rows.groupBy("fold", "label").count().collect()  # a row per fold and class
    out = {}
    for f in folds:
        sizes: dict[int, int] = {}
        for r in counts:
            if r["fold"] != f:
                sizes[r["label"]] = sizes.get(r["label"], 0) + r["count"]
        n = sum(sizes.values())
        out[f] = (n, {c: n / (len(sizes) * m) for c, m in sizes.items()})
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        yield batch.column("fold").to_numpy(), batch.column("label").to_numpy().astype(np.int64), x


def _dealt(rows: DataFrame, width: int) -> DataFrame:
    """Stored rows in no more tasks than their values or the cores ask for: each task sends the sums of every model."""
    held = cut(rows)
    enough = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() * width // TASK_VALUES))
    return held.coalesce(enough)


def _summed(parts: dict[Key, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (f, k), part in parts.items():
        yield pa.RecordBatch.from_pydict({"f": pa.array([f], pa.int32()), "k": pa.array([k], pa.int32()), "part": pa.array([part], pa.list_(pa.float64()))})


def _solved(rows: DataFrame, sums, solve: Callable[[Key, np.ndarray], np.ndarray]) -> dict[Key, np.ndarray]:
    """``solve`` of the sums of each model, in a task per model; the tasks' parts are added in order of their first number."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for part in batch.column("part"):
                total = total + part.values.to_numpy()
        f, k = (x.as_py() for x in key)
        yield pa.RecordBatch.from_pydict({"f": pa.array([f], pa.int32()), "k": pa.array([k], pa.int32()), "out": pa.array([solve((f, k), total)], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(sums, "f int, k int, part array<double>")
    found = parts.groupBy("f", "k").applyInArrow(run, "f int, k int, out array<double>").collect()
    return {(r["f"], r["k"]): np.array(r["out"]) for r in found}


def logistic_prefixes(rows: DataFrame, names: Sequence[str], order: Order, ks: Sequence[int], C: float = DEFAULT_C) -> dict[Key, np.ndarray]:
    """Intercept and coefficients by (fold, k), in rank order; classes are balanced, the penalty counts samples as ``1 / C``."""
    about, width = _by_fold(rows, list(order)), len(names)
    places = {f: [names.index(n) for n in ranked] for f, ranked in order.items()}
    # coefficients, the step that led to them, and the least loss so far
    state = {(f, k): (np.zeros(k + 1), np.zeros(k + 1), np.inf) for f in order for k in ks if 0 < k <= len(order[f])}
    done: dict[Key, np.ndarray] = {}
    for _ in range(STEPS):
        if not state:
            return done
        shipped = rows.sparkSession.sparkContext.broadcast({key: v[0] for key, v in state.items()})

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            betas, total = shipped.value, {}
            for fold, label, x in _blocks(batches, width):
                for f in {f for f, _ in betas}:
                    held = fold != f
                    if not held.any():
                        continue
                    a = np.column_stack([np.ones(int(held.sum())), x[held][:, places[f]]])
                    y = label[held]
                    w = np.array([about[f][1][c] for c in y.tolist()])
                    for k in (k for g, k in betas if g == f):
                        b = a[:, : k + 1]
                        z = b @ betas[f, k]
                        p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                        loss = w @ (np.logaddexp(0, z) - y * z)
                        hessian = (b * (w * p * (1 - p))[:, None]).T @ b
                        now = np.concatenate([[loss], b.T @ (w * (p - y)), hessian[np.triu_indices(k + 1)]])
                        total[f, k] = total[f, k] + now if (f, k) in total else now
            yield from _summed(total)

        def step(key: Key, total: np.ndarray) -> np.ndarray:
            beta, last, least = state[key]
            free = np.r_[0.0, np.ones(len(beta) - 1)]  # the intercept has no penalty
            loss = total[0] + free @ beta**2 / (2 * C)
            if not loss <= least + 1e-9 * abs(least):
                return np.concatenate([beta - last / 2, last / 2, [least]])
            size = len(beta)
            gradient = total[1 : size + 1] + free * beta / C
            hessian = np.zeros((size, size))
            hessian[np.triu_indices(size)] = total[size + 1 :]
            hessian += np.triu(hessian, 1).T + np.diag(free / C)
            move = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
            return np.concatenate([beta + move, move, [loss]])

        found = _solved(rows, sums, step)
        state = {key: (v[: key[1] + 1], v[key[1] + 1 : -1], v[-1]) for key, v in found.items()}
        done |= {key: v[0] for key, v in state.items() if np.abs(v[1]).max() <= CONVERGED * (1 + np.abs(v[0]).max())}
        state = {key: v for key, v in state.items() if key not in done}
    return done | {key: v[0] for key, v in state.items()}


def ridge_prefixes(rows: DataFrame, names: Sequence[str], order: Order, ks: Sequence[int], alpha: float = DEFAULT_ALPHA) -> dict[Key, np.ndarray]:
    """Intercept and coefficients by (fold, k) of least squares on labels -1 and 1; one job for all."""
    about, width = _by_fold(rows, list(order)), len(names)
    places = {f: [names.index(n) for n in ranked] for f, ranked in order.items()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for fold, label, x in _blocks(batches, width):
            for f in order:
                held = fold != f
                a = np.column_stack([np.ones(int(held.sum())), x[held][:, places[f]], 2.0 * label[held] - 1])
                total[f, 0] = total.get((f, 0), 0) + (a.T @ a).ravel()
        yield from _summed(total)

    grams = _solved(rows, sums, lambda key, total: total)
    out = {}
    for (f, _), gram in grams.items():
        n, size = about[f][0], len(order[f])
        g = gram.reshape(size + 2, size + 2)
        means = g[0] / n
        centred = g - n * np.outer(means, means)  # columns minus their means: the intercept needs no row
        penalised = centred[1:-1, 1:-1] + alpha * np.eye(size)
        try:
            lower = np.linalg.cholesky(penalised)
        except np.linalg.LinAlgError:  # dependent features and no penalty: least squares of least length
            lower = None
        right = centred[1:-1, -1]
        forward = None if lower is None else np.linalg.solve(lower, right)
        for k in ks:
            if 0 < k <= size:
                if lower is None:
                    w = np.linalg.lstsq(penalised[:k, :k], right[:k], rcond=None)[0]
                else:
                    w = np.linalg.solve(lower[:k, :k].T, forward[:k])  # the first k rows of the factor are the prefix's own
                out[f, k] = np.r_[means[-1] - means[1 : k + 1] @ w, w]
    return out


#: model -> joint fit
JOINT = {"logistic": logistic_prefixes, "ridge": ridge_prefixes}


def prefix_scores(
    rows: DataFrame, names: Sequence[str], order: Order, ks: Sequence[int], model: str, threshold: float = 0.5, **params
) -> DataFrame:
    """(fold, k, score): balanced accuracy on each fold of the model fitted on the others, for every count of ranked features.

    ``order`` gives each fold its ranked features; folds without any have no score, and a count beyond a fold's list is left out. A
    fold whose training part has one class is fitted all the same.
    """
    if model not in JOINT:
        raise ValueError(f"no joint fit of {model}; choose one of {sorted(JOINT)}")
    order = {f: list(ranked) for f, ranked in order.items() if ranked}
    width = len(names)
    held = _dealt(rows, width)
    betas = JOINT[model](held, names, order, ks, **params)
    places = {f: [names.index(n) for n in ranked] for f, ranked in order.items()}
    shipped = held.sparkSession.sparkContext.broadcast(betas)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fold, label, x in _blocks(batches, width):
            found = []
            for (f, k), beta in shipped.value.items():
                own = fold == f
                z = beta[0] + x[own][:, places[f][:k]] @ beta[1:]
                proba = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if model == "logistic" else (z + 1) / 2
                right = (proba > threshold) == (label[own] == 1)
                found += [(f, k, int(c), int((label[own] == c).sum()), int(right[label[own] == c].sum())) for c in np.unique(label[own])]
            columns = list(zip(*found)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["fold", "k", "label", "n", "right"])

    told = held.mapInArrow(judge, "fold int, k int, label int, n bigint, right bigint")
    recall = told.groupBy("fold", "k", "label").agg((F.sum("right") / F.sum("n")).alias("recall"))
    return recall.groupBy("fold", "k").agg(F.avg("recall").alias("score"))
