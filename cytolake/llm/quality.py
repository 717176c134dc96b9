"""Document quality by regularised quadratic discriminant analysis of document statistics.

Each text becomes a short vector of transformed statistics. Per class the mean and the covariance are summed up over
the labelled training documents; the covariance is shrunk towards its diagonal and towards a round one, so it can always be
factored. The Cholesky factor is inverted once per model; a score is the logistic of the difference
of the two log densities (Mahalanobis term and determinant) plus the log prior ratio.

All labelled documents count; only ``2 (1 + d + d^2)`` sums reach the driver, whatever the input.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytolake.llm.text import as_bytes, crc_mod
from cytolake.runtime import cut

FEATURES = [
    "log_word_length", "upper", "symbols", "punctuation", "high_bytes",
    "vocabulary", "echoes", "top_word", "line_copies", "log_line_words", "sentence_ends", "shouts",
]

# byte classes of the statistics
_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_ORDINARY = list(b".,;:!?'\"()-")
_SPACE = list(b" \t\n\x0b\x0c\r")
_SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum() and b not in _ORDINARY]
#: added to a share before its logarithm
FLOOR = 0.02
#: unremarkable words every text is credited with: the statistics of a few words say little
EVIDENCE = 20


def statistics(data: bytes | None) -> list[float]:
    """Transformed statistics of a text, in the order of ``FEATURES``; an empty or null text has no NaN either."""
    data = data or b""
    share = lambda part, whole: log(FLOOR + part / (whole + EVIDENCE))
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, ink = len(words), len(data) - int(counts[_SPACE].sum())
    upper, lower, high = int(counts[_UPPER].sum()), int(counts[_LOWER].sum()), int(counts[128:].sum())
    seen = Counter(words)
    ends = sum(c for w, c in seen.items() if w[-1:] in b".?!")
    shouts = sum(c for w, c in seen.items() if w.endswith(b"!!"))
    return [
        log1p((ink + 5 * EVIDENCE) / (n + EVIDENCE)),
        share(upper, upper + lower + high / 2),
        share(int(counts[_SYMBOLS].sum()), ink),
        share(int(counts[_ORDINARY].sum()), ink),
        share(high, ink),
        log1p(len(seen) + EVIDENCE) / log1p(n + EVIDENCE),
        share(sum(map(eq, words, words[1:])), n),
        share(max(seen.values(), default=0), n),
        share(len(lines) - len(set(lines)), len(lines)),
        log1p((n + EVIDENCE) / (len(lines) + 1)),
        share(ends, n),
        share(shouts, n),
    ]


def statistics_column(text: Column | str) -> Column:
    """The statistics of a string column as an array of doubles."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts], dtype=object)

    return run(as_bytes(text))


@dataclass
class Quadratic:
    """Prior log odds of label 1, and per class mean, inverse Cholesky factor and log determinant (None: prior only)."""

    log_odds: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        z = np.full(len(x), self.log_odds)
        if self.classes:
            densities = [-0.5 * (((x - m) @ inverse.T) ** 2).sum(axis=1) - 0.5 * d for m, inverse, d in self.classes]
            z += densities[1] - densities[0]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700)))


def shrunk(covariance: np.ndarray, to_diagonal: float, to_round: float) -> np.ndarray:
    d = len(covariance)
    half = (1 - to_diagonal) * covariance + to_diagonal * np.diag(np.diag(covariance))
    return (1 - to_round) * half + to_round * max(np.trace(covariance) / d, 1e-6) * np.eye(d)


def fit(rows: DataFrame, to_diagonal: float = 0.1, to_round: float = 0.05) -> Quadratic:
    """Model of rows ``(x: array<double>, label: int 0 or 1)``; other labels and nulls are left out.

    With fewer than two rows of either class only the prior, smoothed by one row each, is used.
    """
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(-1, d)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[label == k]
                total[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        place = np.arange(total.size)
        yield pa.RecordBatch.from_pydict({"place": pa.array(place, pa.int32()), "part": pa.array(total.ravel())})

    parts = (
        rows.where("label in (0, 1) and x is not null").select("x", F.col("label").cast("int").alias("label"))
        .mapInArrow(sums, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
    )  # 2 (1 + d + d^2) rows
    total = np.zeros(2 * (1 + d + d * d))
    for r in parts:
        total[r["place"]] = r["part"]
    total = total.reshape(2, -1)
    n = total[:, 0]
    prior = log((n[1] + 1) / (n[0] + 1))
    if n.min() < 2:
        return Quadratic(prior, None)
    classes = []
    for k in (0, 1):
        mean = total[k, 1 : 1 + d] / n[k]
        covariance = total[k, 1 + d :].reshape(d, d) / n[k] - np.outer(mean, mean)
        factor = np.linalg.cholesky(shrunk(covariance, to_diagonal, to_round))
        classes.append((mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    return Quadratic(prior, classes)


def score_column(model: Quadratic, x: Column | str) -> Column:
    @F.pandas_udf("double")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(rows.tolist(), float).reshape(-1, len(FEATURES))))

    return run(x)


def _one_label(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """One label per id: the majority of its rows, 1 on a tie; rows without id or label say nothing."""
    own = labels.select(F.col(id_column).alias("label_id"), F.col(label_column).alias("label")).where("label in (0, 1)")
    return own.where("label_id is not null").groupBy("label_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    threshold: float = 0.3,
    held_out_remainder: int = 0,
) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    Labels are learned only from documents that are not held out. Null counts as an empty text and is scored; a
    document that repeats is scored as often and counts as often; an empty table gives an empty result. Other
    columns are not read.
    """
    rows = cut(docs.select(F.col(id_column).alias("id"), statistics_column(text_column).alias("x")))
    held_out = crc_mod("id") == held_out_remainder
    model = fit(rows.where(~held_out).join(_one_label(labels, id_column, label_column), F.col("id") == F.col("label_id")))
    scored = rows.select(F.col("id").alias("doc_id"), held_out.alias("held_out"), score_column(model, "x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    threshold: float = 0.3,
    held_out_remainder: int = 0,
) -> DataFrame:
    """``docs`` without the documents the classifier rejects; columns as they were, nulls scored as empty texts."""
    rows = cut(
        docs.where(crc_mod(id_column) != held_out_remainder).select(F.col(id_column).alias("id"), statistics_column(text_column).alias("x"))
    )  # short rows meet the labels, not texts
    model = fit(rows.join(_one_label(labels, id_column, label_column), F.col("id") == F.col("label_id")))
    scored = docs.select(F.struct("*").alias("row")).withColumn(
        "score", score_column(model, statistics_column(F.col(f"row.`{text_column}`")))
    )
    return scored.where(F.col("score") >= threshold).select("row.*")
