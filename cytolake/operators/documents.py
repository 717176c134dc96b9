"""Flattening of nested result documents."""

from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Leaf names that repeat below several parents.
REPEATED_LEAVES = [
    f"{measure}_{stat}"
    for measure in ("areas", "circularities", "aspectratios", "dist")
    for stat in ("mean", "std", "median", "MAD", "skewness", "kurt", "iqr")
]


@F.pandas_udf(T.IntegerType())
def _depth(braces: pd.Series) -> pd.Series:
    """Deepest nesting of a text of braces."""
    return pd.Series([max(accumulate((1 if c == "{" else -1) for c in b or ""), default=0) for b in braces], dtype="int32")


def deepest_object(docs: DataFrame, doc: str = "doc") -> int:
    """Levels of nested objects in the deepest document; strings do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.col(doc), r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^{}]", "")
    return docs.agg(F.max(_depth(bare))).first()[0] or 0


def document_leaves(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Leaves of nested JSON objects: the other columns, ``path`` (names from the root), ``ord`` (position
    at each level, so leaves sort in document order) and ``raw`` (JSON text). Empty objects vanish.

    Each pass opens one more level in place, as many as the deepest document has: a chain of projections without any
    shuffle.
    """
    keep = [c for c in docs.columns if c != doc]
    empty = lambda t: F.array().cast(f"array<{t}>")
    level = docs.select(*keep, empty("string").alias("path"), empty("int").alias("ord"), F.col(doc).alias("raw"))
    nested = F.coalesce(F.startswith(F.col("raw"), F.lit("{")), F.lit(False))
    for _ in range(deepest_object(docs, doc)):
        children = F.transform(
            F.map_entries(F.from_json("raw", "map<string,string>")),
            lambda e, i: F.struct(
                F.concat("path", F.array(e["key"])).alias("path"),
                F.concat("ord", F.array(i)).alias("ord"),
                e["value"].alias("raw"),
            ),
        )
        itself = F.array(F.struct("path", "ord", "raw"))
        level = level.select(*keep, F.explode(F.when(nested, children).otherwise(itself)).alias("_n")).select(
            *keep, "_n.path", "_n.ord", "_n.raw"
        )
    return level


def full_name(sep: str = "_") -> Column:
    return F.concat_ws(sep, "path")


def leaf_name() -> Column:
    return F.element_at("path", -1)


def flatten_full(leaves: DataFrame, keys: Sequence[str], sep: str = "_") -> DataFrame:
    """Names are whole paths; of equal names the last one in document order counts."""
    return _last_wins(leaves.withColumn("feature", full_name(sep)), keys)


def flatten_leaf(leaves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Names are leaf names only; of equal names the last one in document order counts."""
    return _last_wins(leaves.withColumn("feature", leaf_name()), keys)


def rename_by_ancestors(
    leaves: DataFrame, keys: Sequence[str], listed: Sequence[str] = REPEATED_LEAVES, levels: int = 2
) -> DataFrame:
    """Leaf names, but a listed one is prefixed by up to ``levels`` of its ancestors."""
    repeated = leaf_name().isin(list(listed))
    tail = F.slice("path", -F.least(F.size("path"), F.lit(levels + 1)), levels + 1)
    return _last_wins(
        leaves.withColumn("feature", F.when(repeated, F.concat_ws("_", tail)).otherwise(leaf_name())), keys
    )


def _last_wins(named: DataFrame, keys: Sequence[str]) -> DataFrame:
    # positions compare level by level, i.e. in document order
    return named.groupBy(*keys, "feature").agg(F.max_by("raw", "ord").alias("raw"))


def numeric_features(flat: DataFrame) -> DataFrame:
    """Feature text -> (.., feature, value double); text that is no number is missing."""
    return flat.withColumn("value", F.expr("try_cast(raw as double)")).drop("raw")
