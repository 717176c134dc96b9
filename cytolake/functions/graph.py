"""Connected components of an edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.runtime import cut


def _towards_minimum(edges: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step: neighbours of every node re-attach to the smallest of them.

    ``keep_larger`` walks both directions and moves only larger neighbours; otherwise each
    node moves its smaller neighbours and itself. The minimum is a partial
    aggregate and the re-attachment an equi join that AQE can split on a hub node.
    """
    if keep_larger:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = arcs.join(low, "u")
    if keep_larger:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` edges of comparable ids -> ``(node, root)``, root = smallest node of the component.

    Alternates large-star and small-star steps until the edge set stops changing;
    the number of rounds grows with the logarithm of the graph. Nodes without edges
    do not appear.
    """
    current = cut(edges.select("u", "v").where("u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    seen = print_of(current)
    if seen["n"] == 0:
        return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        current = cut(_towards_minimum(_towards_minimum(current, True), False))
        now = print_of(current)
        if now == seen:
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = now
