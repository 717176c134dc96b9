"""The driver tables viewed as slides, masks, tiles and feature matrices, and the queries over them."""

from workloads import learning, segments, spatial, tables
from workloads.registry import QUERIES, SQL
from workloads.spatial import inside_counts

__all__ = ["QUERIES", "SQL", "inside_counts"]
