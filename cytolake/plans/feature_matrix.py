"""From result documents to the labelled feature matrix."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytolake.functions import text as TX
from cytolake.operators import documents as DOC


def matrix_from_documents(docs: DataFrame) -> DataFrame:
    """(slide_id, doc) -> (slide_id, feature, value) with repeated leaves named by their ancestors.

    Values that are no number are dropped for their feature only, so the others keep their place.
    """
    leaves = DOC.document_leaves(docs)
    flat = DOC.rename_by_ancestors(leaves, ["slide_id"])
    return DOC.numeric_features(flat).where(F.col("value").isNotNull())


def labels_from_names(
    slides: DataFrame, negative: str = "no_response", positive: str = "response"
) -> DataFrame:
    """Label and sample id taken from the slide name."""
    return slides.select("slide_id").distinct().select(
        "slide_id",
        TX.label_from_name(F.col("slide_id"), negative, positive).alias("label"),
        TX.sample_from_name(F.col("slide_id"), negative, positive).alias("sample"),
    )
