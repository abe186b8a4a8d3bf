"""Review-table operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW_KEY = ("query_file_name", "similar_file_name")
REVIEW_COLUMNS = ["merchant_id_x", "merchant_id_y", "query_image_url", "similar_image_url", "labels", "score"]


def object_url_columns(reviews: DataFrame, base_url: str) -> DataFrame:
    """The URLs of both objects; a missing file name has none. Idempotent."""
    base = F.lit(base_url if base_url.endswith("/") else base_url + "/")
    return reviews.withColumns({
        "query_image_url": F.concat(base, F.col("query_file_name")),
        "similar_image_url": F.concat(base, F.col("similar_file_name")),
    })


def with_default_column(df: DataFrame, name: str = "labels", default: str = "") -> DataFrame:
    """R2: add a column with a default value where the table lacks it."""
    return df if name in df.columns else df.withColumn(name, F.lit(default))


def overlay_corrections(reviews: DataFrame, corrections: DataFrame, key=REVIEW_KEY,
                        order_col: str = "submitted", fields=("labels", "score")) -> DataFrame:
    """New values where supplied, else the old ones; both become strings.

    ``corrections`` holds the key, ``order_col`` and the fields; a null field
    was not supplied, an empty string was. Of several corrections of a key the
    last one that supplies a field wins; equal times go to the larger value.
    """
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct(F.col(order_col).alias("at"), F.col(f).cast("string").alias("value"))))
            .getField("value").alias(f"_new_{f}") for f in fields]
    latest = corrections.groupBy(*key).agg(*last)
    out = reviews.join(latest, list(key), "left")
    out = out.withColumns({f: F.coalesce(F.col(f"_new_{f}"), F.col(f).cast("string")) for f in fields})
    return out.select(*reviews.columns)


def review_table(reviews: DataFrame) -> DataFrame:
    """The columns of the review page, in display order."""
    return reviews.select(*REVIEW_COLUMNS)

