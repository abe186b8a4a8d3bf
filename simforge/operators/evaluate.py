"""Label metrics as one aggregation pass.

Counts come from conditional sums in a single ``agg`` (partial aggregation
map-side, one tiny shuffle); the ratios are computed from the counts:
precision/recall/F1 are 0 when undefined, ROC AUC on hard 0/1 predictions is
``(TPR + TNR) / 2`` and null when only one class is present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNT_COLUMNS = ["tn", "fp", "fn", "tp"]
METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1_score", "roc_auc_score"]


def _counts(y: Column, p: Column, where: Column | None, prefix: str = "") -> list[Column]:
    w = F.lit(True) if where is None else where
    y1 = y.cast("int") == 1
    p1 = F.coalesce(p.cast("int") == 1, F.lit(False))  # a layer without a verdict has not passed
    return [
        F.count_if(w & ~y1 & ~p1).alias(prefix + "tn"),
        F.count_if(w & ~y1 & p1).alias(prefix + "fp"),
        F.count_if(w & y1 & ~p1).alias(prefix + "fn"),
        F.count_if(w & y1 & p1).alias(prefix + "tp"),
    ]


def metrics_from_counts(tn: Column, fp: Column, fn: Column, tp: Column, digits: int = 6) -> list[Column]:
    tn, fp, fn, tp = (c.cast("double") for c in (tn, fp, fn, tp))
    n = tn + fp + fn + tp

    def safe(num, den):
        return F.when(den > 0, num / den).otherwise(F.lit(0.0))

    acc = F.when(n > 0, (tp + tn) / n)
    prec = safe(tp, tp + fp)
    rec = safe(tp, tp + fn)
    f1 = safe(2 * tp, 2 * tp + fp + fn)
    auc = F.when((tp + fn > 0) & (tn + fp > 0), (tp / (tp + fn) + tn / (tn + fp)) / 2)
    return [F.round(acc, digits).alias("accuracy"), F.round(prec, digits).alias("precision"),
            F.round(rec, digits).alias("recall"), F.round(f1, digits).alias("f1_score"),
            F.round(auc, digits).alias("roc_auc_score")]


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """E1-E6 over a whole frame: counts + metrics, one row."""
    c = df.agg(*_counts(F.col(label), F.col(prediction), None))
    return c.select(*[F.col(x).cast("long") for x in COUNT_COLUMNS],
                    *metrics_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def confusion_matrix(metrics: DataFrame) -> DataFrame:
    """E1 in the original's nested shape ``[[TN, FP], [FN, TP]]``."""
    return metrics.withColumn("confusion_matrix", F.array(F.array("tn", "fp"), F.array("fn", "tp")))


def layer_counts(label: str = "labels") -> list[Column]:
    """Twelve conditional counts: E1 on the rows that reached each layer of a batch cascade."""
    y = F.col(label)
    l1, l2, l3 = (F.col(f"{x}_Layer_Pass") for x in ("First", "Second", "Third"))
    return (_counts(y, l1, None, "l1_") + _counts(y, l2, ~l1, "l2_") +
            _counts(y, l3, ~l1 & ~F.coalesce(l2, F.lit(False)), "l3_"))


def metrics_of_layers(wide: DataFrame) -> DataFrame:
    """Three rows (layer 1..3) from one row of :func:`layer_counts`."""
    rows = F.explode(F.array(*[
        F.struct(F.lit(i).alias("layer"), *[F.col(f"l{i}_{c}").cast("long").alias(c) for c in COUNT_COLUMNS])
        for i in (1, 2, 3)]))
    long = wide.select(rows.alias("r")).select("r.*")
    return long.select("layer", *COUNT_COLUMNS,
                       *metrics_from_counts(F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")))


def layer_metrics(scored: DataFrame, label: str = "labels") -> DataFrame:
    """Metrics on the rows that *reached* each layer of a batch cascade, in one pass."""
    return metrics_of_layers(scored.agg(*layer_counts(label)))


def scale_labels(pairs: DataFrame, scale: float = 5.0) -> DataFrame:
    """Training-pair view: names as strings, labels / 5.0."""
    return pairs.select(F.col("name1").cast("string").alias("name1"),
                        F.col("name2").cast("string").alias("name2"),
                        (F.col("labels") / F.lit(scale)).alias("similarity"))
