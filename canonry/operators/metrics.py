"""Evaluation as aggregations: accuracy, confusion, weighted P/R/F1, exact match.

Everything is computed from the confusion counts ``groupBy(y, p).count()`` (partial
aggregation, at most classes^2 rows), so no prediction ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.sources.report import report_lines

# Fixed value: published metrics are rounded to this many decimals.
METRIC_DECIMALS = 9

# Report layout (rule line, then metric names in this order).
REPORT_RULE = "*" * 80
REPORT_NAMES = {"accuracy": "Accuracy", "weighted_f1": "F1 Score",
                "weighted_precision": "Precision", "weighted_recall": "Recall"}


def _hit(y, p):
    return F.coalesce(F.col(y) == F.col(p), F.lit(False))


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.round(F.avg(_hit(y, p).cast("double")), METRIC_DECIMALS).alias("accuracy"))


def exact_match(df: DataFrame, truth: str = "entity_name", pred: str = "entity_pred") -> DataFrame:
    """Share of rows whose prediction equals the truth; NULL on either side is wrong."""
    return df.agg(F.round(F.avg(_hit(truth, pred).cast("double")), METRIC_DECIMALS).alias("exact_match"))


def confusion(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1 (zero_division = 0)."""
    conf = confusion(df, y, p)
    # Each confusion cell counts once as its true class and once as its predicted class:
    # one explode of two roles, so the predictions under ``conf`` are evaluated once.
    zero = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("y").alias("c"), F.col("n").alias("support"),
                 F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(zero).alias("tp"), zero.alias("pred")),
        F.struct(F.col("p").alias("c"), zero.alias("support"), zero.alias("tp"), F.col("n").alias("pred")))
    per = (conf.select(F.inline(roles)).groupBy("c")
           .agg(F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("pred").alias("pred")))
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.withColumn("prec", prec).withColumn("rec", rec).withColumn(
        "f1", F.when(F.col("prec") + F.col("rec") > 0,
                     2 * F.col("prec") * F.col("rec") / (F.col("prec") + F.col("rec"))).otherwise(F.lit(0.0)))
    total = F.sum("support")
    r = lambda e: F.round(e, METRIC_DECIMALS)
    return per.agg(
        r(F.sum("tp") / total).alias("accuracy"),
        r(F.sum(F.col("support") * F.col("prec")) / total).alias("weighted_precision"),
        r(F.sum(F.col("support") * F.col("rec")) / total).alias("weighted_recall"),
        r(F.sum(F.col("support") * F.col("f1")) / total).alias("weighted_f1"))


def metrics_report(metrics: DataFrame) -> DataFrame:
    """(line_no, line): an 80-star rule, then 'Accuracy: 0.xxxxx' etc. in report order."""
    body = report_lines(metrics, REPORT_NAMES).withColumn("line_no", F.col("line_no") + 1)
    rule = metrics.select(F.lit(0).alias("line_no"), F.lit(REPORT_RULE).alias("line"))
    return rule.unionByName(body)
