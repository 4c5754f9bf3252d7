"""Evaluation of a learner on labelled rows as one call, with its report file (CLS4, GEN3).

Each call returns the one-row metrics; given a ``report_path`` it also writes the report's lines there (one small
text file) and computes the metrics once for both. Predictions stay in Spark: only the confusion counts are gathered.
Every row of the input counts, also rows with equal ids, unknown or null labels and null texts; without rows the metrics are null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators import metrics
from canonry.operators.classify import predict_labels
from canonry.operators.labels import encode_labels
from canonry.operators.serve import Standardizer
from canonry.session import cut_lineage
from canonry.sources.report import report_lines, write_report

# Fixed value: the name of the share of exact matches in a report.
EXACT_MATCH = {"exact_match": "Exact Match"}


def _reported(found: DataFrame, lines, report_path: str | None) -> DataFrame:
    if report_path is None:
        return found
    found = cut_lineage(found, name="metrics")  # one row: the report and the caller read it
    write_report(lines(found), report_path)
    return found


def evaluate_classifier(std: Standardizer, df: DataFrame, id_col: str, text_col: str, name_col: str,
                        report_path: str | None = None) -> DataFrame:
    """Accuracy and weighted precision, recall and F1 of naive Bayes on (id, text, true name) rows."""
    pred = predict_labels(std.model, df, id_col, text_col, keep_cols=(name_col,)).select(name_col, F.col("label").alias("p"))
    pairs = encode_labels(pred, std.vocab, name_col, "y")
    return _reported(metrics.classification_metrics(pairs, "y", "p"), metrics.metrics_report, report_path)


def evaluate_generation(df: DataFrame, name_col: str, generated_col: str, report_path: str | None = None) -> DataFrame:
    """Share of generated names that equal the true one."""
    return _reported(metrics.exact_match(df, name_col, generated_col), lambda m: report_lines(m, EXACT_MATCH), report_path)
