"""Metric report lines: ``<Name>: <value with 5 decimals>``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def report_lines(metrics: DataFrame, names: dict[str, str]) -> DataFrame:
    """One-row metrics -> (line_no, line); ``names`` maps column -> printed name, in order."""
    items = [F.struct(F.lit(i).alias("line_no"),
                      F.format_string("%s: %.5f", F.lit(label), F.col(col).cast("double")).alias("line"))
             for i, (col, label) in enumerate(names.items())]
    return metrics.select(F.explode(F.array(*items)).alias("r")).select("r.line_no", "r.line")


def write_report(lines: DataFrame, path: str) -> None:
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
