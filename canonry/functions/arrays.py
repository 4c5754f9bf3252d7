"""Array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def replace_sentinel(arr, sentinel: int = -100, pad: int = 0) -> Column:
    """Replace a sentinel value in an integer array (label padding ``-100`` -> pad id)."""
    c = F.col(arr) if isinstance(arr, str) else arr
    return F.transform(c, lambda x: F.when(x == F.lit(sentinel), F.lit(pad)).otherwise(x))
