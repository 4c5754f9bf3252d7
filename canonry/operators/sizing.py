"""Size checks that guard every broadcast.

A side is broadcast only after a count (partial per task, then one row each) proves it
small. Beyond the bound the join is left to a shuffle (sort-merge with AQE skew splitting).

A proof is remembered per DataFrame object (immutable plan), and an operator that
already knows a table's row count (it wrote or counted it) records it with
``note_rows``, so the same table is never counted twice.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults; override per call.
DEFAULT_BROADCAST_ROWS = 1_000_000

# DataFrame -> its row count.
_KNOWN: "weakref.WeakKeyDictionary[DataFrame, int]" = weakref.WeakKeyDictionary()


def note_rows(df: DataFrame, n: int) -> DataFrame:
    """Record that ``df`` has exactly ``n`` rows; returns ``df``."""
    _KNOWN[df] = int(n)
    return df


def row_bound_ok(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows."""
    if df not in _KNOWN:
        note_rows(df, df.count())
    return _KNOWN[df] <= max_rows


def broadcast_if(df: DataFrame, proof: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if ``proof`` (a DataFrame with the same rows, e.g. df's source
    before a projection) is proven to hold at most ``max_rows`` rows."""
    return F.broadcast(df) if row_bound_ok(proof, max_rows) else df


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """``broadcast(df)`` if its row count is proven <= max_rows, else ``df`` unchanged."""
    return broadcast_if(df, df, max_rows)


def scalar(df: DataFrame, default=None):
    """First column of a one-row aggregate (model metadata such as N or V)."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]
