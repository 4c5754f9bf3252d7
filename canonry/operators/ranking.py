"""Ordering operators: distributed dense index, argmax, top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonry.session import cut_lineage

# Fixed value: scores are compared after rounding to this many decimals, so two
# candidates whose scores agree to 1e-9 are a tie (broken by the smallest id).
RANK_DECIMALS = 9


def rank_key(score) -> Column:
    c = F.col(score) if isinstance(score, str) else score
    return F.round(c, RANK_DECIMALS)


def dense_index(df: DataFrame, order_col: str, index_col: str = "index") -> DataFrame:
    """0-based position of each row in ``order_col`` order, without a single-task window.

    ``orderBy`` range-partitions the rows; ``monotonically_increasing_id`` then holds
    (partition << 33) + position inside the partition. The only global step is the
    prefix sum over one count per partition (as many rows as partitions). ``order_col``
    must be unique (apply ``distinct`` first) so the order is deterministic on retry.
    """
    # Materialised once (reliable checkpoint): both branches below must see the same
    # partitions, and AQE may coalesce a re-executed exchange differently.
    tagged = cut_lineage(df.orderBy(order_col)
                         .withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    sizes = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (tagged.join(F.broadcast(offsets), "_pid")  # one row per partition
            .withColumn(index_col, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mid", "_off"))


def argmax_by(group_cols, value_col: str, score_col: str, tie_col: str | None = None,
              df: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Per group, the ``value_col`` with the highest score; tie -> smallest ``tie_col``.

    A partial + final aggregate (``min_by``; ids of any type that orders): no sort, hot groups are combined map-side.
    """
    tie_col = tie_col or value_col
    out = out or value_col
    key = F.struct((-rank_key(score_col)).alias("s"), F.col(tie_col).alias("t"))
    best = F.min_by(F.struct(F.col(value_col).alias("v"), F.col(score_col).alias("score")), key)
    return (df.groupBy(*group_cols).agg(best.alias("_best"))
            .select(*group_cols, F.col("_best.v").alias(out), F.col("_best.score").alias(score_col)))


def top_k(df: DataFrame, group_col: str, score_col: str, id_col: str, k: int,
          rank_col: str = "rank") -> DataFrame:
    """k best rows per group by score desc, then smallest id; rank is 1-based.

    Spark plans ``row_number() <= k`` with a WindowGroupLimit, which trims each
    group to k rows before the shuffle.
    """
    w = Window.partitionBy(group_col).orderBy(rank_key(score_col).desc(), F.col(id_col).asc())
    return (df.withColumn(rank_col, F.row_number().over(w))
            .filter(F.col(rank_col) <= k))
