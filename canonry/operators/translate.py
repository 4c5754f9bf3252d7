"""Free-form name generation with IBM Model 1 (Brown et al. 1993) trained by EM.

Source tokens are the words of the normalised mention, target tokens the words of
the canonical name (case kept), duplicates kept, no NULL word. One EM iteration:

* E-step: for each row and target token t, ``p(t|s)`` is normalised over the row's
  source tokens (a window over one row's tokens: bounded by the row);
* M-step: expected counts summed by (s, t) (partial aggregation, so a frequent
  pair or token is combined map-side), divided by their sum per s.

Rows are reduced once to (row, s, ms, t, mt) with multiplicities, so repeated
tokens cost nothing extra. Each iteration's table is cut with a reliable
checkpoint: lineage stays one iteration long and a lost executor replays only it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canonry.functions.text import explode_terms, split_whitespace
from canonry.operators.ranking import rank_key
from canonry.operators.sizing import DEFAULT_BROADCAST_ROWS, bounded_broadcast, row_bound_ok
from canonry.session import cut_lineage, cut_lineage_bucketed

# Decoding defaults.
DEFAULT_MIN_P = 0.5


def alignment_rows(df: DataFrame, id_col: str, src_col: str, tgt_col: str) -> DataFrame:
    """(row, s, ms, t, mt): every source/target token pair of a row, with multiplicities."""
    src = explode_terms(df, [F.col(id_col).alias("row")], src_col, "word", term_col="s") \
        .groupBy("row", "s").agg(F.count(F.lit(1)).alias("ms"))
    tgt = df.select(F.col(id_col).alias("row"), F.explode(split_whitespace(tgt_col)).alias("t")) \
            .groupBy("row", "t").agg(F.count(F.lit(1)).alias("mt"))
    return src.join(tgt, "row")


def train_translation(df: DataFrame, id_col: str = "row_id", src_col: str = "input", tgt_col: str = "output",
                      iterations: int = 5, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(s, t, p) with p = t(t | s) after ``iterations`` EM steps from a uniform start.

    The alignment rows are written once, bucketed by row: each iteration's E-step
    window over (row, t) then reads its bucket in place (no exchange), and the only
    shuffle per iteration is the partially aggregated (s, t) sum. The (s, t) table
    has the same rows in every iteration, so its size is checked once; the per-s
    totals have no more rows than it.
    """
    rows = cut_lineage_bucketed(alignment_rows(df, id_col, src_col, tgt_col), "row", name="ibm1-rows")
    table = cut_lineage(rows.select("s", "t").distinct().withColumn("p", F.lit(1.0)), name="ibm1-table")
    small = row_bound_ok(table, max_broadcast_rows)
    side = F.broadcast if small else (lambda x: x)
    per_row_target = Window.partitionBy("row", "t")
    for _ in range(iterations):
        j = rows.join(side(table), ["s", "t"])
        j = j.withColumn("w", F.col("ms") * F.col("p"))
        j = j.withColumn("c", F.col("w") / F.sum("w").over(per_row_target) * F.col("mt"))
        counts = j.groupBy("s", "t").agg(F.sum("c").alias("c"))
        totals = counts.groupBy("s").agg(F.sum("c").alias("cs"))
        table = cut_lineage(counts.join(side(totals), "s")
                            .select("s", "t", (F.col("c") / F.col("cs")).alias("p")), name="ibm1-table")
    return table


def best_targets(table: DataFrame) -> DataFrame:
    """(s, t, p): per source token the target with the highest p, then the smallest string."""
    best = F.min(F.struct((-rank_key("p")).alias("np"), F.col("t").alias("t"), F.col("p").alias("p")))
    return table.groupBy("s").agg(best.alias("b")).select("s", F.col("b.t").alias("t"), F.col("b.p").alias("p"))


def generate_names(table: DataFrame, df: DataFrame, id_col: str, src_col: str, min_p: float = DEFAULT_MIN_P,
                   max_len: int | None = None, out: str = "generated",
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Each known source token, in order, becomes its best target if ``p >= min_p``;
    the first occurrence of each target is kept (at most ``max_len`` if given), joined by a
    space. Rows with no emitted token get the empty string. One row out per row in.
    """
    best = bounded_broadcast(best_targets(table).where(rank_key("p") >= F.lit(min_p)), max_broadcast_rows)
    toks = explode_terms(df, [F.col(id_col).alias("_id")], src_col, "word", with_pos=True, term_col="s")
    emitted = toks.join(best, "s").groupBy("_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("_seq"))
    words = F.array_distinct(F.transform("_seq", lambda x: x["t"]))
    if max_len is not None:
        words = F.slice(words, 1, max_len)
    gen = emitted.select(F.col("_id").alias(id_col), F.array_join(words, " ").alias(out))
    return df.join(gen, id_col, "left").withColumn(out, F.coalesce(F.col(out), F.lit("")))
