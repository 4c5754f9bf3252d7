"""Filter interaction audit: exact Shapley shares of five filters, by constrained least squares.

A document fails a set of the filters, one of 32 patterns. Spark counts each part's documents per
pattern (with the good and the toxic ones) and from these tabulates, for each of the 32 coalitions of filters, how many documents the
coalition removes. Per part the rest is small exact arithmetic over that table:

* Shapley: the shares phi that minimise the kernel-weighted squares of v(S) - sum of phi over S, under the
  constraint that they sum to v(all); the constrained normal equations are solved in rationals. The kernel weights
  make the solution the average of a filter's removals over all orders, so times the number of orders it is whole.
* Steps: a step of an order removes v(filters so far) - v(filters before); what one filter alone
  catches is v(all) - v(all others); and so on.

Equality with an earlier text goes by SHA-256: the smallest id of each text is a partial and final minimum, joined
back on text and id, so that no group of copies lands in one task. Labels are joined on the document's id.

Edge cases: null and empty texts are empty (and copies of one another); a null part is the empty
string, one part with it. A row with a null id is no copy and nobody's original, and has no labels; of rows with one id, neither copies
the other. Several labels of an id count as good or toxic if one is. Extra columns are ignored, empty tables give no parts.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.llm.native import space_words
from canonry.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 3
SIGNS = "[#$%&*|]"

STEPS = ("kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")


# ------------------------------------------------------------------ exact arithmetic
@lru_cache
def _inverse(players: int) -> list[list[Fraction]]:
    """Inverse of the normal equations' matrix: kernel-weighted squares, bordered by the constraint."""
    size = players + 1
    rows = [[Fraction(0)] * (2 * size) for _ in range(size)]
    for s in range(1, (1 << players) - 1):
        inside = [i for i in range(players) if s >> i & 1]
        weight = Fraction(players - 1, comb(players, len(inside)) * len(inside) * (players - len(inside)))
        for i in inside:
            for j in inside:
                rows[i][j] += weight
    for i in range(players):
        rows[i][players] = rows[players][i] = Fraction(1)
    if players == 1:
        rows[0][0] = Fraction(1)
    for i in range(size):
        rows[i][size + i] = Fraction(1)
    for i in range(size):
        pivot = next(r for r in range(i, size) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        scale = rows[i][i]
        rows[i] = [x / scale for x in rows[i]]
        for r in range(size):
            if r != i and rows[r][i]:
                by = rows[r][i]
                rows[r] = [x - by * y for x, y in zip(rows[r], rows[i])]
    return [row[size:] for row in rows]


def shapley(v: list[int]) -> list[Fraction]:
    """Shapley values of the game ``v`` over coalitions (index: bits of the players), exactly."""
    players = (len(v) - 1).bit_length()
    right = [Fraction(0)] * (players + 1)
    for s in range(1, len(v) - 1):
        size = s.bit_count()
        weight = Fraction(players - 1, comb(players, size) * size * (players - size))
        for i in range(players):
            if s >> i & 1:
                right[i] += weight * (v[s] - v[0])
    right[players] = Fraction(v[-1] - v[0])
    return [sum(a * b for a, b in zip(row, right)) for row in _inverse(players)[:players]]


def audit(total: int, removed: list[int], good: list[int], toxic: list[int], filters: str = FILTERS) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps.

    ``removed``, ``good`` and ``toxic``: documents that each coalition removes, all, good and toxic ones.
    """
    every = len(removed) - 1
    orders = factorial(len(filters))
    share = [x * orders for x in shapley(removed)]
    assert all(x.denominator == 1 for x in share)
    out = []
    for order in permutations(range(len(filters))):
        name, before = "".join(filters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = before | 1 << i
            gone = removed[now] - removed[before]
            out.append((name, step, total - removed[now], gone, removed[1 << i] - gone, removed[every] - removed[every ^ 1 << i],
                        good[now] - good[before], toxic[now] - toxic[before], int(share[i])))
            before = now
    return out


# ------------------------------------------------------------------ Spark
def _fails(text: Column, words: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    n = F.size(words).cast("long")
    checks = (n < MIN_WORDS, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * DISTINCT_PERCENT,
              F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * CAPITAL_PERCENT,
              text.rlike(SIGNS))
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(checks)), F.lit(0))


def patterns(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, fails, good, toxic) per document row: the bits of the filters it fails, and its labels."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("t")).withColumn("w", space_words(F.col("t")))
    narrow = cut_lineage(rows.select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), _fails(F.col("t"), F.col("w")).alias("fails")),
                         name="filter-audit")
    # Null ids meet nothing: their join keys are spread by the text.
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0))
    first = narrow.where("id IS NOT NULL").groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first")).withColumn("one", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    at = narrow.withColumn("spread", spread)
    met = (at.join(first.withColumn("zero", F.lit(0).cast("long")),
                   (F.col("digest") == F.col("d")) & (F.col("id") == F.col("first")) & (F.col("spread") == F.col("zero")), "left")
           .join(known.withColumn("nil", F.lit(0).cast("long")), (F.col("id") == F.col("label_id")) & (F.col("spread") == F.col("nil")), "left"))
    copy = F.col("id").isNotNull() & F.col("one").isNull()
    return met.select("part", (F.col("fails") + F.when(copy, F.lit(1 << 4)).otherwise(F.lit(0))).alias("fails"),
                      F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def coalitions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, coalition, total, removed, good, toxic): documents of a part that each set of filters removes."""
    cells = found.groupBy("part", "fails").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("g"), F.sum("toxic").alias("t"))
    each = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))).alias("coalition"))
    hit = F.col("fails").bitwiseAND(F.col("coalition")) != 0
    some = lambda c: F.sum(F.when(hit, F.col(c)).otherwise(F.lit(0)))
    return each.groupBy("part", "coalition").agg(F.sum("n").alias("total"), some("n").alias("removed"),
                                                 some("g").alias("good"), some("t").alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame, part_col: str = "lang", filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step: what is kept, removed and lost, and the filter's Shapley share."""
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("coalition")
        columns = [[int(x) for x in rows[c]] for c in ("removed", "good", "toxic")]
        out = audit(int(rows["total"].iloc[0]), *columns, filters)
        names = ["filter_order", "step", *[c.split()[0] for c in STEPS.split(", ")]]
        result = pd.DataFrame(out, columns=names)
        result.insert(0, "part", rows["part"].iloc[0])
        return result

    # A group is one part's table: a row per coalition.
    return coalitions(patterns(docs, labels, part_col), filters).groupBy("part").applyInPandas(
        solve, f"part string, filter_order string, step int, {STEPS}")
