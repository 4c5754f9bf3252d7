"""Text encoder without a model: signed count sketch of character n-grams, as DataFrame functions.

Each n-gram of the normalised text adds +1 or -1 to one of ``dim`` entries, both drawn from its MD5 (first 32 bits: the
entry is the remainder by ``dim``, the sign the parity of the quotient); the vector is then scaled to length 1.
The dot product of two sketches estimates that of the n-gram counts. Occurrences are summed per row and entry, map-side first; a row
gathers ``dim`` numbers at most. Rows whose entries are all zero, or whose text is null or blank, get the zero vector. Ids are unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import explode_terms

DIM = 64


def sketch_entries(df: DataFrame, id_col: str, text_col: str, dim: int = DIM, n: int = 3) -> DataFrame:
    """(id, entry, weight): the non-zero entries of each row's unit vector."""
    terms = explode_terms(df, [F.col(id_col)], text_col, "char_ngram", n, normalize=True)
    code = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    sign = F.lit(1) - 2 * F.pmod(F.floor(code / dim), F.lit(2))
    sums = terms.select(id_col, F.pmod(code, F.lit(dim)).cast("int").alias("entry"), sign.cast("long").alias("s")).groupBy(
        id_col, "entry").agg(F.sum("s").alias("s")).where(F.col("s") != 0)
    # One row's entries, dim at most.
    row = sums.groupBy(id_col).agg(F.collect_list(F.struct("entry", "s")).alias("all"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    return row.select(id_col, F.explode("all").alias("e"), "norm").select(
        id_col, F.col("e.entry").alias("entry"), (F.col("e.s") / F.col("norm")).alias("weight"))


def sketch_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = DIM, n: int = 3, out: str = "embedding") -> DataFrame:
    """(id, ``out``): the vectors as arrays of doubles, one per row of ``df``."""
    sparse = sketch_entries(df, id_col, text_col, dim, n).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("entry", "weight"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))
    return df.select(id_col).join(sparse, id_col, "left").select(
        id_col, F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), dim)).otherwise(dense).alias(out))
