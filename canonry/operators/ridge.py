"""Closed-set classification by ridge regression on hashed features (CLS2).

A row's features are the signed sums of its terms' hashes over ``dim`` entries (as in ``sketch``), scaled to length
1 and rounded to fixed point (``SCALE`` steps), and a constant. One-hot classes are fitted by least squares,

    W = (X'X + penalty I)^-1 X'Y.

``X'X`` is a matrix of ``dim + 1`` squared: every task adds up its rows' share and Spark adds the shares. ``X'Y`` is one
grouped sum per class and entry. Both are sums of integers, so the model does not depend on how rows are spread. Only the
inverse is made on the driver, its size set by ``dim`` alone (at most ``MAX_DIM``); each class's weights are then a task's work, so
there may be any number of classes. The constant is penalised like any entry.

Rows need no unique ids: they are told apart by id and text. A null or blank text has the constant alone; a null or negative
label is no training row. Without training rows there are no classes, and every prediction is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import explode_terms
from canonry.operators.ranking import RANK_DECIMALS
from canonry.session import cut_lineage

#: Steps of the fixed point; the constant feature is one whole.
SCALE = 1024
#: The driver holds three matrices of this many squared doubles at most (128 MB each).
MAX_DIM = 4096
#: Weights that a task holds while it scores; more classes are scored in several passes.
MAX_WEIGHT_BYTES = 256 << 20

_KEYS = ["_id", "_h1", "_h2"]


@dataclass
class RidgeModel:
    weights: DataFrame  # label long, weights array<double> of dim + 1, the constant's last
    dim: int
    penalty: float
    kind: str
    n: int
    normalize: bool


def features(df: DataFrame, id_col: str, text_col: str, dim: int, kind: str = "word", n: int = 3,
             normalize: bool = True, keep_cols=()) -> DataFrame:
    """(``id_col``, *keep_cols, ``x``: array of (entry, v)) per row of ``df``; ``v`` is not 0, the constant is left out."""
    text = F.col(text_col).cast("string")
    keys = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2")]
    terms = explode_terms(df.select(*keys, text.alias("_text")), _KEYS, "_text", kind, n, normalize)
    code = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    sign = F.lit(1) - 2 * F.pmod(F.floor(code / dim), F.lit(2))
    sums = terms.select(*_KEYS, F.pmod(code, F.lit(dim)).cast("int").alias("entry"), sign.cast("long").alias("s")).groupBy(
        *_KEYS, "entry").agg(F.sum("s").alias("s")).where(F.col("s") != 0)
    # One row's entries, dim at most. A row that is there k times has k times the sums, and the same unit vector.
    unit = sums.groupBy(*_KEYS).agg(F.collect_list(F.struct("entry", "s")).alias("all"),
                                    F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    fixed = F.transform("all", lambda e: F.struct(
        e["entry"].alias("entry"), F.floor(F.lit(SCALE) * e["s"] / F.col("norm") + 0.5).cast("int").alias("v")))
    unit = unit.select(*[F.col(k).alias(f"u{k}") for k in _KEYS], F.filter(fixed, lambda e: e["v"] != 0).alias("x"))
    keep = [c for c in keep_cols if c != id_col]
    same = F.col("_id").eqNullSafe(F.col("u_id")) & (F.col("_h1") == F.col("u_h1")) & (F.col("_h2") == F.col("u_h2"))
    return df.select(*keys, *keep).join(unit, same, "left").select(
        F.col("_id").alias(id_col), *keep, F.coalesce("x", F.array().cast("array<struct<entry:int,v:int>>")).alias("x"))


def _dense(lists, dim: int) -> np.ndarray:
    """Rows of ``dim + 1`` fixed-point features from an Arrow column of (entry, v) lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    out = np.zeros((len(lists), dim + 1))
    out[:, dim] = SCALE
    out[np.repeat(np.arange(len(lists)), size), flat.field("entry").to_numpy()] = flat.field("v").to_numpy()
    return out


#: Rows whose products are added as doubles: below 2**53 whatever the features.
_ROWS = 1 << 12


def gram(rows: DataFrame, dim: int) -> DataFrame:
    """(i, j, total): sums over all rows of the products of features ``i <= j``, exact."""
    def run(batches):
        total = np.zeros((dim + 1, dim + 1), dtype=np.int64)
        seen = False
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                x = _dense(batch.column(0).slice(at, _ROWS), dim)
                total += np.rint(x.T @ x).astype(np.int64)
                seen = True
        if seen:
            for i in range(dim + 1):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1 - i, i)), pa.array(np.arange(i, dim + 1)),
                                                  pa.array(total[i, i:])], names=["i", "j", "total"])

    return rows.select("x").mapInArrow(run, "i long, j long, total long").groupBy("i", "j").agg(F.sum("total").alias("total"))


def train_ridge(df: DataFrame, id_col: str, text_col: str = "text", label_col: str = "label", dim: int = 256,
                penalty: float = 1.0, kind: str = "word", n: int = 3, normalize: bool = True) -> RidgeModel:
    """Fit one-hot classes of (id, text, label) rows; labels are integers from 0."""
    if not 0 < dim <= MAX_DIM:
        raise ValueError(f"dim must lie in 1 .. {MAX_DIM}")
    labelled = df.where(F.col(label_col).isNotNull() & (F.col(label_col) >= 0)).withColumn(label_col, F.col(label_col).cast("long"))
    rows = cut_lineage(features(labelled, id_col, text_col, dim, kind, n, normalize, (label_col,))
                       .select(F.col(label_col).alias("label"), "x"), name="ridge-rows")
    a = np.zeros((dim + 1, dim + 1))
    for batch in gram(rows, dim).toArrow().to_batches():  # (dim + 1)(dim + 2) / 2 numbers
        i, j, total = (batch.column(c).to_numpy() for c in range(3))
        a[i, j] = a[j, i] = total / float(SCALE * SCALE)
    inverse = rows.sparkSession.sparkContext.broadcast(np.linalg.inv(a + penalty * np.eye(dim + 1)))
    whole = F.array(F.struct(F.lit(dim).alias("entry"), F.lit(SCALE).alias("v")))
    sums = (rows.select("label", F.explode(F.concat("x", whole)).alias("e"))
            .groupBy("label", F.col("e.entry").alias("entry")).agg(F.sum("e.v").alias("v"))
            .groupBy("label").agg(F.collect_list(F.struct("entry", "v")).alias("x")))  # a class's entries, dim + 1 at most

    def solve(batches):
        for batch in batches:
            if batch.num_rows:
                found = _dense(batch.column(1), dim) @ inverse.value / SCALE
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))],
                                                 names=["label", "weights"])

    weights = cut_lineage(sums.mapInArrow(solve, "label long, weights array<double>"), name="ridge-weights")
    return RidgeModel(weights, dim, float(penalty), kind, n, normalize)


def predict_ridge(model: RidgeModel, df: DataFrame, id_col: str, text_col: str = "text", keep_cols=(),
                  max_weight_bytes: int = MAX_WEIGHT_BYTES) -> DataFrame:
    """(``id_col``, *keep_cols, label, score): the class of the highest score for every row, ties to the smallest label.

    Classes are sent to the tasks in blocks of at most ``max_weight_bytes``; with more than one block a row carries
    its best so far through one pass a block, each pass written before the next.
    """
    dim, keep = model.dim, [c for c in keep_cols if c != id_col]
    per_block = max(1, max_weight_bytes // (8 * (dim + 1)))
    n_classes = model.weights.count()
    out = features(df, id_col, text_col, dim, model.kind, model.n, model.normalize, keep).withColumns(
        {"label": F.lit(None).cast("long"), "score": F.lit(None).cast("double")})
    if not n_classes:
        return out.select(id_col, *keep, "label", "score")
    blocks = -(-n_classes // per_block)
    block_of = F.pmod(F.xxhash64("label"), F.lit(2 * blocks)) if blocks > 1 else F.lit(0)
    for block in range(2 * blocks if blocks > 1 else 1):  # halves: hashed blocks are uneven
        found = model.weights.where(block_of == block).orderBy("label").toArrow()
        if found.num_rows:
            if block:
                out = cut_lineage(out, name="ridge-scores")
            out = _scored(out, dim, found)
    return out.select(id_col, *keep, "label", "score")


def _scored(rows: DataFrame, dim: int, found: pa.Table) -> DataFrame:
    """``rows`` with ``label`` and ``score`` replaced where a class of ``found`` does better."""
    matrix = found.column("weights").combine_chunks().flatten().to_numpy().reshape(-1, dim + 1)
    sent = rows.sparkSession.sparkContext.broadcast((found.column("label").to_numpy(), np.ascontiguousarray(matrix.T)))
    names = rows.columns

    def run(batches):
        labels, weights = sent.value
        step = max(1, (16 << 20) // (8 * len(labels)))  # scores held at a time
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                score = np.round(_dense(part.column(names.index("x")), dim) @ weights / SCALE, RANK_DECIMALS)
                first = score.argmax(axis=1)  # of equal ones the smallest label
                best, label = score[np.arange(len(score)), first], labels[first]
                had = part.column(names.index("label")).to_pylist()
                was = part.column(names.index("score")).to_pylist()
                for i, (old, value) in enumerate(zip(had, was)):
                    if old is not None and (value > best[i] or value == best[i] and old < label[i]):
                        best[i], label[i] = value, old
                columns = [pa.array(label, pa.int64()) if c == "label" else pa.array(best) if c == "score" else part.column(k)
                           for k, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, rows.schema)
