"""Save / load a trained standardiser as Parquet tables plus one metadata row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from canonry.operators.classify import NBModel
from canonry.operators.ridge import RidgeModel
from canonry.operators.serve import Standardizer


def save_model(std: Standardizer, path: str) -> None:
    m = std.model
    std.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    m.classes.write.mode("overwrite").parquet(f"{path}/classes")
    m.postings.write.mode("overwrite").parquet(f"{path}/postings")
    m.scoring.write.mode("overwrite").parquet(f"{path}/scoring")
    spark = std.vocab.sparkSession
    meta = spark.createDataFrame([(m.n_rows, m.n_vocab, m.alpha, m.kind, m.n, m.normalize)],
                                 "n_rows long, n_vocab long, alpha double, kind string, n int, normalize boolean")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> Standardizer:
    """Explicit path (no globbing for a 'first checkpoint')."""
    meta = spark.read.schema("n_rows long, n_vocab long, alpha double, kind string, n int, normalize boolean") \
        .json(f"{path}/meta").first()
    model = NBModel(spark.read.parquet(f"{path}/classes"), spark.read.parquet(f"{path}/postings"),
                    spark.read.parquet(f"{path}/scoring"), meta.n_rows, meta.n_vocab, meta.alpha, meta.kind, meta.n, meta.normalize)
    return Standardizer(spark.read.parquet(f"{path}/vocab"), model)


_RIDGE_META = "dim int, penalty double, kind string, n int, normalize boolean"


def save_ridge(model: RidgeModel, path: str) -> None:
    """One row of settings and the weights, one row a class."""
    model.weights.write.mode("overwrite").parquet(f"{path}/weights")
    meta = [(model.dim, model.penalty, model.kind, model.n, model.normalize)]
    model.weights.sparkSession.createDataFrame(meta, _RIDGE_META).coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def load_ridge(spark: SparkSession, path: str) -> RidgeModel:
    meta = spark.read.schema(_RIDGE_META).json(f"{path}/meta").first()
    return RidgeModel(spark.read.parquet(f"{path}/weights"), *meta)


def vocab_ids(std: Standardizer):
    return std.vocab.select(F.col("label_id"), F.col("entity_name"))
