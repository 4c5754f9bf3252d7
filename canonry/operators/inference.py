"""User-model inference with Arrow batches (``predict_batch_udf``).

The model factory runs once per Python worker; each call receives a numpy batch.
This is the only Python path on purpose: it is where a user's own model lives.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, FloatType, StringType


def infer(df: DataFrame, input_col: str, make_predict_fn, return_type: DataType = StringType(),
          batch_size: int = 256, out: str = "prediction") -> DataFrame:
    """Append ``out`` = model(input) computed in Arrow batches of ``batch_size`` rows.

    ``return_type`` must be a DataType object (a type string is rejected by Spark).
    """
    udf = predict_batch_udf(make_predict_fn, return_type=return_type, batch_size=batch_size)
    return df.withColumn(out, udf(F.col(input_col)))


def embed(df: DataFrame, text_col: str, encoder_factory, batch_size: int = 64,
          out: str = "embedding") -> DataFrame:
    """Text -> ``array<float>`` with a user encoder (factory returns ``fn(np.ndarray) -> 2-D array``)."""
    return infer(df, text_col, encoder_factory, ArrayType(FloatType()), batch_size, out)


def upper_model():
    """Test model: upper-cases its input (stands in for a text-to-text model)."""
    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([t.upper() if t is not None else None for t in texts], dtype=object)
    return predict


def hashed_ngram_encoder(dim: int = 64, n: int = 3):
    """Factory of a small deterministic encoder: hashed char n-gram counts, L2-normalised."""
    def encode(texts: np.ndarray) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            s = (t or "").lower()
            grams = [s[j:j + n] for j in range(max(len(s) - n + 1, 1 if s else 0))]
            for g in grams:
                out[i, zlib.crc32(g.encode("utf-8")) % dim] += 1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1.0, norms)
    return lambda: encode
