"""Score a stream of texts with the same operator as batch scoring (stateless).

``foreachBatch`` applies the batch standardiser to each micro-batch and writes it
under ``<sink>/batch_id=<n>`` with overwrite, so a replayed batch (after a failure)
replaces its own output instead of duplicating it. No aggregation, so no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from canonry.operators import classify, labels
from canonry.operators.serve import Standardizer


def standardize_stream(stream_df: DataFrame, std: Standardizer, id_col: str, text_col: str,
                       sink_path: str, checkpoint_location: str, available_now: bool = True):
    """Start the query; returns the StreamingQuery (``availableNow`` drains then stops)."""

    def score(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(id_col, text_col).persist()  # read for the terms and for the output
        pred = classify.predict_labels(std.model, rows, id_col, text_col)
        named = labels.decode_labels(pred.select(id_col, "label"), std.vocab, "label", "predicted")
        named.write.mode("overwrite").parquet(f"{sink_path}/batch_id={batch_id}")
        rows.unpersist()

    w = stream_df.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def read_sink(spark: SparkSession, sink_path: str) -> DataFrame:
    return spark.read.parquet(sink_path).drop("batch_id")
