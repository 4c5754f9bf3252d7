"""CSV, Parquet and in-memory table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from canonry.sources.split_records import csv_rows

# RFC 4180 quoting; keep blanks and newlines inside values.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def write_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).option("emptyValue", '""').csv(path)


def read_table_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header. The schema is required: no inference pass over the data.

    An unquoted empty field is NULL and a quoted one (``""``) is the empty string:
    the read-side ``nullValue`` is set to NUL, a value text never holds, so only
    the parser's own "nothing here" becomes NULL. ``NA``/``null`` stay text.
    """
    return (spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", "true")
            .option("nullValue", "\u0000").option("mode", "FAILFAST").csv(path))


def read_table_csv_split(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_table_csv``, a file being read in many tasks though its values hold line breaks."""
    return csv_rows(spark, path, schema, {**CSV_OPTIONS, "nullValue": "\u0000"})


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def read_table(spark: SparkSession, path: str, spread_by=None, schema=None) -> DataFrame:
    """Parquet table; ``spread_by`` (a list of id columns, possibly empty) spreads an
    under-split file over the cores (see ``spread``). With a ``schema`` the values of a
    partition column keep their type; without one Spark infers it, and "01" becomes 1."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if spread_by is None else spread(df, spread_by)


# A scan with this many splits (or as many as the cores, if fewer) counts as parallel.
SPREAD_BELOW = 32


def spread(df: DataFrame, by=(), min_partitions: int | None = None) -> DataFrame:
    """Spread an under-split input over the cluster's cores.

    A file that is a single Parquet row group is one split, so every stage up to the
    first shuffle (tokenising, n-grams, partial aggregation, scoring) would run as one
    task on one core. When the scan yields fewer partitions than the default
    parallelism, rows are hash-partitioned by the row id columns ``by`` (round-robin
    when none is given). Hashing the id is deterministic on retry without a sort, and
    it is reused downstream: an aggregation or window keyed by the id plus other
    columns (terms of a document, n-grams of a row) then needs no exchange.
    A scan with at least ``min(parallelism, SPREAD_BELOW)`` splits is left unchanged:
    it already runs as many tasks, so a large input on a large cluster (thousands of
    splits, perhaps still fewer than the cores) is never reshuffled. Planning only, no job.
    ``min_partitions`` asks for that many, where a task's rows must be bounded.
    """
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    threshold = min_partitions or min(parallelism, SPREAD_BELOW)
    if df.rdd.getNumPartitions() >= threshold:
        return df
    n = max(parallelism, min_partitions or 0)
    return df.repartition(n, *by) if by else df.repartition(n)


def from_texts(spark: SparkSession, texts) -> DataFrame:
    """An in-memory list of strings -> (row_id, text). For small request-sized inputs."""
    schema = StructType([StructField("row_id", LongType(), False), StructField("text", StringType(), True)])
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], schema)
