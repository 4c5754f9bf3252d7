"""Nested entity / mention JSON files -> flat tables.

Two layouts:

* ``"document"``: one JSON object ``{"data": {"<key>": {...}, ...}}`` per file, the
  shape the original files have. A file is read in many tasks: entries are found from any
  split on (``split_records``).
* ``"lines"``: JSON Lines, one ``{"key": ..., <fields>}`` per line.

Keys are otherwise ignored, except that a repeated key keeps its last entry
(as a JSON object does). Read with an explicit schema: inference would make one
struct field per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.operators.labels import resolve_entities
from canonry.sources.split_records import json_entries, write_json_objects

# Field names and types of the three file shapes.
ENTITY_FIELDS = ["entity_id:bigint", "entity_name:string", "entity_type_id:bigint", "entity_type_name:string"]
TRAIN_FIELDS = ["entity_id:bigint", "mentions:array<string>"]
TEST_FIELDS = ["mention:string", "entity_id:bigint"]
REQUIRED = ("entity_id", "entity_name", "mentions", "mention")


def _read(spark: SparkSession, path: str, fields: list[str], layout: str) -> DataFrame:
    """-> (key, value struct, _pos) with one row per key (the last entry of a repeated key)."""
    if layout == "document":
        rows = json_entries(spark, path, fields)
        pos = F.struct(F.col("_file"), F.col("_blk"), F.col("_i"))
    elif layout == "lines":
        flat = spark.read.schema("key string, " + ", ".join(f.replace(":", " ", 1) for f in fields)) \
            .option("mode", "FAILFAST").json(path)
        names = [f.split(":", 1)[0] for f in fields]
        rows = flat.select("key", F.struct(*names).alias("value"),
                           F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_blk"),
                           F.monotonically_increasing_id().alias("_i"))
        pos = F.struct(F.col("_file"), F.col("_blk"), F.col("_i"))
    else:
        raise ValueError(f"layout must be 'document' or 'lines', not {layout!r}")
    # A malformed line, a NULL key or a missing field stops the job: nothing is lost silently.
    names = [f.split(":", 1)[0] for f in fields]
    required = [n for n in names if n in REQUIRED]
    missing = F.col("key").isNull() | F.col("value").isNull()
    for n in required:
        missing = missing | F.col("value")[n].isNull()
    complete = F.when(missing, F.raise_error(F.concat(F.lit("entry without key or required field: "), F.coalesce(
        F.col("key"), F.lit("NULL")))).cast("boolean")).otherwise(F.lit(True))
    rows = rows.where(complete).withColumn("_pos", pos)
    return rows.groupBy("key").agg(F.max_by(F.struct("value", "_pos"), F.col("_pos")).alias("_last")) \
               .select("key", F.col("_last.value").alias("value"), F.col("_last._pos").alias("_pos"))


def read_entities(spark: SparkSession, path: str, layout: str = "document") -> DataFrame:
    """Entity file -> (id, name, type_id, type_name, _pos). ``_pos`` orders duplicate ids."""
    r = _read(spark, path, ENTITY_FIELDS, layout)
    return r.select(F.col("value.entity_id").alias("id"), F.col("value.entity_name").alias("name"),
                    F.col("value.entity_type_id").alias("type_id"),
                    F.col("value.entity_type_name").alias("type_name"), "_pos")


def read_mentions(spark: SparkSession, path: str, entities: DataFrame, layout: str = "document",
                  on_missing: str = "fail"):
    """Train file -> (mention_id = key#pos, mention, entity_id, entity_name)."""
    r = _read(spark, path, TRAIN_FIELDS, layout)
    m = r.select("key", F.col("value.entity_id").alias("entity_id"),
                 F.posexplode("value.mentions").alias("pos", "mention"))
    m = m.select(F.concat_ws("#", "key", F.col("pos").cast("string")).alias("mention_id"), "mention", "entity_id")
    return resolve_entities(m, entities, on_missing)


def read_test_mentions(spark: SparkSession, path: str, entities: DataFrame, layout: str = "document",
                       on_missing: str = "fail"):
    """Inference file -> (mention_id = key, mention, entity_id, entity_name)."""
    r = _read(spark, path, TEST_FIELDS, layout)
    m = r.select(F.col("key").alias("mention_id"), F.col("value.mention").alias("mention"),
                 F.col("value.entity_id").alias("entity_id"))
    return resolve_entities(m, entities, on_missing)


# -------------------------------------------------------------- writers (JSON Lines, one object per file)
def _entity_rows(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("id").cast("string").alias("key"), F.col("id").alias("entity_id"),
                           F.col("name").alias("entity_name"), F.col("type_id").alias("entity_type_id"),
                           F.col("type_name").alias("entity_type_name"))


def write_entities_lines(entities: DataFrame, path: str) -> None:
    _entity_rows(entities).write.mode("overwrite").json(path)


def write_entities(entities: DataFrame, path: str, files: int | None = None) -> None:
    """One-object files, the shape ``read_entities`` has as its default."""
    write_json_objects(_entity_rows(entities), "key", path, files)


def _mention_rows(mentions: DataFrame, chunk: int) -> DataFrame:
    """Group mentions under keys ``<entity_id>-<mention_id div chunk>``.

    A key holds at most ``chunk`` mentions, so a hot entity is spread over many
    keys instead of one unbounded list.
    """
    key = F.concat_ws("-", F.col("entity_id").cast("string"), F.expr(f"mention_id div {chunk}").cast("string"))
    grouped = mentions.groupBy(key.alias("key"), "entity_id").agg(
        F.array_sort(F.collect_list(F.struct("mention_id", "mention"))).alias("_m"))
    return grouped.select("key", "entity_id", F.transform("_m", lambda x: x["mention"]).alias("mentions"))


def write_mentions_lines(mentions: DataFrame, path: str, chunk: int = 100) -> None:
    _mention_rows(mentions, chunk).write.mode("overwrite").json(path)


def write_mentions(mentions: DataFrame, path: str, chunk: int = 100, files: int | None = None) -> None:
    """One-object files of mentions grouped under keys (at most ``chunk`` a key)."""
    write_json_objects(_mention_rows(mentions, chunk), "key", path, files)


def _test_rows(mentions: DataFrame) -> DataFrame:
    return mentions.select(F.col("mention_id").cast("string").alias("key"), "mention", "entity_id")


def write_test_mentions_lines(mentions: DataFrame, path: str) -> None:
    _test_rows(mentions).write.mode("overwrite").json(path)


def write_test_mentions(mentions: DataFrame, path: str, files: int | None = None) -> None:
    write_json_objects(_test_rows(mentions), "key", path, files)
