"""Fixtures built by Spark from the driver's tables (see FIXTURES.md).

* entities: distinct ``part.p_name``; id = dense rank - 1 by name, type = second word.
* mentions: one noisy mention per part row, split train / test by ``p_partkey``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.operators.ranking import dense_index
from canonry.operators.sizing import bounded_broadcast
from canonry.sources.tables import read_table, spread


# Tables whose rows carry long free text, with their row ids: the stages after their
# scan are CPU-heavy (tokenising, n-grams, line splitting), so an under-split file is
# spread over the cores by its id. Short-row tables are cheaper to process in place.
TEXT_TABLES = {"documents": ["doc_id"], "conversations": ["conv_id"], "pages": ["page_id"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a text table is spread over the cores when its file is one split."""
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet", TEXT_TABLES.get(name))


#: Part rows of one task that builds mentions: each gives some fifty n-grams or candidates, which one task sums.
MENTION_ROWS = 20_000


def _spread_part(part: DataFrame) -> DataFrame:
    """``part`` dealt by its key over tasks of about ``MENTION_ROWS`` rows: short rows make a large table one split of its file."""
    wanted = max(part.sparkSession.sparkContext.defaultParallelism, -(-part.count() // MENTION_ROWS))
    return spread(part, ["p_partkey"], wanted)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    ent = dense_index(names, "name", "id").withColumn("type_name", F.split("name", " ").getItem(1))
    types = dense_index(ent.select("type_name").distinct(), "type_name", "type_id")
    return ent.join(bounded_broadcast(types), "type_name").select("id", "name", "type_id", "type_name")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mention_id, mention, entity_name, split) from part."""
    p = _spread_part(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type"))
    k = F.col("p_partkey")
    name = F.col("p_name")
    mention = (F.when(k % 5 == 0, F.upper(name))
               .when(k % 5 == 1, F.concat(F.lit("  "), name, F.lit(" ")))
               .when(k % 5 == 2, F.replace(name, F.lit(" "), F.lit("\t ")))
               .when(k % 5 == 3, F.concat(name, F.lit(" "), F.lower("p_brand")))
               .otherwise(F.concat(F.expr("substring(p_name, 1, length(p_name) - 1)"), F.lit(" "), F.col("p_type"))))
    split = F.when(F.floor(k / 5).cast("long") % 4 == 0, F.lit("test")).otherwise(F.lit("train"))
    return p.select(k.alias("mention_id"), mention.alias("mention"), name.alias("entity_name"), split.alias("split"))


def mentions_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions plus the ``entity_id`` of their canonical name."""
    ent = entities(spark, sf_dir).select(F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
    return mentions(spark, sf_dir).join(bounded_broadcast(ent), "entity_name")


def train_mentions(spark, sf_dir):
    return mentions(spark, sf_dir).where(F.col("split") == "train")


def test_mentions(spark, sf_dir):
    return mentions(spark, sf_dir).where(F.col("split") == "test")


def doc_split(spark: SparkSession, sf_dir: str, test: bool) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    cond = (F.col("doc_id") % 5 == 0)
    return d.where(cond if test else ~cond)
