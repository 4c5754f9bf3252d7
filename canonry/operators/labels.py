"""Label vocabulary, encoding/decoding, reference lookup and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.operators.ranking import dense_index
from canonry.operators.sizing import DEFAULT_BROADCAST_ROWS, bounded_broadcast, broadcast_if

UNKNOWN_LABEL = -1


def build_vocabulary(df: DataFrame, name_col: str = "entity_name") -> DataFrame:
    """Sorted distinct names with a dense 0-based ``label_id`` (code-point order)."""
    names = df.select(F.col(name_col).alias("entity_name")).where(F.col("entity_name").isNotNull()).distinct()
    return dense_index(names, "entity_name", "label_id").select("label_id", "entity_name")


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def encode_labels(df: DataFrame, vocab: DataFrame, name_col: str = "entity_name",
                  out: str = "label", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Name -> label id; a name outside the vocabulary (or NULL) becomes -1."""
    v = broadcast_if(vocab.select(F.col("entity_name").alias("_enc_name"), F.col("label_id").alias("_enc_id")),
                     vocab, max_broadcast_rows)
    return (df.join(v, F.col(name_col) == F.col("_enc_name"), "left")
            .withColumn(out, F.coalesce(F.col("_enc_id"), F.lit(UNKNOWN_LABEL)).cast("long"))
            .drop("_enc_name", "_enc_id"))


def decode_labels(df: DataFrame, vocab: DataFrame, id_col: str = "label",
                  out: str = "entity_name", max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """Label id -> name (NULL for -1 or an unknown id)."""
    v = broadcast_if(vocab.select(F.col("label_id").alias("_dec_id"), F.col("entity_name").alias(out)),
                     vocab, max_broadcast_rows)
    return df.join(v, F.col(id_col) == F.col("_dec_id"), "left").drop("_dec_id")


def class_set(df: DataFrame, col: str = "entity_id") -> DataFrame:
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def uncovered_classes(test: DataFrame, train: DataFrame, col: str = "entity_id") -> DataFrame:
    """Classes of the test rows that no training row has (EXCEPT DISTINCT)."""
    return test.select(col).subtract(train.select(col))


def entity_lookup(entities: DataFrame) -> DataFrame:
    """``id -> name`` (leading blanks removed); when an id repeats, the row with the largest ``_pos`` (last in file) wins."""
    pos = F.col("_pos") if "_pos" in entities.columns else F.lit(0)
    return (entities.withColumn("_p", pos)
            .groupBy(F.col("id").alias("entity_id"))
            .agg(F.max_by(F.ltrim("name"), F.col("_p")).alias("_lk_name")))


def resolve_entities(mentions: DataFrame, entities: DataFrame, on_missing: str = "fail",
                     max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS):
    """Attach ``entity_name`` to mentions by ``entity_id``.

    ``on_missing="fail"``: an unknown id fails the job (``raise_error`` runs inside
    the task, no collect). ``"quarantine"``: returns ``(resolved, quarantined)``.
    The lookup is broadcast only under a proven row bound; otherwise it is a
    shuffle join where AQE splits a hot entity id.
    """
    lookup = entity_lookup(entities).withColumn("_found", F.lit(True))
    lookup = bounded_broadcast(lookup, max_broadcast_rows)
    base = mentions.drop("entity_name") if "entity_name" in mentions.columns else mentions
    joined = base.join(lookup, "entity_id", "left")
    if on_missing == "fail":
        # A filter, so that the check runs whichever columns are read later.
        shown = F.coalesce(F.col("entity_id").cast("string"), F.lit("NULL"))
        known = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("unknown entity_id: "), shown))
                       .cast("boolean")).otherwise(F.lit(True))
        return joined.where(known).withColumnRenamed("_lk_name", "entity_name").drop("_found")
    if on_missing == "quarantine":
        resolved = (joined.where(F.col("_found").isNotNull())
                    .withColumnRenamed("_lk_name", "entity_name").drop("_found"))
        quarantined = joined.where(F.col("_found").isNull()).drop("_lk_name", "_found")
        return resolved, quarantined
    raise ValueError(f"on_missing must be 'fail' or 'quarantine', not {on_missing!r}")


def to_classification_rows(df: DataFrame, vocab: DataFrame, id_col: str = "mention_id",
                           text_col: str = "mention", name_col: str = "entity_name") -> DataFrame:
    """(id, text = normalised mention, label = vocabulary id or -1)."""
    from canonry.functions.text import normalize_text
    rows = df.select(id_col, normalize_text(text_col).alias("text"), name_col)
    return encode_labels(rows, vocab, name_col, "label").drop(name_col)


def to_seq_rows(df: DataFrame, id_col: str = "mention_id", text_col: str = "mention",
                name_col: str = "entity_name") -> DataFrame:
    """(id, input = normalised mention, output = canonical name as is)."""
    from canonry.functions.text import normalize_text
    return df.select(id_col, normalize_text(text_col).alias("input"), F.col(name_col).alias("output"))


def mentions_of(df: DataFrame, col: str = "mention") -> DataFrame:
    """The one-column projection the original pulls into a list; here it stays distributed."""
    return df.select(col)
