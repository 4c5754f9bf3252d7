"""Serving contract as DataFrame operators: n texts in, n names out, keyed by row id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonry.functions.text import split_lines
from canonry.operators.classify import NBModel, predict_labels, train_classifier
from canonry.operators.labels import build_vocabulary, decode_labels, encode_labels
from canonry.session import cut_lineage

# Fixed value shown when a line has no (or an empty) prediction.
NO_MATCH = "(no match)"


@dataclass
class Standardizer:
    vocab: DataFrame
    model: NBModel


def fit_standardizer(train: DataFrame, text_col: str = "mention", name_col: str = "entity_name",
                     kind: str = "word", n: int = 3, alpha: float = 1.0) -> Standardizer:
    """Vocabulary from the training rows only, then naive Bayes on (normalised text, label)."""
    vocab = cut_lineage(build_vocabulary(train, name_col), name="vocabulary")
    rows = encode_labels(train.select(text_col, name_col), vocab, name_col, "label")
    return Standardizer(vocab, train_classifier(rows, text_col, "label", kind, n, alpha))


def standardize(df: DataFrame, std: Standardizer, id_col: str = "row_id", text_col: str = "text",
                out: str = "predicted") -> DataFrame:
    """Append the predicted canonical name; every input row is kept (left join on the id)."""
    pred = predict_labels(std.model, df, id_col, text_col, keep_cols=df.columns)
    return decode_labels(pred, std.vocab, "label", out).select(*df.columns, out)


def attach_predictions(df: DataFrame, preds: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Positional zip re-expressed as a left equi-join on the row id."""
    return df.join(preds, id_col, "left")


def mapping_table(df: DataFrame, from_col: str = "from", pred_col: str = "predicted") -> DataFrame:
    """``to`` = prediction, or ``(no match)`` when it is NULL or empty."""
    return df.withColumn("to", F.coalesce(F.nullif(F.col(pred_col), F.lit("")), F.lit(NO_MATCH)))


def lines_to_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blob -> one row per non-blank trimmed line: (id, line_no, from). No shuffle."""
    return df.select(id_col, F.posexplode(split_lines(text_col)).alias("line_no", "from"))


def map_lines(df: DataFrame, std: Standardizer, id_col: str, text_col: str) -> DataFrame:
    """Blob -> from/to table: split into lines, standardise each line, default ``(no match)``."""
    lines = lines_to_rows(df, id_col, text_col).withColumn(
        "_line_key", F.struct(F.col(id_col), F.col("line_no")))
    scored = standardize(lines, std, "_line_key", "from")
    return mapping_table(scored).select(id_col, "line_no", "from", "to")


def smoke(df: DataFrame, std: Standardizer, id_col: str, text_col: str, n: int = 100) -> DataFrame:
    """Standardise the first n rows by id (the manual smoke run)."""
    head = df.orderBy(id_col).limit(n)
    return standardize(head, std, id_col, text_col)


def from_request(df: DataFrame, body_col: str = "body", request_col: str = "request_id") -> DataFrame:
    """``{"texts": [...]}`` bodies -> (request_id, pos, text)."""
    parsed = F.from_json(F.col(body_col), "texts array<string>")
    return df.select(request_col, F.posexplode(parsed.getField("texts")).alias("pos", "text"))


def to_request(df: DataFrame, request_col: str, order_col: str, text_col: str) -> DataFrame:
    """Rows grouped into ``{"texts": [...]}`` bodies; the grouping key must bound request size."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t"))))
    return df.groupBy(request_col).agg(
        F.to_json(F.struct(F.transform(ordered, lambda x: x["t"]).alias("texts"))).alias("body"))


def to_response(df: DataFrame, request_col: str = "request_id", pos_col: str = "pos",
                pred_col: str = "predicted") -> DataFrame:
    """Per request, ``{"results": [...]}`` in request order (one group = one request)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"),
                                                   F.coalesce(F.col(pred_col), F.lit("")).alias("r"))))
    return df.groupBy(request_col).agg(
        F.to_json(F.struct(F.transform(ordered, lambda x: x["r"]).alias("results"))).alias("response"))
