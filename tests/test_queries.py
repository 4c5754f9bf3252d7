"""Driver contract at sf0.001: every registered query runs, and those with SQL agree with DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import compare, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from canonry.plans.catalog import QUERIES  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
FAST = ["standardize_mentions", "vocabulary", "encode_labels", "uncovered_classes", "normalize_documents",
        "term_counts", "lines_to_rows", "ingest_mentions", "quarantine_unresolved", "csv_roundtrip",
        "classification_metrics", "metrics_report", "nb_predict", "cosine_top1", "cosine_top3_blocked",
        "tfidf_nearest", "corpus_bleu", "generate_names", "ingest_mentions_document", "csv_roundtrip_split", "cosine_pruned",
        "tfidf_documents_top3", "sketch_nearest", "ridge_predict", "request_response", "map_lines", "batch_infer"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["mention_id", "mention", "predicted"]
    assert df.count() >= 0


def test_every_query_has_sql_or_is_rows_only():
    rows_only = {q for q in QUERIES if q in entry.queries()} - set(entry.oracle_sql())
    assert rows_only == {"embed_custom", "lr_evaluate"}


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    msg = compare(spark, SF_SMALL, name, entry.queries()[name], entry.oracle_sql()[name], duck(SF_SMALL))
    assert ": OK" in msg, msg
