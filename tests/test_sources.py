import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from canonry.operators.labels import resolve_entities
from canonry.sources import json_docs, tables


def _write(path, obj):
    with open(path, "w") as f:
        f.write(obj)


def test_csv_round_trip_keeps_values(spark, tmp_path):
    vals = ["NA", "null", " leading", 'x "q"', "l1\nl2", 'c\\"x', ""]
    df = spark.createDataFrame(list(enumerate(vals)), "id long, v string")
    out = str(tmp_path / "csv")
    tables.write_table_csv(df, out)
    back = {r.id: r.v for r in tables.read_table_csv(spark, out, "id long, v string").collect()}
    assert [back[i] for i in range(len(vals))] == vals


def test_entity_document_repeated_key_last_wins(spark, tmp_path):
    p = str(tmp_path / "entities.json")
    # raw text: the key "a" appears twice; a JSON object keeps the last entry
    _write(p, '{"data": {"a": {"entity_id": 1, "entity_name": "first", "entity_type_id": 0, "entity_type_name": "t"},'
              ' "b": {"entity_id": 2, "entity_name": "two", "entity_type_id": 0, "entity_type_name": "t"},'
              ' "a": {"entity_id": 1, "entity_name": "last", "entity_type_id": 0, "entity_type_name": "t"}}}')
    ent = json_docs.read_entities(spark, p, "document")
    assert sorted((r.id, r.name) for r in ent.collect()) == [(1, "last"), (2, "two")]


def test_duplicate_id_later_row_wins_and_missing_fails(spark, tmp_path):
    p = str(tmp_path / "ent.jsonl")
    lines = [{"key": "k1", "entity_id": 7, "entity_name": "old", "entity_type_id": 0, "entity_type_name": "t"},
             {"key": "k2", "entity_id": 7, "entity_name": "new", "entity_type_id": 0, "entity_type_name": "t"}]
    _write(p, "\n".join(json.dumps(x) for x in lines) + "\n")
    ent = json_docs.read_entities(spark, p, "lines")
    m = spark.createDataFrame([("m1", "x", 7), ("m2", "y", 9)], "mention_id string, mention string, entity_id long")
    ok, bad = resolve_entities(m, ent, on_missing="quarantine")
    assert [(r.mention_id, r.entity_name) for r in ok.collect()] == [("m1", "new")]
    assert [r.mention_id for r in bad.collect()] == ["m2"]
    with pytest.raises(Exception, match="unknown entity_id"):
        resolve_entities(m, ent, on_missing="fail").collect()


def test_train_and_test_documents(spark, tmp_path):
    ent_p, tr_p, te_p = (str(tmp_path / n) for n in ("e.json", "t.json", "i.json"))
    _write(ent_p, json.dumps({"data": {"x": {"entity_id": 1, "entity_name": "Db2", "entity_type_id": 3,
                                             "entity_type_name": "db"}}}))
    _write(tr_p, json.dumps({"data": {"k": {"entity_id": 1, "mentions": ["db2 v11", "IBM DB2"]}}}))
    _write(te_p, json.dumps({"data": {"q1": {"mention": "db 2", "entity_id": 1}}}))
    ent = json_docs.read_entities(spark, ent_p)
    tr = json_docs.read_mentions(spark, tr_p, ent).orderBy("mention_id").collect()
    assert [(r.mention_id, r.mention, r.entity_name) for r in tr] == [("k#0", "db2 v11", "Db2"), ("k#1", "IBM DB2", "Db2")]
    te = json_docs.read_test_mentions(spark, te_p, ent).collect()
    assert [(r.mention_id, r.mention, r.entity_name) for r in te] == [("q1", "db 2", "Db2")]


def test_from_texts(spark):
    assert [(r.row_id, r.text) for r in tables.from_texts(spark, ["a", "b"]).collect()] == [(0, "a"), (1, "b")]


def test_partition_values_keep_their_type(spark, tmp_path):
    rows = [(1, "01"), (2, "1"), (3, None)]
    tables.write_table(spark.createDataFrame(rows, "id long, code string"), str(tmp_path / "t"), partition_by="code")
    back = tables.read_table(spark, str(tmp_path / "t"), schema="id long, code string")
    assert sorted(map(tuple, back.collect())) == rows
