"""Files read in many tasks: entries of one JSON object and CSV rows with separators inside quotes."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from canonry.sources import json_docs, tables
from canonry.sources.split_records import _chunks, json_entries


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def odd_text(rng):
    return "".join(rng.choice('a}{",:\\ \n\té\u2028[]\'/b') for _ in range(rng.randint(0, 25)))


@pytest.mark.parametrize("indent", [None, 2])
def test_entries_of_one_object(spark, small_splits, tmp_path, indent):
    rng = random.Random(1)
    data = {odd_text(rng) + str(i): {"entity_id": i, "mentions": [odd_text(rng) for _ in range(rng.randint(0, 4))]} for i in range(400)}
    data["long"] = {"entity_id": 7, "mentions": ["}" * 2000, '\\"}' * 300]}
    path = tmp_path / "train.json"
    path.write_text(json.dumps({"data": data}, ensure_ascii=bool(indent), indent=indent) + "\n", encoding="utf-8")
    assert _chunks(spark, str(path), "}").rdd.getNumPartitions() > 20
    rows = json_entries(spark, str(path), json_docs.TRAIN_FIELDS).collect()
    assert {r.key: (r.value.entity_id, r.value.mentions) for r in rows} == {k: (v["entity_id"], v["mentions"]) for k, v in data.items()}
    assert len(rows) == len(data)
    order = [r.key for r in sorted(rows, key=lambda r: (r._file, r._blk, r._i))]
    assert order == list(data)


def test_repeated_key_keeps_its_last_entry_and_files_are_told_apart(spark, small_splits, tmp_path):
    one = '{"data": {"a": {"entity_id": 1, "entity_name": "x}"}, "b": {"entity_id": 2, "entity_name": "y"}, "a": {"entity_id": 3, "entity_name": "z"}}}'
    (tmp_path / "1.json").write_text(one)
    (tmp_path / "2.json").write_text('{ "data" : { } }')
    (tmp_path / "3.json").write_text('{"data": {"c": {"entity_id": 4, "entity_name": "", "entity_type_id": null}}}')
    got = json_docs.read_entities(spark, str(tmp_path)).collect()
    assert sorted((r.id, r.name) for r in got) == [(2, "y"), (3, "z"), (4, "")]


@pytest.mark.parametrize("text", ['{"data": {"a": {"entity_id": 1, "entity_name": "x"', '{"data": {"a": {"entity_id": 1, "entity_name": "x}}}',
                                  '{"data": {"a": {"entity_id": 1}}}', '{"other": {"a": {"entity_id": 1, "entity_name": "x"}}}',
                                  '{"data": {"a": {"entity_id": "no number", "entity_name": "x"}}}', '{"data": {"a": {}, 5: {"entity_id": 1}}}'])
def test_other_shapes_stop_the_job(spark, tmp_path, text):
    (tmp_path / "e.json").write_text(text)
    with pytest.raises(Exception):
        json_docs.read_entities(spark, str(tmp_path / "e.json")).collect()


def test_objects_written_by_tasks_come_back(spark, tmp_path):
    rows = [(i, f'n "{i}" }} \\ \n é', i % 3, "t") for i in range(50)]
    ent = spark.createDataFrame(rows, "id long, name string, type_id long, type_name string").repartition(4)
    for files in (None, 1):
        json_docs.write_entities(ent, str(tmp_path / f"e{files}"), files)
        got = json_docs.read_entities(spark, str(tmp_path / f"e{files}"))
        assert sorted((r.id, r.name, r.type_id, r.type_name) for r in got.collect()) == rows
    for part in (tmp_path / "e1").glob("part-*"):
        assert len(json.loads(part.read_text())["data"]) == 50
    json_docs.write_entities(ent.limit(0), str(tmp_path / "none"))
    assert json_docs.read_entities(spark, str(tmp_path / "none")).count() == 0


def test_csv_with_line_breaks(spark, small_splits, tmp_path):
    rng = random.Random(2)
    rows = [(i, odd_text(rng) + rng.choice(["", "\r\n", "NA", '""', " "]), rng.choice(["en", " de "])) for i in range(300)]
    rows.append((300, "line\n" * 500, "en"))
    with open(tmp_path / "t.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n")
        w.writerow(["id", "text", "lang"])
        w.writerows(rows)
    schema = "id long, text string, lang string"
    assert _chunks(spark, str(tmp_path / "t.csv"), "\n").rdd.getNumPartitions() > 10
    got = tables.read_table_csv_split(spark, str(tmp_path / "t.csv"), schema)
    assert sorted(map(tuple, got.collect())) == rows
    nulls = spark.createDataFrame([(1, None, ""), (2, "", None), (3, "null", "NA"), (4, 'q"\n"', " b ")], schema)
    tables.write_table_csv(nulls, str(tmp_path / "n"))
    assert sorted(map(tuple, tables.read_table_csv_split(spark, str(tmp_path / "n"), schema).collect())) == sorted(map(tuple, nulls.collect()))
    tables.write_table_csv(nulls.where(F.lit(False)), str(tmp_path / "empty"))
    assert tables.read_table_csv_split(spark, str(tmp_path / "empty"), schema).count() == 0
