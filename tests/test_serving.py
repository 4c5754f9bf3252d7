import json
import os

from pyspark.sql import functions as F

from canonry.operators import classify, metrics, serve
from canonry.session import scratch_path
from canonry.sources import models, report
from canonry.streaming import scoring

SF_SMALL = "/root/testdata/sf0.001"


def _std(spark):
    train = spark.createDataFrame(
        [("IBM DB2 v11", "Db2"), ("db2 luw", "Db2"), ("Oracle DB 19c", "Oracle Database"),
         ("oracle database", "Oracle Database"), ("apache tomcat 9", "Tomcat"), ("tomcat server", "Tomcat")],
        "mention string, entity_name string")
    return serve.fit_standardizer(train, "mention", "entity_name")


def test_standardize_keeps_every_row_and_order_key(spark):
    std = _std(spark)
    df = spark.createDataFrame([(0, "DB2 11.5"), (1, "Tomcat"), (2, ""), (3, None)], "row_id long, text string")
    got = {r.row_id: r.predicted for r in serve.standardize(df, std).collect()}
    assert set(got) == {0, 1, 2, 3}
    assert got[0] == "Db2" and got[1] == "Tomcat"
    assert all(v is not None for v in got.values())  # always some label, never abstains


def test_request_response_json(spark):
    std = _std(spark)
    bodies = spark.createDataFrame([(7, json.dumps({"texts": ["oracle 19c", "tomcat 10", "db2"]}))],
                                   "request_id long, body string")
    rows = serve.from_request(bodies).withColumn("_k", F.struct("request_id", "pos"))
    resp = serve.to_response(serve.standardize(rows, std, "_k", "text")).first()
    assert json.loads(resp.response) == {"results": ["Oracle Database", "Tomcat", "Db2"]}


def test_map_lines_from_to(spark):
    std = _std(spark)
    df = spark.createDataFrame([(1, " db2 \n\n tomcat  \n")], "doc_id long, text string")
    got = [(r.line_no, r["from"], r["to"]) for r in serve.map_lines(df, std, "doc_id", "text").orderBy("line_no").collect()]
    assert got == [(0, "db2", "Db2"), (1, "tomcat", "Tomcat")]


def test_model_roundtrip_and_stream_equal_batch(spark):
    std = _std(spark)
    path = scratch_path(spark, "test-model")
    models.save_model(std, path)
    loaded = models.load_model(spark, path)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    batch = {r.doc_id: r.label for r in classify.predict_labels(std.model, docs, "doc_id", "text").collect()}
    again = {r.doc_id: r.label for r in classify.predict_labels(loaded.model, docs, "doc_id", "text").collect()}
    assert batch == again
    stream = (spark.readStream.schema(spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema)
              .option("pathGlobFilter", "documents.parquet").parquet(SF_SMALL))
    sink, ckpt = scratch_path(spark, "test-sink"), scratch_path(spark, "test-ckpt")
    scoring.standardize_stream(stream, std, "doc_id", "text", sink, ckpt).awaitTermination()
    streamed = {r.doc_id: r.label for r in scoring.read_sink(spark, sink).collect()}
    assert streamed == batch


def test_report_file(spark):
    m = spark.createDataFrame([(0.5, 0.25, 0.125, 0.5)], "accuracy double, weighted_f1 double, "
                              "weighted_precision double, weighted_recall double")
    path = scratch_path(spark, "test-report")
    report.write_report(metrics.metrics_report(m), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "*" * 80
    assert lines[1:] == ["Accuracy: 0.50000", "F1 Score: 0.25000", "Precision: 0.12500", "Recall: 0.50000"]
