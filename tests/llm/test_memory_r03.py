"""Executor memory of op1_context_tree and near duplicates: what tasks are handed at a time is bounded."""

import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from canonry.llm import context_tree, near_dup

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture()
def texts(spark):
    """6 MB in one partition: more than an Arrow batch, few rows."""
    return spark.createDataFrame([(i, f"{i} " + "lorem ipsum " * 16_000) for i in range(32)], "doc_id long, text string").coalesce(1)


def test_context_tree_texts_come_in_small_batches(texts):
    blocks = context_tree._blocks(texts.select("doc_id", F.lit(True), "text"), 64 << 20)
    sizes = [sum(len(t) for batch in pa.ipc.open_stream(r.rows) for t in batch.column(2).to_pylist()) for r in blocks.collect()]
    assert sum(sizes) == texts.agg(F.sum(F.length("text"))).first()[0]
    assert max(sizes) < (context_tree.BATCH_MB + 1) << 20


def test_context_tree_counts_are_hashed_once(spark, texts, monkeypatch):
    plans, write = {}, context_tree.cut_lineage

    def written(df, *args, **kwargs):
        plans[kwargs.get("name")] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, *args, **kwargs)

    monkeypatch.setattr(context_tree, "cut_lineage", written)
    assert context_tree.score(texts, F.lit(True), depth=2).count() == 32
    plan = plans["counts"]
    assert "HashAggregate" in plan and "HashAggregate" not in plan[plan.index("Exchange"):]


def test_near_duplicates_texts_come_in_small_batches(spark, texts, monkeypatch):
    used, write = {}, near_dup.cut_lineage

    def written(df, *args, **kwargs):
        used[kwargs.get("name")] = int(spark.conf.get(BATCH).rstrip("bB"))
        return write(df, *args, **kwargs)

    before = spark.conf.get(BATCH)
    monkeypatch.setattr(near_dup, "cut_lineage", written)
    assert near_dup.classes(texts).count() == 32
    assert used["signatures"] == used["shingles"] == near_dup.BATCH_MB << 20
    assert spark.conf.get(BATCH) == before and used["buckets"] == int(before.rstrip("bB"))


def test_packing_workers_keep_little_memory():
    """A task's texts, tokens and known pieces are gone from its worker afterwards."""
    code = '''
import re, sys, types
import numpy as np, pyarrow as pa
from canonry.llm import packing, textbytes

def held():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def task():
    encoder = packing.PieceIds(packing.tokenizer_path())
    letters = np.random.default_rng(1).integers(97, 123, (150_000, 9), dtype=np.uint8)
    letters[:, 8] = 32
    text = pa.array([letters.tobytes().decode()])
    for chunk in textbytes.chunks(text, limit=packing.BLOCK_BYTES):
        encoder.chunk(chunk)
    assert all(type(ids) is bytes for ids in encoder._known.values()) and len(encoder._known) > 100_000

before = held()
task()
textbytes.give_back()
print(held() - before)
'''
    run = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert float(run.stdout) < 60
