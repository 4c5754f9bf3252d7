"""Plans that must hold on larger tables: folders of files, grams, spread tables, blocks, cells, index."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def as_folders(spark, tmp_path, name, files=3):
    """The small tables, ``name`` as a folder of files."""
    for f in os.listdir(SF):
        if f != f"{name}.parquet":
            os.symlink(f"{SF}/{f}", tmp_path / f)
    spark.read.parquet(f"{SF}/{name}.parquet").repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stream_reads_a_folder_of_files(spark, tmp_path):
    from canonry.plans.catalog import QUERIES

    got = QUERIES["standardize_stream"](spark, as_folders(spark, tmp_path, "documents"))
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in want.collect())


def shuffles(df):
    """Exchanges of the plan, and those that carry text."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_bleu_counts_each_pair_without_shuffling_grams(spark, monkeypatch):
    from canonry.operators import bleu

    monkeypatch.setattr(bleu, "SLICE_TOKENS", 50)
    rng = np.random.default_rng(3)
    text = lambda: " ".join(rng.choice(["a", "b", "c", "dd"], rng.integers(0, 30)))
    rows = [(i // 2, text(), text()) for i in range(120)] + [(7, None, "a b"), (None, "a b a b", None), (None, "a b a b a", "a b a b")]
    df = spark.createDataFrame(rows, "row_id long, hypothesis string, reference string").repartition(4)
    correct, total = [0] * 4, [0] * 4
    for _, h, r in rows:
        h, r = (h or "").split(), (r or "").split()
        for n in range(1, 5):
            hc, rc = (Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += sum(hc.values())
    st = bleu.bleu_statistics(df, "hypothesis", "reference", "row_id", 4, "none")
    got = st.first()
    assert [got[f"correct_{n}"] for n in range(1, 5)] == correct and [got[f"total_{n}"] for n in range(1, 5)] == total
    assert got.ref_len == sum(len((r or "").split()) for *_, r in rows)
    assert shuffles(st) <= shuffles(df) + 1  # the sums' own exchange


def test_mentions_of_one_split_are_dealt_by_rows(spark, monkeypatch):
    from canonry.plans import fixtures as fx

    few = fx.mentions(spark, SF)
    monkeypatch.setattr(fx, "MENTION_ROWS", 5)
    many = fx.mentions(spark, SF)
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert many.rdd.getNumPartitions() >= n / 5
    assert max(many.rdd.glom().map(len).collect()) < 30
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_csv_is_written_by_several_tasks(spark, monkeypatch, tmp_path):
    from canonry.plans import catalog

    tasks = []
    write = catalog.tables.write_table_csv
    monkeypatch.setattr(catalog.tables, "write_table_csv", lambda df, path: (tasks.append(df.rdd.getNumPartitions()), write(df, path)))
    monkeypatch.setattr(catalog, "SPLITS_PER_FILE", 1)
    got = catalog.QUERIES["csv_roundtrip_split"](spark, SF)
    assert tasks[0] > 1
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").collect()), key=str)


def test_small_blocks_do_not_make_quadratically_many_tasks():
    from canonry.operators.similarity import DEFAULT_BLOCK_ROWS, MAX_BLOCK_TASKS, _block_counts, _block_rows

    assert _block_rows(100, 400, 64) == 64
    for n in (10_000, 100_000, 600_000):
        rows = _block_rows(n // 5, n - n // 5, 64)
        qb, tb = _block_counts(n // 5, n - n // 5, rows, 48)
        assert rows <= DEFAULT_BLOCK_ROWS and qb * tb <= MAX_BLOCK_TASKS


@pytest.mark.parametrize("k", [1, 3])
def test_block_kernel_equals_full_sort_over_chunks(k):
    import pandas as pd

    from canonry.operators.similarity import _block_topk

    rng = np.random.default_rng(k)
    q, t = rng.integers(-2, 3, (23, 3)).astype(float), rng.integers(-2, 3, (61, 3)).astype(float)  # many ties, zero vectors
    ids = rng.permutation(61)
    s = q @ t.T / (np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(t, axis=1)) + 1e-8)
    got = _block_topk(pd.DataFrame({"qid": np.arange(23), "vec": list(q)}), pd.DataFrame({"tid": ids, "vec": list(t)}), k, False, 7)
    want = {i: sorted(range(61), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k] for i in range(23)}
    assert {i: sorted(g.tid) for i, g in got.groupby("qid")} == {i: sorted(ids[j] for j in w) for i, w in want.items()}


def test_lr_reads_texts_once(spark, monkeypatch):
    from canonry.operators import classify

    written = []
    cut = classify.cut_lineage
    monkeypatch.setattr(classify, "cut_lineage", lambda df, **kw: (written.append(df.columns), cut(df, **kw))[1])
    rows = [(i, "red apple" if i % 2 else "blue sky", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = classify.train_lr(df, num_features=64, max_iter=5)
    assert written == [["label", "_tf"]]
    assert {r.id: r.label for r in classify.predict_lr(model, df, "id").collect()} == {i: y for i, _, y in rows}


def test_equal_sparse_rows_meet_once(spark, monkeypatch):
    from canonry.operators import similarity as sim

    met = []
    top = sim.top_k
    monkeypatch.setattr(sim, "top_k", lambda df, *a, **kw: (met.append(df.count()), top(df, *a, **kw))[1])
    rows = [(i, ["a", "b"] if i % 2 else ["b", "c"], [0.6, 0.8]) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, terms array<string>, weights array<double>")
    for method in ("blocked", "auto"):
        got = sorted(map(tuple, sim.top_k_similar(df, df, k=3, qid="id", tid="id", sparse=True, method=method).collect()))
        assert [(q, t, round(s, 9), r) for q, t, s, r in got] == [(i, 2 * j + i % 2, 1.0, j + 1) for i in range(100) for j in range(3)]
    assert max(met) <= 2 * 3 * 32  # (query class, target class) pairs of a few blocks, of 10,000


def test_routes_copy_a_query_once_a_group(spark):
    from canonry.operators import dense_cells as dc

    v = np.random.default_rng(1).normal(size=(400, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    index = dc.build(df, "id", "embedding", 3, cells=40)
    asked = dc._one_each(dc._classed(df, "id", "embedding", "t")).withColumn("tau", F.lit(float("-inf")))
    routes = dc._routes(asked, index, False, 4096)  # nothing is skipped: every query goes to all cells but its probes
    assert routes.count() == 400
    assert routes.select(F.explode("cells")).count() == 400 * (len(index.size) - min(index.probes, len(index.size)))
    assert dc._groups(index, 100)[1] and max(dc._groups(index, 100)[1]) <= max(100, max(index.size.values()))
