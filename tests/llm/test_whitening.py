"""Whitening against numpy on whole tables, and on odd ones."""

from __future__ import annotations

import numpy as np
import pytest

from canonry.llm import queries, whitening


def brute(vectors, count=8):
    x = np.floor(1024 * np.array(vectors, dtype=float)).astype(np.int64) + 100_000
    n = len(x)
    away = n * x - x.sum(0)
    c = away / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, (away.astype(object) ** 2).sum(1), c @ vectors[:, :count] / np.sqrt(np.abs(values[:count])), values / values.sum()


def held(got, ids, vectors, count=8):
    n, deviation, whitened, share = brute(vectors, count)
    place = {v: i for i, v in enumerate(ids)}
    z = np.full((n, count), np.nan)
    for r in got:
        z[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == deviation[place[r.vec_id]] == r.deviation_decimal
        assert abs(r.explained - share[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    assert len(got) == n * count
    sign = np.sign((z * whitened).sum(0))
    assert np.abs(z - whitened * sign).max() < 1e-6


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_numpy(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()
    held(queries.op12_whitening(spark, f"/root/testdata/{sf}").collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


SCHEMA = "vec_id long, embedding array<float>, n long, whitened string, x string"


def table(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, 1, "clash", "clash") for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def test_many_blocks_and_bad_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", (7, 7))
    monkeypatch.setattr(whitening, "BLOCK_COLS", 4)
    rng = np.random.default_rng(0)
    good = (rng.normal(size=(150, 10)) @ rng.normal(size=(10, 10))).astype(np.float32)
    vectors = [v.tolist() for v in good] + [good[3].tolist()] * 5
    bad = [None, [], [None] * 10, [1.0] * 9 + [float("nan")], [float("-inf")] + [0.0] * 9, [1.0, 2.0], [0.5] * 9 + [None]]
    got = whitening.whiten(table(spark, vectors + bad)).collect()
    held(got, range(len(vectors)), vectors)
    assert len({tuple(round(r.whitened, 9) for r in got if r.vec_id == i) for i in (3, 150, 154)}) == 1


def test_degenerate_tables(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).columns == list(whitening._OUT)
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    one = whitening.whiten(table(spark, [[0.5, 1.5]], 1)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [
        (1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    # A constant entry: its component has no variance, the other one is whitened.
    got = whitening.whiten(table(spark, [[float(i), 2.0] for i in range(9)])).collect()
    assert len(got) == 18 and all((r.whitened is None) == (r.component == 2) for r in got)
    assert all(r.identity_error < 1e-9 for r in got)


def test_ids_null_repeated_and_wide_deviation(spark):
    rows = [(None, [float(i), float(i * i % 7)], 1, None, None) for i in range(6)] + [(4, [2e6 * i, 1.0], 1, None, None) for i in range(3)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 18
    wide = whitening.whiten(spark.createDataFrame([(i, [(-1.0) ** i * 1e7], 1, None, None) for i in range(4)], SCHEMA)).collect()
    x = [int(1024 * (-1.0) ** i * 1e7) + 100_000 for i in range(4)]
    assert sorted((r.vec_id, r.deviation_decimal) for r in wide) == [(i, (4 * x[i] - sum(x)) ** 2) for i in range(4)]
    assert all(r.deviation is None for r in wide)
