"""Ridge classifier: against numpy on the same features, many classes in blocks, odd rows."""

import numpy as np
import pytest

from canonry.operators import ridge


def _rows():
    words = "red green blue apple pear plum stone river hill".split()
    rng = np.random.default_rng(4)
    return [(i, " ".join(rng.choice(words[3 * (i % 3): 3 * (i % 3) + 4 - (i % 3 == 2)], 5)), i % 3) for i in range(60)]


SCHEMA = "id long, text string, label long"


def test_weights_and_predictions_equal_numpy(spark):
    data = [*_rows(), (0, _rows()[0][1], 0), (None, "red green", 0), (70, None, 1), (71, "", 2), (0, "hill hill river", 2)]
    df = spark.createDataFrame([*data, (80, "red", None), (81, "red", -1)], SCHEMA).repartition(5)
    model = ridge.train_ridge(df, "id", dim=8)
    feats = ridge.features(spark.createDataFrame(data, SCHEMA), "id", "text", 8, keep_cols=("label",)).collect()
    assert len(feats) == len(data)
    x = np.zeros((len(feats), 9))
    x[:, 8] = 1
    for k, f in enumerate(feats):
        for e in f.x:
            x[k, e.entry] = e.v / 1024
    y = np.eye(3)[[f.label for f in feats]]
    want = np.linalg.solve(x.T @ x + np.eye(9), x.T @ y)
    got = {r.label: r.weights for r in model.weights.collect()}
    assert np.allclose([got[c] for c in range(3)], want.T, atol=1e-9)
    whole = ridge.predict_ridge(model, df, "id")
    rows = sorted((str(r.id), r.label, r.score) for r in whole.collect())
    assert len(rows) == len(data) + 2
    parts = sorted((str(r.id), r.label, r.score) for r in
                   ridge.predict_ridge(model, df, "id", max_weight_bytes=8 * 9).collect())
    assert parts == rows
    best = {str(f.id): c for f, c in zip(feats, np.round(x @ want, 9).argmax(axis=1))}
    assert all(best[i] == c for i, c, _ in rows if i in best and i not in ("0", "80", "81"))


def test_no_training_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = ridge.train_ridge(none, "id", dim=4)
    assert model.weights.count() == 0
    got = ridge.predict_ridge(model, spark.createDataFrame(_rows()[:2], SCHEMA), "id").collect()
    assert len(got) == 2 and all(r.label is None for r in got)
    with pytest.raises(ValueError):
        ridge.train_ridge(none, "id", dim=ridge.MAX_DIM + 1)
