import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from canonry.functions.vectors import cosine
from canonry.operators import bleu, classify, labels, metrics, serve, similarity as sim
from canonry.operators.ranking import dense_index


def test_dense_index(spark):
    df = spark.createDataFrame([(w,) for w in "pear apple fig kiwi banana".split()], "w string").repartition(3)
    got = sorted((r["index"], r["w"]) for r in dense_index(df, "w", "index").collect())
    assert got == list(enumerate(sorted("pear apple fig kiwi banana".split())))


def test_encode_unknown_and_null(spark):
    vocab = labels.build_vocabulary(spark.createDataFrame([("b",), ("a",)], "entity_name string"))
    df = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id long, entity_name string")
    got = dict((r.id, r.label) for r in labels.encode_labels(df, vocab).collect())
    assert got == {1: 0, 2: -1, 3: -1}


def test_cosine_zero_vector_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "true")
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert df.select(cosine("a", "b")).first()[0] == 0.0


def test_top3_tie_smallest_id(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, embedding array<float>")
    # cosine scores to the query: ids 0..3 -> 0.1, 0.3, 0.2, 0.3 (as 1, 3, 2, 3)
    vecs = [[0.1, math.sqrt(1 - 0.01)], [0.3, math.sqrt(1 - 0.09)], [0.2, math.sqrt(1 - 0.04)],
            [0.3, math.sqrt(1 - 0.09)]]
    t = spark.createDataFrame(list(enumerate(vecs)), "tid long, embedding array<float>")
    for method in ("broadcast", "blocked"):
        r = sim.top_k_similar(q, t, k=3, qid="qid", tid="tid", method=method, block_rows=2).orderBy("rank").collect()
        assert [x.neighbour_id for x in r] == [1, 3, 2]


def test_blocked_equals_broadcast_and_brute_force(spark):
    rng = np.random.default_rng(3)
    Q, T = rng.normal(size=(37, 8)), rng.normal(size=(53, 8))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(Q)], "qid long, embedding array<float>")
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(T)], "tid long, embedding array<float>")
    a = {(r.query_id, r.rank): r.neighbour_id for r in sim.top_k_similar(q, t, 3, "qid", "tid", method="broadcast").collect()}
    b = {(r.query_id, r.rank): r.neighbour_id for r in
         sim.top_k_similar(q, t, 3, "qid", "tid", method="blocked", block_rows=10).collect()}
    assert a == b
    Qf, Tf = Q.astype(np.float32).astype(np.float64), T.astype(np.float32).astype(np.float64)
    S = Qf @ Tf.T / (np.outer(np.linalg.norm(Qf, axis=1), np.linalg.norm(Tf, axis=1)) + 1e-8)
    for i in range(len(Q)):
        assert [a[(i, k)] for k in (1, 2, 3)] == list(np.argsort(-S[i], kind="stable")[:3])


def test_weighted_metrics_match_definition(spark):
    y = [0, 0, 1, 1, 2, 2, 2, 3]
    p = [0, 1, 1, 1, 0, 5, 2, 1]  # class 3 never predicted, class 5 never true
    df = spark.createDataFrame(list(zip(y, p)), "y long, p long")
    got = metrics.classification_metrics(df).first()
    classes = sorted(set(y) | set(p))
    sup = Counter(y)
    prec = {c: (sum(1 for a, b in zip(y, p) if a == b == c) / max(1, sum(1 for b in p if b == c))) for c in classes}
    rec = {c: (sum(1 for a, b in zip(y, p) if a == b == c) / sup[c]) if sup[c] else 0.0 for c in classes}
    f1 = {c: (2 * prec[c] * rec[c] / (prec[c] + rec[c])) if prec[c] + rec[c] else 0.0 for c in classes}
    w = lambda m: sum(sup[c] * m[c] for c in classes) / len(y)
    assert math.isclose(got.weighted_precision, w(prec), abs_tol=1e-9)
    assert math.isclose(got.weighted_recall, w(rec), abs_tol=1e-9)
    assert math.isclose(got.weighted_f1, w(f1), abs_tol=1e-9)
    assert math.isclose(got.accuracy, got.weighted_recall, abs_tol=1e-9)


def test_exact_match_null_is_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), (None, None), ("b", "c")], "entity_name string, entity_pred string")
    assert metrics.exact_match(df).first()[0] == 0.25


def test_mapping_table_no_match(spark):
    df = spark.createDataFrame([("x", None), ("y", ""), ("z", "Z")], "from string, predicted string")
    assert [r.to for r in serve.mapping_table(df).collect()] == ["(no match)", "(no match)", "Z"]


def _bleu(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)],
                               "row_id long, hypothesis string, reference string")
    return bleu.corpus_bleu(df).first().bleu


def test_bleu_literals(spark):
    same = [("the cat sat on the mat", "the cat sat on the mat"), ("a b c d e", "a b c d e")]
    assert _bleu(spark, same) == 100.0
    assert _bleu(spark, [("x y z w", "a b c d")]) == 0.0
    assert _bleu(spark, [("", "a b c d")]) == 0.0
    assert _bleu(spark, [("a b c", "a b c")]) == 0.0


def test_bleu_smoothing_against_formula(spark):
    pairs = [("the quick brown fox jumps", "the quick red fox jumps over"), ("hello there world", "hello world")]
    got = _bleu(spark, pairs)
    hyp = [h.split() for h, _ in pairs]
    ref = [r.split() for _, r in pairs]
    correct, total = [0] * 4, [0] * 4
    for h, r in zip(hyp, ref):
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            correct[n - 1] += sum(min(c, rc[g]) for g, c in hc.items())
            total[n - 1] += max(0, len(h) - n + 1)
    smooth, logs = 1.0, []
    for n in range(4):
        if correct[n] == 0:
            smooth *= 2
            logs.append(math.log(100.0 / (smooth * total[n])))
        else:
            logs.append(math.log(100.0 * correct[n] / total[n]))
    sl, rl = sum(map(len, hyp)), sum(map(len, ref))
    bp = 1.0 if sl >= rl else math.exp(1 - rl / sl)
    assert math.isclose(got, round(bp * math.exp(sum(logs) / 4), 6), abs_tol=1e-6)


def test_naive_bayes_matches_brute_force(spark):
    train = [("red apple", 0), ("green apple pie", 0), ("blue sky", 1), ("sky high", 1), ("apple sky", 2)]
    test = [(0, "apple"), (1, "sky sky blue"), (2, "unknown words"), (3, ""), (4, "pie pie high")]
    model = classify.train_classifier(spark.createDataFrame(train, "text string, label long"), "text", "label")
    got = {r.id: r.label for r in classify.predict_labels(
        model, spark.createDataFrame(test, "id long, text string"), "id", "text").collect()}
    docs = [(t.split(), c) for t, c in train]
    vocab = {w for ws, _ in docs for w in ws}
    classes = sorted({c for _, c in docs})
    for i, t in test:
        best = None
        for c in classes:
            words = [w for ws, cc in docs if cc == c for w in ws]
            cnt = Counter(words)
            terms = [w for w in t.split() if w in vocab]
            s = math.log(sum(1 for _, cc in docs if cc == c) / len(docs))
            s += sum(math.log((cnt[w] + 1) / (len(words) + len(vocab))) for w in terms)
            if best is None or round(s, 9) > round(best[0], 9):
                best = (s, c)
        assert got[i] == best[1], (t, got[i], best)


def test_sparse_kernel_chunks_vocabulary_like_a_plain_dot_product(monkeypatch):
    """Column-chunked sparse scores equal the dot product of the rows, unknown terms add nothing."""
    import random

    import numpy as np

    from canonry.operators import similarity as sim
    rnd = random.Random(3)
    vocab = [f"t{i}" for i in range(50)]

    def rows(n):
        out = []
        for _ in range(n):
            terms = sorted(rnd.sample(vocab, rnd.randrange(0, 8)))
            out.append((terms, [rnd.random() for _ in terms]))
        return out

    q, t = rows(9), rows(7)
    monkeypatch.setattr(sim, "SPARSE_COLS", 4)
    got = sim._sparse_scores([r[0] for r in q], [r[1] for r in q], [r[0] for r in t], [r[1] for r in t])
    want = np.array([[sum(w * dict(zip(*b)).get(term, 0.0) for term, w in zip(*a)) for b in t] for a in q])
    assert np.allclose(got, want)


def test_tokenize_13a_literals(spark):
    from canonry.operators.bleu import _tokens
    df = spark.createDataFrame([("Hello, world.",), ("pi is 3.5",), ("$10-20 &amp; more",)], "t string")
    got = [r[0] for r in df.select(_tokens("t", "13a")).collect()]
    assert got == [["Hello", ",", "world", "."], ["pi", "is", "3.5"], ["$", "10", "-", "20", "&", "more"]]


def test_replace_sentinel_and_attach_predictions(spark):
    from canonry.functions.arrays import replace_sentinel
    from canonry.operators.serve import attach_predictions
    df = spark.createDataFrame([(1, [5, -100, 7]), (2, [])], "row_id long, ids array<int>")
    got = {r.row_id: r.x for r in df.select("row_id", replace_sentinel("ids", -100, 0).alias("x")).collect()}
    assert got == {1: [5, 0, 7], 2: []}
    preds = spark.createDataFrame([(1, "a")], "row_id long, predicted string")
    rows = attach_predictions(df.select("row_id"), preds).orderBy("row_id").collect()
    assert [(r.row_id, r.predicted) for r in rows] == [(1, "a"), (2, None)]


def test_spread_only_when_under_split(spark):
    from canonry.sources.tables import spread
    one = spark.range(100).coalesce(1)
    target = spark.sparkContext.defaultParallelism
    if target > 1:
        assert spread(one).rdd.getNumPartitions() == target
        assert sorted(r.id for r in spread(one).collect()) == list(range(100))
    many = spark.range(0, 100, 1, max(target, 2))
    assert spread(many) is many


def test_size_proofs_are_remembered_and_notes_are_used(spark):
    from canonry.operators import sizing
    df = spark.range(10)
    assert sizing.row_bound_ok(df, 10) and not sizing.row_bound_ok(df, 9)
    assert sizing._KNOWN[df] == 10
    big = spark.range(50)
    assert not sizing.row_bound_ok(big, 20)
    assert not sizing.row_bound_ok(big, 5)
    noted = sizing.note_rows(spark.range(3), 3)
    assert sizing.row_bound_ok(noted, 3) and not sizing.row_bound_ok(noted, 2)


def test_bucketed_lineage_cut_feeds_a_window_without_exchange(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from canonry.session import cut_lineage_bucketed
    df = spark.range(200).select((F.col("id") % 17).alias("row"), (F.col("id") % 5).alias("t"), F.col("id").alias("v"))
    b = cut_lineage_bucketed(df, "row", n_buckets=4, name="test-bucketed")
    w = b.withColumn("s", F.sum("v").over(Window.partitionBy("row", "t")))
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert sorted(map(tuple, w.select("row", "t", "v", "s").collect())) == sorted(
        map(tuple, df.withColumn("s", F.sum("v").over(Window.partitionBy("row", "t"))).collect()))


def test_predictions_leave_nothing_cached(spark):
    from canonry.operators import serve
    train = spark.createDataFrame([("red apple", "A"), ("green pear", "B")], "mention string, entity_name string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    std = serve.fit_standardizer(train)
    for _ in range(2):
        df = spark.createDataFrame([(1, "apple"), (2, "zzz"), (3, None)], "row_id long, text string")
        assert {r.row_id: r.predicted for r in serve.standardize(df, std).collect()} == {1: "A", 2: "A", 3: "A"}
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_topk_rows_equals_full_sort():
    import numpy as np

    from canonry.operators.similarity import _topk_rows
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        scores = rng.integers(0, 4, (7, 12)) / 4.0
        tids = np.array([f"t{i}" for i in rng.permutation(12)], dtype=object)
        q, t, s, r = _topk_rows(np.arange(7), scores, tids, k, False)
        want = [(i, tid, -neg, n + 1) for i in range(7)
                for n, (neg, tid) in enumerate(sorted((-scores[i, j], tids[j]) for j in range(12))[:k])]
        assert list(zip(q, t, s, r)) == want


def test_every_query_has_a_neighbour(spark):
    from canonry.operators import similarity as sim
    nb = spark.createDataFrame([(1, 20, 0.5, 1)], "query_id long, neighbour_id long, score double, rank int")
    q = spark.createDataFrame([(1,), (2,)], "id long")
    t = spark.createDataFrame([(20,), (10,)], "id long")
    rows = sorted(tuple(x) for x in sim.every_query(nb, q, t, "id", "id").collect())
    assert rows == [(1, 20, 0.5, 1), (2, 10, 0.0, 1)]
    assert sim.every_query(nb, q, t.limit(0), "id", "id").count() == 1


def test_block_counts_bound_block_size_and_copies():
    import math

    from canonry.operators.similarity import _block_counts
    for nq, nt, mx, tasks in [(5000, 15000, 16384, 32), (10**6, 10**6, 16384, 32000), (100, 10**9, 16384, 32000),
                              (10**9, 100, 16384, 32000), (5, 3, 2, 32), (0, 0, 10, 32)]:
        qb, tb = _block_counts(nq, nt, mx, tasks)
        assert 1 <= qb <= max(nq, 1) and 1 <= tb <= max(nt, 1)
        assert math.ceil(max(nq, 1) / qb) <= mx and math.ceil(max(nt, 1) / tb) <= mx
    # balanced sides on a big cluster: far fewer copies per row than fixed 1,024-row blocks
    qb, tb = _block_counts(10**6, 10**6, 16384, 32000)
    assert qb * tb >= 32000 and tb < 10**6 / 1024 / 4


def test_rows_with_equal_or_no_ids_are_scored_apart(spark):
    train = spark.createDataFrame([("red apple", 0), ("green apple", 0), ("blue sky", 1), ("blue sea blue", 1), ("x", 2)], "text string, label long")
    model = classify.train_classifier(train)
    texts = ["red apple", "blue sky blue", "", None, "unknown words", "blue", "red red green"]
    alone = {t: classify.predict_labels(model, spark.createDataFrame([(1, t)], "id long, text string"), "id", "text").first()[1:] for t in texts}
    rows = [(1, t, k) for k, t in enumerate(texts)] + [(None, t, 10 + k) for k, t in enumerate(texts)] + [(1, "blue", 30), (1, "blue", 31), (None, "blue", 32)]
    got = classify.predict_labels(model, spark.createDataFrame(rows, "id long, text string, k int"), "id", "text", keep_cols=["k", "text"]).collect()
    assert sorted(r.k for r in got) == sorted(r[2] for r in rows)
    for r in got:
        assert r.label == alone[r.text][0] and abs(r.score - alone[r.text][1]) < 1e-9


def test_envelope_is_the_best_class_at_every_length(spark):
    rng = np.random.default_rng(6)
    n = 10_000
    prior = np.log(rng.integers(1, 40, n) / 1e5)
    per = np.log(rng.integers(1, 500, n) + 3000.0)
    labels = rng.permutation(n)
    import pandas as pd
    classes = spark.createDataFrame(pd.DataFrame({"label": labels, "prior": prior, "per_len": per})).repartition(5)
    model = classify.NBModel(classes, None, None, 1, 1, 1.0, "word", 3, True)
    sizes = [0, 1, 2, 3, 5, 8, 13, 50, 200, 1000, 10**6]
    got = spark.createDataFrame([(x,) for x in sizes], "n long").select("n", classify._default_at(model, F.col("n")).alias("d")).collect()
    for r in got:
        score = np.round(prior - r.n * per, 9)
        assert r.d.label == labels[score == score.max()].min() and abs(r.d.score - score.max()) < 1e-6
    assert len(model.envelope["lines"]) < 60
    none = classify.NBModel(classes.limit(0), None, None, 0, 0, 1.0, "word", 3, True)
    assert spark.range(1).select(classify._default_at(none, F.col("id")).alias("d")).first().d is None
