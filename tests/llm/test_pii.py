"""Personal data: fixed patterns against plain regular expressions, the model against held-out labels and brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from canonry.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(digits):
    odd = sum(int(c) for c in digits[-1::-2])
    even = sum(sum(map(int, str(2 * int(c)))) for c in digits[-2::-2])
    return (odd + even) % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", CARD, lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", PHONE, lambda s: 9 <= len(digits(s)) <= 15))
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text or "") if ok(m.group())]


def texts():
    rng = random.Random(4)
    alphabet = "a.Z-_%+@@..  ()0123456789\n4é𝄞"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    return [*out, "a@b.c@d.e.f", "x@@y.z", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1", "4111 1111-1111 1111", "+1 (555) 010-0199.",
            "call 𝄞 +49 30 1234567 or info@mail.example.org", "", None]


def test_fixed_patterns_equal_plain_expressions():
    for t in texts():
        assert pii.fixed_spans(t or "") == brute(t), t


def test_fixed_patterns_are_linear():
    for c in ("1", "a", "1.", "@", "a@", "+1 ", "1 -"):
        pii.fixed_spans(c * 200_000)


def test_gradient():
    rng = np.random.default_rng(0)
    w = pii.start_weights(rng, 4)
    chars = rng.integers(0, pii.SYMBOLS, (7, 3))
    tags = np.stack([pii._tags(s, 7) for s in ([("ip", 1, 4)], [("card", 0, 2), ("email", 2, 5)], [])], 1)
    grad = pii.loss_and_gradient(w, chars, tags)[1]
    for name in w:
        for at in [tuple(rng.integers(0, n) for n in w[name].shape) for _ in range(6)]:
            was = w[name][at]
            w[name][at] = was + 1e-5
            up = pii.loss_and_gradient(w, chars, tags)[0]
            w[name][at] = was - 1e-5
            down = pii.loss_and_gradient(w, chars, tags)[0]
            w[name][at] = was
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5


def pieces(n=300):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeghinorstuéü") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    return [" ".join(rng.choice(words) for _ in range(50)).capitalize() + ".\n" for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return pii.from_bytes(pii.to_bytes(pii.fit(pieces())))


def test_held_out_accuracy(model):
    held = pii.labelled(pieces(), np.random.default_rng(77), 600, 160)
    found = [{(pii.KINDS[k], b, e) for k, b, e, gain in s if gain >= pii.MARGIN} for s in pii.model_spans(model, [t for t, _ in held])]
    whole = [{s for s in spans if 0 < s[1] and s[2] < 160} for _, spans in held]
    hit = sum(len(f & w) for f, w in zip(found, whole))
    assert hit >= 0.7 * sum(map(len, whole))
    assert hit >= 0.8 * sum(len({s for s in f if 0 < s[1] and s[2] < 160}) for f in found)


def test_known_range_search_finds_the_best_path(model):
    """Ranges searched alone give the path of a search over all steps, scored against every path on short texts."""
    held = pii.labelled(pieces(), np.random.default_rng(8), 120, 90)
    coded = [pii.codes(t) for t, _ in held]
    sizes = np.array([len(c) for c in coded])
    scores = pii.tag_scores(model, coded)
    yes = np.ones(len(coded), dtype=bool)
    whole = pii.viterbi(model, [scores[:, j] for j in range(len(coded))], yes, yes)
    paths = [np.zeros(n, dtype=int) for n in sizes]
    ranges = pii.open_ranges(model, scores, sizes)
    for (j, x, y), path in zip(ranges, pii.viterbi(
            model, [scores[x:y, j] for j, x, y in ranges], np.array([x == 0 for _, x, _ in ranges]),
            np.array([y == sizes[j] for j, _, y in ranges]))):
        paths[j][x:y] = path
    assert all((a == b).all() for a, b in zip(whole, paths))


def test_viterbi_against_every_path(model):
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 2, (4, pii.TAGS)).astype(np.float32)
    t, first = model["t"] + pii.ALLOWED, model["s"] + pii.ALLOWED[0]
    value = lambda p: first[p[0]] + sum(scores[k, x] for k, x in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:]))
    best = max(np.ndindex(*[pii.TAGS] * 4), key=value)
    path = pii.viterbi(model, [scores], np.array([True]), np.array([True]))[0]
    assert abs(value(best) - value(path)) < 1e-3


def test_window_cuts_cover_and_overlap():
    for size in (1, 63, 64, 511, 512, 513, 960, 961, 5000, 100_003):
        cuts = pii.window_cuts(size)
        assert cuts[0][0] == 0 and cuts[-1][1] == size
        assert all(e - b <= pii.WINDOW for b, e in cuts)
        assert all(a[1] - b[0] >= pii.OVERLAP for a, b in zip(cuts, cuts[1:]))


def test_reconcile():
    assert pii.reconcile([(0, 5, 9, 2.0, False, False), (0, 5, 9, 2.5, False, False)]) == [(0, 5, 9, 2.5)]
    assert pii.reconcile([(1, 5, 9, 2.0, False, True), (1, 7, 14, 3.0, True, False)]) == [(1, 5, 14, 3.0)]
    assert pii.reconcile([(0, 0, 4, 2.0, False, False), (1, 3, 8, 3.0, False, False), (0, 8, 10, 2.0, False, False),
                          (2, 7, 9, 1.5, False, False)]) == [(1, 3, 8, 3.0), (0, 8, 10, 2.0)]


def test_window_results_do_not_depend_on_the_batch(model):
    many = [p for p, _ in pii.labelled(pieces(), np.random.default_rng(3), 40, 700)]
    assert pii.all_spans(model, many) == [pii.all_spans(model, [t])[0] for t in many]


def test_find_on_odd_tables(spark):
    schema = "doc_id long, text string, spans string, key long"
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts()[-9:])] + [(3, "again 10.0.0.1", None, None)] * 2 + [
        (None, "x" * 3000 + " me@here.org", None, 2), (900, "word " * 60_000, None, 2)]
    docs = spark.createDataFrame(rows, schema).repartition(3)
    weights = pii.train(docs, steps=8)
    assert weights == pii.train(docs, steps=8)
    got = pii.find(docs, weights)
    assert got.columns == ["doc_id", "text", "key", "spans"]
    found = sorted(((r.doc_id or -1), r.text or "", [(s.kind, s.begin, s.end) for s in r.spans if s.kind in pii.KINDS]) for r in got.collect())
    assert found == sorted(((d or -1), t or "", brute(t)) for d, t, _, _ in rows)
    none = spark.createDataFrame([], schema)
    assert pii.find(none, pii.train(none, steps=2)).count() == 0


def test_query_on_whole_documents(spark):
    got = {r.doc_id: r for r in queries.op11_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base = brute(d.text)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        listed = r.spans.split(",") if r.spans else []
        assert [s for s in listed if not s.startswith("model_")] == [f"{k}:{b}:{e}" for k, b, e in base]
