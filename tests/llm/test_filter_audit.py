"""Filter audit against the definition: every order applied to every document, Shapley as the average over orders."""

from __future__ import annotations

import os
import random
import re
import sys
from collections import defaultdict
from fractions import Fraction
from itertools import permutations

import pytest

from canonry.llm import filter_audit, queries

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DOCS = "doc_id long, text string, lang string, part string, fails int, good int"
LABELS = "doc_id long, quality int, toxic int, part string"


def brute(docs, labels):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", t)

    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    parts = defaultdict(list)
    for d, t, lang in docs:
        t = t or ""
        w = words(t)
        fails = {f for f, bad in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), (
            "C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search("[#$%&*|]", t))),
            ("E", d is not None and d > least[t])) if bad}
        parts[lang or ""].append((fails, d in good, d in toxic))
    out = []
    for part, rows in parts.items():
        share, steps = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                share[f] += len(gone)
                steps.append((part, "".join(order), k, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                              sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), f))
        out += [(*s[:-1], share[s[-1]]) for s in steps]
    return sorted(out)


def test_against_every_order(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("alpha beta Gamma delta epsilon Zeta eta theta iota # kappa é lambda $5 mu nu xi".split())
                               + str(rng.randint(0, 60)) for _ in range(n))
    texts = [prose(rng.choice((5, 150, 200, 260))) for _ in range(60)]
    texts += [texts[3]] * 9 + ["", None, "", " \t\n ", "a b " * 150, "x " * 200, "É A", "word " * 30_000]
    langs = ["en", "de", None, "", "fr"]
    docs = [(i, t, langs[i % 5]) for i, t in enumerate(texts)] + [(7, texts[7], "en")] * 2 + [(None, texts[3], "de"), (None, "", None), (5, texts[9], "en")]
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**9, 1, 1), (6, None, None)]
    got = filter_audit.interactions(
        spark.createDataFrame([(*d, "clash", 99, 99) for d in docs], DOCS).repartition(3),
        spark.createDataFrame([(d, q, int(x) if x is not None else None, "clash") for d, q, x in labels], LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, [(d, q, int(x) if x is not None else None) for d, q, x in labels])


def test_empty_tables(spark):
    none, no_labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.interactions(none, no_labels).count() == 0
    one = filter_audit.interactions(spark.createDataFrame([(1, "A B", None, None, None, None)], DOCS), no_labels)
    assert one.where("part = '' AND good_lost = 0").count() == 600


@pytest.mark.parametrize("players", [2, 3, 4, 5])
def test_least_squares_give_the_average_over_orders(players):
    rng = random.Random(players)
    v = [0, *(rng.randint(-50, 50) for _ in range((1 << players) - 1))]
    orders = list(permutations(range(players)))
    share = [Fraction(0)] * players
    for order in orders:
        before = 0
        for i in order:
            share[i] += Fraction(v[before | 1 << i] - v[before], len(orders))
            before |= 1 << i
    assert filter_audit.shapley(v) == share


def test_query_equals_sql(spark):
    from oracle_check import compare, duck

    sf = "/root/testdata/sf0.001"
    message = compare(spark, sf, "op13", queries.op13_filter_audit, queries.SQL["op13_filter_audit"], duck(sf))
    assert ": OK" in message, message
