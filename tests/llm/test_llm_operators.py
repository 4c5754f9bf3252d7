"""The ten operators and the pipeline against brute force, and on odd tables."""

from __future__ import annotations

import collections
import functools
import hashlib
import io
import math
import random
import re
import time
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canonry.llm import (context_tree, decontaminate, html_extract, licenses, near_dup, packing, quality, secrets,
                         substrings, wacz)

SCHEMA = "doc_id long, text string, lang string, w string, spans string, key long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdeghinorstu") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    texts = [prose(rng.randint(25, 120)).capitalize() + ".\n" + prose(30) + "." for _ in range(30)]
    passage = prose(55)
    for i in (3, 8, 15, 21):
        texts[i] += " " + passage + " " + prose(10)
    base = texts[5].split(" ")
    for i in range(4):
        copy = list(base)
        copy[10 + 9 * i] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[2], texts[2], "One two three", "", None, "  \n\t ", "ÄÖ Straße ÉCOLE İ   x " * 4,
              "a b c d e f g h " * 40, "x " * 3000, "no\nno\nno\nno\n" + prose(40),
              f'the token = "{hashlib.sha1(b"k").hexdigest()}" and AKIA{"B" * 16} password: hunter2hunter2 short secret=abc',
              "key aB3dE5gH7jK9mN1pQ3sT5vW7yZ0cF2 id 123e4567-e89b-12d3-a456-426614174000 ok", prose(8000)]
    rows = [(i, t, "en", "clash", "clash", 1) for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, "a null id " + prose(30), None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_context_tree(texts, depth):
    """log10 probability of a text by the recursion itself, trained on ``texts``; None where nothing was met."""
    counts = {}
    coded = lambda t: lower(t).encode() + b"\xff"

    def decisions(text, i):
        past = (b"\xff" * depth + text)[i:i + depth][::-1]
        return past, [((1 << k) | (text[i] >> (8 - k)), text[i] >> (7 - k) & 1) for k in range(8)]

    for text in map(coded, texts):
        for i in range(len(text)):
            past, steps = decisions(text, i)
            for d in range(depth + 1):
                for node, bit in steps:
                    counts.setdefault((past[:d], node), [0, 0])[bit] += 1
    children = {}
    for past, node in counts:
        if past:
            children.setdefault((past[:-1], node), []).append((past, node))
    block = lambda n: math.lgamma(n[0] + .5) + math.lgamma(n[1] + .5) - math.lgamma(sum(n) + 1) - math.log(math.pi)

    @functools.cache
    def weighted(key):
        if len(key[0]) == depth:
            return block(counts[key])
        return math.log(.5) + np.logaddexp(block(counts[key]), sum(map(weighted, children[key])))

    @functools.cache
    def one(past, node, d=0):
        n = counts.get((past[:d], node))
        if n is None:
            return None
        own = (n[1] + .5) / (sum(n) + 1)
        below = one(past, node, d + 1) if d < depth else None
        if below is None:
            return own
        share = min(1, math.exp(math.log(.5) + block(n) - weighted((past[:d], node))))
        return share * own + (1 - share) * below

    def value(text):
        text, total = coded(text), 0.0
        for i in range(len(text)):
            past, steps = decisions(text, i)
            for node, bit in steps:
                p = one(past, node)
                p = .5 if p is None else p
                total += math.log10(p if bit else 1 - p)
        return total

    return value


@pytest.mark.parametrize("block_bytes", [1 << 30, 9000])
def test_context_tree(spark, docs, none, block_bytes):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1
    learnt = collections.Counter(w for i, t in rows if not held(i) for w in [*space_words(lower(t)), None])
    n, v = sum(learnt.values()), len(learnt)
    value = plain_context_tree([t for i, t in rows if not held(i)], 2)
    want = []
    for i, t in rows:
        tokens = [*space_words(lower(t)), None]
        want.append((i, held(i), len(tokens), sum(w in learnt for w in tokens), n,
                     sum(math.log10((learnt[w] + .5) / (n + .5 * (v + 1))) for w in tokens), value(t), len(t.encode()) + 1))
    got = context_tree.score(docs, train, depth=2, block_bytes=block_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[7] == b[7] and a[5:7] == pytest.approx(b[5:7], rel=1e-9)
    assert context_tree.score(none, train).count() == 0


def test_context_tree_is_context_tree_weighting():
    """The predictions' product over a sequence's last bit equals the ratio of weighted probabilities."""
    rng = np.random.default_rng(1)
    text = bytes(rng.choice(list(b"ab"), 40).astype(np.uint8))
    chunk = context_tree.textbytes.Chunk(0, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    code, first = context_tree.gram_codes(chunk, 3)
    assert first.tolist() == [0, 41]
    padded = b"\xff\xff\xff" + text + b"\xff"
    assert [int(c) for c in code] == [int.from_bytes(padded[i:i + 4][::-1], "little") for i in range(41)]

    def total(n):
        keys, counts = np.unique(code[:n], return_counts=True)
        levels, _, _ = context_tree.tree(keys, counts, 3, 0)
        return levels, levels[0].weighted.sum()

    levels, before = total(30)
    _, after = total(31)
    grams = np.array([code[30]])
    keys = np.unique(np.concatenate((np.unique(code[:30]), grams)))
    counts = np.array([(code[:30] == k).sum() for k in keys])
    levels, where, bit = context_tree.tree(keys, counts, 3, 0)
    ones = context_tree.predict(levels, 3)
    at = int(np.searchsorted(keys, code[30]))
    if counts[at]:  # a context that training met: the prediction is exact
        value = np.where(bit[:, at] == 1, ones[where[:, at]], 1 - ones[where[:, at]])
        assert np.log(value).sum() == pytest.approx(after - before, rel=1e-9)


def test_open_pairs_lose_no_link(spark):
    rng = random.Random(11)
    base = rng.sample(range(10 ** 6), 60)
    sets = []
    for i in range(90):
        own = set(rng.sample(base, rng.randint(30, 60))) if i % 3 else set(sets[rng.randrange(len(sets))]) if sets else set(base)
        for _ in range(rng.randint(0, 9)):
            own.discard(rng.choice(base))
            own.add(rng.randrange(10 ** 6, 10 ** 7))
        sets.append(own)
    labels = [i % 7 for i in range(90)]
    nodes = spark.createDataFrame([(i, len(x), labels[i]) for i, x in enumerate(sets)], "node long, n long, label long")
    table = spark.createDataFrame([(i, sorted(x)) for i, x in enumerate(sets)], "node long, shingles array<long>")
    found = {frozenset((r.a, r.b)) for r in near_dup._open_pairs(nodes, table, 0.8).collect()}
    alike = {frozenset((i, j)) for i in range(90) for j in range(i) if labels[i] != labels[j]
             and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert len(alike) > 10 and alike <= found
    assert near_dup._open_pairs(nodes.limit(0), table, 0.8).count() == 0


def test_near_duplicates(spark, docs, none):
    rows = {(r.doc_id, r.text_hash): r.class_id for r in near_dup.classes(docs).collect()}
    sets = {}
    for r in corpus():
        w = space_words(lower(r[1]))
        sets[r[0], r[1]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    keys = list(sets)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                root[find(a)] = find(b)
    want = {k: min((x[0] for x in keys if find(x) == find(k) and x[0] is not None), default=None) for k in keys}
    assert {k: v for (k, _), v in rows.items()} == {k[0]: v for k, v in want.items()}
    kept = near_dup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        {v for v in want.values() if v is not None})
    assert near_dup.classes(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_repeated_lines_lose_no_link(spark):
    """A block that one text of a pair repeats changes its counts, not its set: the pair stays linked."""
    rng = random.Random(13)
    rows, pairs = [], 20
    for i in range(pairs):
        own = [f"w{rng.randrange(10 ** 6)}" for _ in range(304)]
        block = [f"b{rng.randrange(10 ** 6)}" for _ in range(55)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(own + block * rng.choice((50, 200, 1000))))]
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (space_words(t) for _, t in rows)]
    assert all(0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.85 for i in range(0, 2 * pairs, 2))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(2 * pairs)}


def test_signatures_estimate_the_probability_jaccard():
    rng = np.random.default_rng(3)
    value = context_tree.textbytes.mix(np.arange(1, 301, dtype=np.uint64))
    x, y = rng.integers(1, 6, 300) * (rng.random(300) < 0.8), rng.integers(1, 6, 300) * (rng.random(300) < 0.8)
    weight = np.concatenate((x[x > 0], y[y > 0])).astype(float)
    doc = np.repeat([0, 1], [(x > 0).sum(), (y > 0).sum()])
    held = near_dup.signatures(2, doc, np.concatenate((value[x > 0], value[y > 0])), weight, 4096)
    both = np.flatnonzero((x > 0) & (y > 0))
    exact = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both)
    assert (held[0] == held[1]).mean() == pytest.approx(exact, abs=0.04)


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit, found = set(), set()
    for item, other in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(other))
        n = min(10, len(v))
        grams = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if n and tuple(w[i:i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, docs, none):
    texts = [r[1] for r in corpus()]
    items = [(1, texts[3][40:200]), (2, "one TWO three"), (3, None), (4, ""), (5, "a b c d e f g h a b c d"),
             (6, "x " * 12), (7, texts[3][40:200]), (10, "ÉCOLE")]
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")
    want = sorted(((r[0], *brute_hits(r[1], items)) for r in corpus()), key=str)
    for limit in (10 ** 6, 0):
        got = decontaminate.find(docs, bench, broadcast_words=limit)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == want
    clean = decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(w[0]) for w in want if not w[2])
    assert decontaminate.find(none, bench).count() == 0
    assert decontaminate.find(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_items_without_id_count(spark):
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "en"), (2, "clean text " * 9, "en"), (3, "short one here", "en")], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(None, text[30:200]), (None, "short one"), (7, text[30:200]), (None, None)], "item_id long, text string")
    hit = len(re.findall(r"\S+", text[30:200])) - 2
    for limit in (10 ** 6, 0):
        got = {r.doc_id: r for r in decontaminate.find(docs, bench, broadcast_words=limit).collect()}
        assert (got[1].n_hit >= hit and got[1]["items"] == ["7"] and got[1].nameless)
        assert (got[2].n_hit, got[2]["items"], got[2].nameless) == (0, [], False)
        assert (got[3].n_hit, got[3]["items"], got[3].nameless) == (2, [], True)
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [2]


def test_long_items_carry_only_words_around_a_fingerprint(spark):
    rng = random.Random(9)
    words = [f"w{rng.randint(0, 500)}" for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(words[i * 250:i * 250 + 60]), "en") for i in range(10)], "doc_id long, text string, lang string")
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    for limit in (10 ** 6, 0):
        assert all(r.n_hit == 60 for r in decontaminate.find(docs, bench, broadcast_words=limit).collect())


def test_archives(spark, tmp_path):
    schema = "page_id long, url string, html string, payload string"
    rows = [(5, "http://a", "<p>ä</p>", "x"), (2, None, "<p>ä</p>", None), (9, "u\n", None, None), (3, "http://b", "", None),
            (3, "http://b", "", None), (None, "http://c", "z" * 300_000, None), (7, "http://d", "z" * 300_000, None)]
    pages = spark.createDataFrame(rows, schema)
    got = sorted(map(tuple, wacz.round_trip(pages, archive_bytes=200).drop("url", "payload").collect()), key=str)
    sha = lambda t: wacz.digest((t or "").encode())
    want = [(i, len((t or "").encode()), sha(t), "revisit" if ref else "response", ref)
            for (i, _, t, _), ref in zip(rows, (2, None, 3, None, None, 7, None))]
    assert got == sorted(want, key=str)
    limited = wacz.round_trip(pages, min_bytes=100).collect()
    assert sum(r.record_type == "revisit" for r in limited) == 1
    assert wacz.round_trip(spark.createDataFrame([], schema)).count() == 0
    for zip64 in (False, True):
        writer = wacz.ArchiveWriter(zip64)
        for i in range(3):
            writer.add("u", wacz.record(i, "u", b"p" * 5000, wacz.digest(b"p" * 5000), None))
        data = writer.finish() + b"\n"
        assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
        assert len(list(wacz.read_records(wacz.Ranges(io.BytesIO(data))))) == 3
    with pytest.raises(ValueError):
        list(wacz.read_records(b"no archive"))


def test_quality(spark, docs, none):
    got = {(r.doc_id, r.n_words): r for r in quality.judge(docs).collect()}
    for doc_id, text, *_ in corpus():
        w = space_words(text)
        grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        often = {g for g in set(grams) if grams.count(g) > 1} if len(set(grams)) < len(grams) else set()
        covered = {j for i, g in enumerate(grams) if g in often for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if space_words(x)]
        r = got[doc_id, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    passed = quality.judge(docs).filter("kept").select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in passed) == sorted(str(r.doc_id) for r in quality.keep(docs).collect())
    # Each count is written once into the filter, not into every branch.
    assert quality.keep(docs)._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 4
    assert got[0, got_words(0)].kept and quality.keep(docs).columns == docs.columns
    assert quality.judge(none).count() == 0 and quality.keep(none).count() == 0


def got_words(i):
    return len(space_words(corpus()[i][1]))


def test_quality_keeps_good_documents(spark):
    d = "/root/testdata/sf0.01"
    kept = quality.keep(spark.read.parquet(f"{d}/documents.parquet"))
    good = spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1")
    lost = good.join(kept, "doc_id", "left_anti").join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")
    assert lost.filter(F.size(F.split("text", r"\s+")) >= 25).count() <= 0.02 * good.count()


def test_substrings(spark, docs, none):
    rows = [r for r in corpus() if r[0] is not None]
    seen, want = {}, {}
    for r in sorted({(r[0], r[1]) for r in rows}, key=lambda r: r[0]):
        w = space_words(r[1])
        gone = set()
        for i in range(len(w) - 19):
            g = tuple(w[i:i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.setdefault(g, (r[0], i))
        want[r[0]] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    got = substrings.deduplicate(docs.filter("doc_id IS NOT NULL")).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept) == want[r.doc_id] for r in got)
    assert substrings.deduplicate(none).count() == 0
    assert substrings.deduplicate(docs).filter("doc_id IS NULL").count() == 1


def test_hot_regions_give_the_same(spark, docs, monkeypatch):
    rows = docs.filter("doc_id IS NOT NULL")
    want = sorted(map(tuple, substrings.deduplicate(rows).collect()))
    monkeypatch.setattr(substrings, "HOT_REGIONS", 1)
    texts = rows.distinct().select(F.col("doc_id").alias("id"), F.lit(0).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    found = substrings._settle(substrings._anchored(texts, 20, 8)).withColumn("hot", F.col("anchor").isNotNull())
    placed = substrings._with_words(texts, found.filter("anchor IS NOT NULL"), 20)
    gone = found.filter("anchor IS NULL").select("id", "part", "start", "n").union(substrings._streamed(placed, 20))
    got = {tuple(r)[0]: tuple(r)[2:] for r in substrings._kept(texts, gone, 20).collect()}
    assert all(got[w[0]] == w[1:] for w in want)


def test_hot_passage_is_never_one_group(spark, monkeypatch):
    """A passage with other words around it in every document: whole results, and no large group of equal windows."""
    rng = random.Random(17)
    passage = [f"p{i}" for i in range(45)]
    word = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows = [(i, " ".join(word(15) + passage[:rng.randint(38, 45)] + word(15))) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, " ".join(word(60)))]
    seen, want = {}, {}
    for i, text in rows:
        w, gone = text.split(" "), set()
        for j in range(len(w) - 19):
            if seen.setdefault(tuple(w[j:j + 20]), (i, j)) != (i, j):
                gone |= set(range(j, j + 20))
        want[i] = (len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    groups, streamed = [], substrings._streamed

    def recorded(placed, window):
        groups.extend(r["count"] for r in placed.groupBy("key").count().collect())
        return streamed(placed, window)

    monkeypatch.setattr(substrings, "HOT_REGIONS", 5)
    monkeypatch.setattr(substrings, "_streamed", recorded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for records in ("10000", "7"):  # of few records a batch, anchors go on over many batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
        try:
            got = {r.doc_id: (r.n_removed, r.kept) for r in substrings.deduplicate(docs).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want and max(groups, default=0) <= 5


def test_automaton_matching_statistics():
    rng = random.Random(2)
    for _ in range(30):
        known = [[rng.randrange(3) for _ in range(12)] for _ in range(3)]
        text = [rng.randrange(3) for _ in range(20)]
        automaton = substrings.Automaton()
        for k in known:
            automaton.add(k)
        parts = {tuple(k[i:j]) for k in known for i in range(12) for j in range(i, 13)}
        want = [max(n for n in range(e + 2) if tuple(text[e + 1 - n:e + 1]) in parts) for e in range(20)]
        assert automaton.matches(text) == want


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for doc_id, text, *_ in corpus():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own = {(p.start, p.ids) for p in by_doc[doc_id, len(ids)]}
        assert b"".join(i for _, i in sorted(own)) == ids.tobytes()
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at and len(p.ids) == 4 * p.length > 0
            at += p.length
        assert at <= 2048
    assert packing.pack(none).count() == 0


def test_little_padding_without_full_stops(spark):
    rows = [(i, " ".join(["ab cd ef"] * 685) + " x" * (i % 3)) for i in range(120)] + [(500, "😀" * 3000), (501, "x1" * 9000)]
    by_sequence = {}
    for p in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect():
        by_sequence[p.sequence_id] = by_sequence.get(p.sequence_id, 0) + p.length
    total = sum(by_sequence.values())
    assert total / len(by_sequence) > 0.97 * 2048 and max(by_sequence.values()) <= 2048


def test_cuts_are_the_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        length = rng.randint(1, 40)
        ends = np.array(sorted({*rng.sample(range(1, length + 1), min(length, 3)), length}))
        stops = np.array(sorted(rng.sample(range(1, length + 1), min(length, 4))))
        words = np.array(sorted(rng.sample(range(1, length + 1), min(length, 6))))
        place, cost = packing.candidates(length, ends, stops, 8, 1.5, 4.0, words, rng.choice((2, 3, 64)))
        assert {*ends.tolist(), *stops.tolist()} <= {*place.tolist()} and np.diff(place, prepend=0).max() <= 8
        price = dict(zip(place.tolist(), cost.tolist()))
        best = {0: 0.0}
        for j in place.tolist():
            best[j] = min(best[i] + 8 - (j - i) + price[j] for i in best if j - 8 <= i < j)
        cuts = packing.choose_cuts(length, place, cost, 8)
        assert sum(8 - (b - a) + price[b] for a, b in zip(cuts, cuts[1:])) == pytest.approx(best[length])


def test_licenses(spark, docs, none):
    notice = dict(licenses.TEMPLATES)["MIT"]
    words = notice.split(" ")
    edited = " ".join(w if i % 40 else "edited" for i, w in enumerate(words))
    rows = [(1, "intro words " + notice + " outro"), (2, edited), (3, "Released under the MIT license"), (4, None), (5, ""),
            (6, "nothing of the kind"), (7, " ".join(words[:40])), (8, "short note"), (8, "short note")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    notices = licenses.templates(spark, [*licenses.TEMPLATES, ("short", "Short Note!"), ("none", "")])

    def shingles(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    want = {(i, k) for i, t in rows for k, v in licenses.TEMPLATES
            if len(shingles(v) & shingles(t)) >= 0.8 * len(shingles(v))} | {(8, "short")}
    for limit in (200_000, 0):
        got = licenses.find(table, notices, broadcast_shingles=limit).collect()
        assert {(r.doc_id, r.license_id) for r in got} == want
    assert licenses.find(none, notices).count() == 0 and licenses.find(docs, notices.limit(0)).count() == 0


def test_licenses_of_all_kinds(spark):
    """Licenses beyond the first nine notices, each by a text that is not word for word the table's."""
    rows = [
        ("BSD", open("/usr/share/common-licenses/BSD").read()), ("GPL-2.0-text", open("/usr/share/common-licenses/GPL-2").read()),
        ("Apache-2.0-text", open("/usr/share/common-licenses/Apache-2.0").read()),
        ("GPL-2.0-or-later", "# it under the terms of the GNU General Public License\n# as published by the Free Software Foundation;\n"
         "# either version 2 of the License, or (at your option) any later version."),
        ("AGPL-3.0-or-later", "modify it under the terms of the GNU Affero General Public License as published by the Free "
         "Software Foundation, either version 3 of the License, or (at your option) any later version."),
        ("LGPL-2.1-short", "Free to use, under the GNU Lesser General Public License, version 2.1, as ever"),
        ("CC-BY-SA-4.0", "Text is available under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring "
         "rights to this software to the public domain worldwide. This software is distributed without any guarantee."),
        ("EPL-2.0-short", "Published under the Eclipse Public License 2.0."),
        ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
         "publish, use, compile, sell or distribute this software in source code form or as a compiled binary, for any purpose, "
         "commercial or non-commercial, and by any means."),
    ]
    table = spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string")
    found = {}
    for r in licenses.find(table, licenses.templates(spark)).collect():
        found.setdefault(r.doc_id, set()).add(r.license_id)
    assert [k for i, (k, _) in enumerate(rows) if not any(f == k or f.startswith(f"{k}-short") for f in found.get(i, ()))] == []
    # A version or a family is not taken for another one.
    assert not any(k.startswith("GPL-3") for k in found[3]) and not any(k.startswith("GPL") for k in found[4])
    assert len({k for k, _ in licenses.TEMPLATES}) == len(licenses.TEMPLATES)


def test_license_bands_are_independent(spark):
    """Of windows that share 7 of 9 shingles, (2/9) ** 4 = 0.24 % agree in no band."""
    rng = np.random.default_rng(5)
    value = rng.integers(-2 ** 63, 2 ** 63, (6000, 9)).tolist()
    pairs = spark.createDataFrame([(v[:8], v[1:]) for v in value], "a array<long>, b array<long>")
    keys = [licenses._window_keys(F.col(c), 1, licenses.BANDS) for c in "ab"]
    missed = pairs.filter(F.size(F.array_intersect(*keys)) == 0).count()
    assert missed <= 33  # 14.6 expected


def test_secrets(spark, docs, none):
    import math

    found = {r.doc_id: [(s.kind, s.begin, s.end) for s in r.spans] for r in secrets.scan(docs).collect()}
    for doc_id, text, *_ in corpus():
        text = text or ""
        base = [("assign", m.start(), m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 12]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
        order = {"assign": 0, "access": 1, "hex": 2}
        assert [s for s in found[doc_id] if s[0] in order] == sorted(base, key=lambda s: (s[1], order[s[0]]))
    high = [(i, s) for i, spans in found.items() for s in spans if s[0].startswith("entropy")]
    assert [s[0] for _, s in high] == ["entropy_base64"]
    text = {r[0]: r[1] for r in corpus()}
    i, (_, begin, end) = high[0]
    for a in range(begin, end - 23):
        part = text[i][a:a + 24]
        bits = -sum(part.count(c) / 24 * math.log2(part.count(c) / 24) for c in set(part))
        assert bits >= 3.9
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert clean.filter(F.col("text").contains("hunter2hunter2")).count() == 0
    assert secrets.scan(none).count() == 0 and secrets.redact(none).count() == 0


PAGES = [
    ("<html><body><nav><a>Menu</a></nav><article><header><h1>Ti&amp;tle</h1></header><p>Long text of the article that goes on."
     "<p>Short.<script>var x='<p>no</p>'</script><aside>Side</aside><ul><li>one<li>two</ul></article>"
     "<section class=comments><p>A reader says much here, and more.</p></section><footer>Foot</footer></body></html>",
     "Ti&tle Long text of the article that goes on. Short. one two"),
    ("<div id='page'><div class='sidebar'>Links and links</div><div class='content'><h1>Head</h1><div><p>Body text that is long enough "
     "to be found.</p><p>More\n of &nbsp; it<br>here</p></div></div><div class='cookie-notice'>We use cookies</div></div>",
     "Head Body text that is long enough to be found. More of it here"),
    ("", ""), (None, ""), ("<p>", ""), ("plain words only", "plain words only"), ("<article><p>cut sho", "cut sho"),
]


def test_html(spark):
    rows = [(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(rows) + 1 and all(r.text == PAGES[r.page_id][1] for r in got)
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_regions_are_whole():
    long = "<p>" + "A long paragraph of the article that says many things. " * 6 + "</p>"
    text = " ".join(("A long paragraph of the article that says many things. " * 6).split())
    menu = "<nav><a>Menu</a></nav><div class='sidebar'><a>Links</a></div>"
    assert html_extract.main_text(f"<body>{menu}<div><h1>Head</h1><p>Intro.</p><div><h2>Part</h2>{long * 3}</div></div></body>") == (
        f"Head Intro. Part {text} {text} {text}")
    for opened in ("<div class='content has-sidebar'>", "<div class='layout right-sidebar'>", "<form id='aspnetForm'>"):
        end = "</form>" if "form" in opened else "</div>"
        for a, b in (("<article>", "</article>"), ("<div>", "</div>")):
            page = f"<body><nav>Menu</nav>{opened}{a}<h1>Head</h1>{long * 3}{b}{menu}{end}</body>"
            assert html_extract.main_text(page) == f"Head {text} {text} {text}"
    # A word of a compound name says nothing by itself; adverts and hidden text go in inline elements too.
    for name in ("side-effects", "share-of-market", "tags-explained", "the-ad-business"):
        page = f"<body><article><h1>Head</h1>{long}<div id='{name}'><h2>Part</h2><p>Short.</p></div></article></body>"
        assert html_extract.main_text(page) == f"Head {text} Part Short."
    for gone in ("<div class='ad-slot'>Buy</div>", "<div class='article-comments'><p>Me too</p></div>", "<p><span class='advert'>Buy <b>it</b></span></p>",
                 "<p><span hidden>Not <span>to be</span> seen</span></p>", "<p><i style='display: none'>Never closed</p>"):
        assert html_extract.main_text(f"<body><article><h1>Head</h1>{long}{gone}<p>End.</p></article></body>") == f"Head {text} End."
    # A form or comments beside the article still go.
    page = f"<body><article><h1>Head</h1>{long}</article><form>{long * 3}</form><div id='comments'><article>{long * 3}</article></div></body>"
    assert html_extract.main_text(page) == f"Head {text}"


def test_html_is_linear_in_depth():
    begin = time.perf_counter()
    deep = "<article><h1>Head</h1>" + "<div>" * 50_000 + "<p>The text below.</p>" + "</div>" * 50_000 + "</article>"
    assert html_extract.main_text(deep) == "Head The text below."
    stray = "<article><h1>Head</h1>" + "<div>" * 20_000 + "<p>The text below.</p>" + "</section>" * 50_000
    assert html_extract.main_text(stray) == "Head The text below."
    assert time.perf_counter() - begin < 20


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.select(F.sum("length")).first()[0] > 0
    odd = spark.createDataFrame(corpus(), SCHEMA)
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, corpus()[3][1][40:200])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    kept = {r.doc_id for r in docs.collect()}
    assert {0, 1, 4} <= kept and not kept & {3, 30, 31, 32, 33, 34, 35}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= len(kept)
    odd.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
