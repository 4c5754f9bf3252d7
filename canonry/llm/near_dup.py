"""Near duplicates by ProbMinHash, banding and exact verification.

A text's elements are its distinct five-word shingles (lower-cased A to Z; a shorter text is one
shingle), all of one weight however often they occur, as the verification below counts them. Each
element's arrivals are a Poisson process of its
weight, seeded by its hash; an arrival takes one of ``REGISTERS`` registers, which
keeps its earliest arrival's element. An element stops as soon as its next arrival is later than
all of its text's registers. Two texts agree in a register with the probability Jaccard similarity
of their weighted shingles, for equal weights the Jaccard similarity of the sets. Bands of ``ROWS`` registers (``REGISTERS / ROWS`` of them) are bucket
keys: a pair of similarity 0.8 shares one with probability 1 - (1 - 0.8^4)^24 = 0.999997.

Texts with the same words are one node throughout, so copies cost one row each. In a bucket
every node is verified against one pivot (exact Jaccard of the shingle sets), never all
against all; links give classes by repeated minimum labels. Where that leaves much open, more
pivots follow. What pivots cannot settle is settled afterwards: nodes of a bucket that are still in another class than its pivot are verified
against the bucket's nodes of other classes, left out only where the two distances to the
pivot, by the triangle inequality, rule a link out. So no link between texts that
share a bucket is lost, and a group of copies costs rows in proportion to its size.

Edge cases: null and empty texts have no words, are like nothing and form classes of their own.
Repeated rows and equal texts share a class. The class id is the smallest document id in it
(null only if all are). An empty table gives no rows. Extra columns are ignored by ``classes``
and kept by ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canonry.llm import textbytes
from canonry.session import arrow_batches, cut_lineage

SHINGLE = 5
SIMILARITY = 0.8
REGISTERS = 96
ROWS = 4
#: Megabytes of an Arrow batch of texts, and bytes of text that are worked on at a time.
BATCH_MB = 2
CHUNK_BYTES = 1 << 20

_STEP = np.uint64(0xD1342543DE82EF95)
_PICK = np.uint64(0xA0761D6478BD642F)


def elements(words: textbytes.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, occurrences) of the distinct shingles of a chunk's texts, by text."""
    code, counts = words.code, words.counts
    hashes = textbytes.window_codes(code, k)
    inside = textbytes.window_mask(words.first, len(code), k)
    doc, value = words.doc[: len(hashes)][inside], hashes[inside]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [int(textbytes.window_codes(code[a:b], b - a)[0]) for a, b in zip(words.first[short], words.first[short + 1])]
        doc, value = np.concatenate((doc, short)), np.concatenate((value, np.array(whole, dtype=np.uint64)))
    key = textbytes.mix(value + doc.astype(np.uint64) * _STEP)
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    order = np.argsort(doc[at], kind="stable")
    return doc[at][order], value[at][order], n[order]


def signatures(n_docs: int, doc: np.ndarray, value: np.ndarray, weight: np.ndarray,
               registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of weighted sets: the element that holds each register (texts x registers)."""
    best = np.full(n_docs * registers, np.inf)
    held = np.zeros(n_docs * registers, dtype=np.uint64)
    latest = np.full(n_docs, np.inf)
    time = np.zeros(len(value))
    r = 0
    while len(value):
        r += 1
        step, pick = (np.uint64(r * int(c) & 0xFFFFFFFFFFFFFFFF) for c in (_STEP, _PICK))
        uniform = ((textbytes.mix(value + step) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time = time - np.log(uniform) / weight
        early = time <= latest[doc]
        doc, value, weight, time = doc[early], value[early], weight[early], time[early]
        slot = doc * registers + (textbytes.mix((value ^ _PICK) + pick) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, time)
        won = best[slot] == time
        held[slot[won]] = value[won]
        open_docs = np.unique(doc)
        latest[open_docs] = best.reshape(n_docs, registers)[open_docs].max(axis=1)
    return held.reshape(n_docs, registers)


def _text_codes(words: textbytes.Words) -> np.ndarray:
    """64-bit hash of each text's word sequence (0 for none)."""
    n = len(words.first) - 1
    power = np.cumprod(np.full(int(words.counts.max(initial=0)) + 1, _STEP, dtype=np.uint64))
    place = np.arange(len(words.code)) - np.repeat(words.first[:-1], words.counts)
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(words.code * power[place], dtype=np.uint64)))
    code = textbytes.mix(total[words.first[1:]] - total[words.first[:-1]] + words.counts.astype(np.uint64))
    return np.where(words.counts > 0, code, np.zeros(n, dtype=np.uint64))


def _signed(docs: DataFrame, registers: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, node, n, bands) per row; ``n`` shingles, ``bands`` bucket keys."""

    def run(batches):
        for batch in batches:
            for chunk in textbytes.chunks(batch.column(2), lower=True, limit=CHUNK_BYTES):
                words = textbytes.words(chunk)
                doc, value, _ = elements(words)
                # Equal weights: candidates are drawn by the measure that _verified judges links by.
                held = signatures(chunk.n_docs, doc, value, np.ones(len(value)), registers)
                bands = np.zeros((chunk.n_docs, registers // rows), dtype=np.uint64)
                for i in range(rows):
                    bands = textbytes.mix(bands * _STEP + held[:, i::rows] + np.arange(registers // rows, dtype=np.uint64))
                size = np.bincount(doc, minlength=chunk.n_docs)
                offsets = pa.array(np.arange(chunk.n_docs + 1, dtype=np.int32) * (registers // rows))
                part = slice(chunk.first, chunk.first + chunk.n_docs)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], batch.column(1)[part], pa.array(_text_codes(words).view(np.int64)),
                    pa.array(size.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1).view(np.int64)))],
                    names=["doc_id", "text_hash", "node", "n", "bands"])
        textbytes.give_back()

    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, n long, bands array<long>")


def _shingled(texts: DataFrame) -> DataFrame:
    """(node, shingles) of (text): the set as an array."""

    def run(batches):
        for batch in batches:
            for chunk in textbytes.chunks(batch.column(0), lower=True, limit=CHUNK_BYTES):
                words = textbytes.words(chunk)
                doc, value, _ = elements(words)
                offsets = np.searchsorted(doc, np.arange(chunk.n_docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_text_codes(words).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.view(np.int64)))],
                    names=["node", "shingles"])
        textbytes.give_back()

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``similarity`` to pairs (a, b): exact Jaccard of their shingle sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").select(
        "a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("similarity"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of the edges (a, b): the smallest node that each one reaches.

    Rounds of "take the smallest label around, then that node's label": each round is cut
    by a written table, and the number of rounds grows with the logarithm of a chain's length.
    """
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), name="edges")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                         .select("node", F.least("node", "label").alias("label")), name="labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("to"), "label")
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("next"))
        new = cut_lineage(step.join(jump, "to", "left").select(
            "node", F.least("to", F.coalesce("next", "to")).alias("label"), F.col("label").alias("old")), name="labels")
        labels = new.select("node", "label")
        if not new.filter("label < old").limit(1).count():
            return labels


def _open_pairs(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, n, label) of different labels that may be ``similarity`` alike; none is lost.

    With all shingles ordered from rare to common, a pair's first common shingle stands at places i and j
    with min(n_a - i, n_b - j) >= similarity / (1 + similarity) * (n_a + n_b): it is among the first of both.
    Texts that differ from a common source in more than a link allows have their own shingles there.
    """
    shingles = sets.join(nodes, "node").select("node", "n", "label", F.explode("shingles").alias("shingle"))
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    place = F.row_number().over(W.partitionBy("node").orderBy(F.coalesce("texts", F.lit(1)), "shingle"))
    placed = shingles.join(shared, "shingle", "left").withColumn("rest", F.col("n") - place + 1)
    first = cut_lineage(placed.filter((F.col("rest") >= similarity * F.col("n") - 1e-6) & F.col("texts").isNotNull()), name="first")
    share = similarity / (1 + similarity)
    smaller = first.filter(F.col("rest") >= 2 * share * F.col("n") - 1e-6).select(
        "shingle", *[F.col(c).alias(f"{c}_a") for c in ("node", "n", "label", "rest")])
    larger = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("node_a") < F.col("node")))
    near = F.least("rest_a", "rest") >= share * (F.col("n_a") + F.col("n")) - 1e-6
    return smaller.join(first, "shingle").filter((F.col("label_a") != F.col("label")) & larger & near).select(
        F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds each member's ``label`` and its bucket's ``main`` one, the pivot's."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    of_pivot = named.filter("node = pivot").select("key", F.col("label").alias("main"))
    return cut_lineage(named.join(of_pivot, "key"), name="placed")


def classes(docs: DataFrame, similarity: float = SIMILARITY, registers: int = REGISTERS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_hash, class_id) of every row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"),
                        F.col("text").cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_MB):
        signed = cut_lineage(_signed(keyed, registers, rows), name="signatures")
    nodes = signed.filter("n > 0").groupBy("node").agg(F.first("bands").alias("bands"), F.first("n").alias("n"))
    members = nodes.select("node", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = cut_lineage(members.join(sizes, "key"), name="buckets")
    # The pivot is the node with the most company in all of its buckets: of near copies the text they came from.
    mass = members.groupBy("node").agg(F.sum("size").alias("mass"))
    members = members.join(mass, "node")
    central = F.max_by("node", F.struct("mass", "node"))
    members = cut_lineage(members.join(members.groupBy("key").agg(central.alias("pivot")), "key"), name="buckets")

    wanted = signed.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
    texts = keyed.join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"]).select("text")
    with arrow_batches(docs.sparkSession, BATCH_MB):
        sets = cut_lineage(_shingled(texts).dropDuplicates(["node"]), name="shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        return cut_lineage(_verified(pairs, sets), name="pairs")

    known = linked(members.filter("node != pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct())
    links = known.filter(F.col("similarity") >= similarity).select("a", "b")
    labels = components(links)
    placed = _placed(members, labels)
    # Nodes left in another class than their bucket's pivot, against all nodes of other classes in such buckets.
    unsettled = placed.filter("label != main").select("key").distinct()
    nodes = cut_lineage(placed.join(unsettled, "key", "left_semi").select("node", "n", "label").distinct(), name="open")
    open_pairs = _open_pairs(nodes, sets, similarity)
    more = linked(open_pairs).filter(F.col("similarity") >= similarity).select("a", "b")
    if more.limit(1).count():
        labels = components(links.union(more))

    named = signed.join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    least = named.filter("n > 0").groupBy(F.col("group").alias("g")).agg(F.min("doc_id").alias("class_id"))
    return named.join(least, (F.col("group") == F.col("g")) & (F.col("n") > 0), "left").select(
        "doc_id", "text_hash", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest id, all columns as they came; repeated rows go."""
    found = classes(docs, **options)
    others = found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(
        F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    own = F.xxhash64(docs.text.cast("string"))
    left = docs.join(others, docs.doc_id.eqNullSafe(others.k) & (own == others.h), "left_anti")
    hashed = left.select(F.struct("*").alias("row"), F.col("doc_id").alias("k"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    return hashed.dropDuplicates(["k", "h"]).select("row.*")
