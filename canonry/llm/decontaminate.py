"""Benchmark decontamination by winnowing.

Words are hashed to 64 bits; every ``GRAM`` consecutive ones have a k-gram hash. Of each
``WINDOW - GRAM + 1`` consecutive k-grams, that is of each window of ``WINDOW`` words, the
leftmost smallest hash is a fingerprint. Equal windows choose the same fingerprint at the same
place, so every shared span of ``WINDOW`` words or more has one in common: joining the documents'
fingerprints with the benchmark's finds it. A hit is extended around its place in the two
texts to the shared windows that hold it, word hash by word hash.

An item of fewer words, which has no whole window, is one window of its own length; for each
such length present in the benchmark, documents give the hashes of all windows of that length
to the same join.

Documents are exploded and joined where they are read. A fingerprint of the benchmark carries the word hashes around it,
at most ``WINDOW + 2 * (WINDOW - GRAM)`` however long its item, and there are no more fingerprints than words, so while the words are at
most ``BROADCAST_WORDS`` (counted) the benchmark side has some 100 MB at most and is broadcast. Beyond that it is
joined by a shuffle, where skewed fingerprints are split by the skew join. Only hits are shuffled, combined per document.

Edge cases: null and empty texts have no words, are not contaminated and hit nothing as items.
Items with equal texts are all reported. An item with a null id counts like any other in ``n_hit``; it has no name in
``items``, ``nameless`` tells that such an item was found. Rows with equal id and text share a result, each
row gets it; rows with one id and different texts are judged apart. Empty tables on either side
give no hits. Extra columns are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canonry.llm.native import let, lower_words, window_hashes

WINDOW = 10
GRAM = 5
BROADCAST_WORDS = 500_000


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("w", F.transform(lower_words(F.col("text")), lambda x: F.xxhash64(x)))


#: Low bits of a fingerprint's code that hold its position (a text has under 2**28 words).
_PLACE = 28


def fingerprints(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds ``at`` (word position, from 0) and ``key`` of each fingerprint of the word hashes ``w``,
    and a row with neither per input row.

    A k-gram's code is the high bits of its hash followed by its position, so the smallest code
    of a window is its leftmost smallest hash and tells the place. A row per window is generated
    and kept where its smallest code is not that of the window before: plain
    expressions over the array, which compile to one loop. Keys that agree by chance fall
    to the extension.
    """
    span = window - gram + 1
    keep = [F.col(c) for c in rows.columns]

    def smallest(first: Column) -> Column:
        return F.least(*[F.shiftleft(F.shiftright(F.get("g", first + j), _PLACE), _PLACE).bitwiseOR((first + j).cast("long"))
                         for j in range(span)])

    slid = rows.withColumn("g", window_hashes(F.col("w"), gram)).select(
        *keep, "g", F.explode(F.sequence(F.lit(-1), F.greatest(F.size("w") - window, F.lit(-1)))).alias("i"))
    i = F.col("i")
    chosen = slid.select(*keep, "i", F.when(i >= 0, smallest(i)).alias("code"), F.when(i > 0, smallest(i - 1)).alias("was"))
    return chosen.filter((i <= 0) | (F.col("code") != F.col("was"))).select(
        *keep, F.col("code").bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int").alias("at"),
        F.shiftright("code", _PLACE).alias("key"))


def _whole_windows(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``at`` and ``key`` of every window of ``n`` words."""
    return rows.filter(F.size("w") >= n).select(
        *[F.col(c) for c in rows.columns], F.posexplode(window_hashes(F.col("w"), n)).alias("at", "key"))


def _meet(left: DataFrame, right: DataFrame, fits: bool, window: int, back: int) -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, start, length) of shared windows around equal keys: those whose
    first word lies up to ``back`` before the key's place. Rows without a key pass with null item and start."""
    # Only the words around a key go with it.
    first = F.greatest(F.col("at") - back, F.lit(0))
    item = right.filter("key IS NOT NULL").select("item_id", F.slice("w", first + 1, window + 2 * back).alias("iw"), "key",
                                                  (F.col("at") - first).alias("q"), F.lit(True).alias("met"))
    found = left.withColumn("n_words", F.size("w").cast("long")).withColumnRenamed("at", "p")
    if fits:
        item, found = F.broadcast(item), found.withColumn("before", F.lit(0))
    else:
        lead = F.greatest(F.col("p") - back, F.lit(0))
        found = found.select("doc_id", "text_hash", "n_words", "key", lead.alias("before"), (F.col("p") - lead).alias("p"),
                             F.when(F.col("key").isNotNull(), F.slice("w", lead + 1, window + 2 * back)).alias("w"))
    met = found.join(item, "key", "left").filter("key IS NULL OR met")
    inside = lambda a, at: (at >= 0) & (at + window <= F.size(a))
    part = lambda a, at: F.slice(a, F.greatest(at, F.lit(0)) + 1, window)
    shifts = F.transform(F.filter(
        F.sequence(F.lit(0), F.lit(back)),
        lambda s: inside(F.col("w"), F.col("p") - s) & inside(F.col("iw"), F.col("q") - s)
        & (part(F.col("w"), F.col("p") - s) == part(F.col("iw"), F.col("q") - s))),
        lambda s: F.col("before") + F.col("p") - s)
    return met.select("doc_id", "text_hash", "n_words", "item_id", F.explode(
        F.when(F.col("key").isNull(), F.array(F.lit(None).cast("int"))).otherwise(shifts)).alias("start"),
        F.lit(window).alias("length"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
         broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_words, item_id, start, length): windows of a document that occur in an item,
    and one row per document with null ``start``.

    ``docs``: doc_id, text_hash, text; ``benchmark``: item_id, text.
    """
    items = _hashed(benchmark).select(F.col("item_id").cast("string").alias("item_id"), "w").filter(F.size("w") > 0)
    sizes = items.agg(F.sum(F.size("w")).alias("words"), F.sort_array(F.collect_set(
        F.when(F.size("w") < window, F.size("w")))).alias("short")).first()
    fits = (sizes["words"] or 0) <= broadcast_words
    hashed = _hashed(docs).select("doc_id", "text_hash", "w")
    out = _meet(fingerprints(hashed, window, gram), fingerprints(items, window, gram), fits, window, window - gram)
    for n in sizes["short"] or []:  # at most window - 1 lengths, and only those that occur
        out = out.union(_meet(_whole_windows(hashed, n), _whole_windows(items.filter(F.size("w") == n), n), fits, n, 0))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM,
         broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit (words inside shared windows), items (ids as strings, sorted),
    nameless (an item with a null id is among those found)."""
    marks = hits(_keyed(docs), benchmark, window, gram, broadcast_words)
    # Sets, so what a document gathers is bounded by its own words and by its own items.
    found = marks.groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count(F.when(F.col("start").isNull(), 1)).alias("n_rows"),
        F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.sort_array(F.collect_set("item_id")).alias("items"),
        F.coalesce(F.max(F.col("start").isNotNull() & F.col("item_id").isNull()), F.lit(False)).alias("nameless"))
    n_hit = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: let(s["start"] + s["length"], lambda e: F.struct(
            (a["n"] + F.greatest(e - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], e).alias("end"))),
        lambda a: a["n"])
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int")))).select(
        "doc_id", "text_hash", "n_words", n_hit.cast("long").alias("n_hit"), "items", "nameless")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that share no window with the benchmark, all columns as they came."""
    marks = hits(_keyed(docs), benchmark, **options).filter("start IS NOT NULL")
    bad = marks.select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.k) & (F.xxhash64(docs.text.cast("string")) == bad.h), "left_anti")
