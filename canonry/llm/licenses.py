"""License notices: MinHash retrieval of templates over text windows, verified by shingle containment.

Texts and templates are five-word shingles of lower-cased alphanumeric words (a template of
fewer words is one shingle of its own length; those lengths are looked up too). A window of
``WINDOW`` shingles starts every ``STRIDE`` of them; of each window, ``BANDS`` smallest values
under different permutations (the shingle hashed with the band's number) are its band keys, one row each.
Templates of at least twice a window's length give the keys of all their windows: a copy of
the template then holds whole windows equal to template windows, which agree in every band, and an
edited window of Jaccard similarity s agrees in some band with probability 1 - (1 - s)^BANDS, 0.998 at
0.8. Shorter templates give the keys of one-shingle windows, their single shingles, which
are equal or not. Retrieved pairs are verified exactly: the share of the template's
distinct shingles that occur in the text must reach ``CONTAINMENT``.

The templates are a given table or the list in ``notices``; they are broadcast while they have at
most ``BROADCAST_SHINGLES`` shingles (counted) and joined by a shuffle beyond that. Texts are exploded and
joined where they are read; of a retrieved text only its hashes are shuffled, once per template.

Edge cases: null and empty texts, and empty templates, match nothing. Rows with equal id and text
give one row per license found. Templates with equal texts are all reported. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.llm.native import let, lower_words, window_hashes
from canonry.llm.notices import NOTICES

SHINGLE = 5
WINDOW = 8
STRIDE = 4
BANDS = 4
CONTAINMENT = 0.8
BROADCAST_SHINGLES = 200_000

#: Notices of common licenses.
TEMPLATES = NOTICES


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """(license_id, text) of the given notices."""
    return spark.createDataFrame(list(rows), "license_id string, text string")


def _shingled(rows: DataFrame) -> DataFrame:
    """Adds ``w`` (word hashes) and ``s`` (shingle hashes)."""
    hashed = rows.withColumn("w", F.transform(lower_words(F.col("text")), lambda x: F.xxhash64(x)))
    return hashed.withColumn("s", window_hashes(F.col("w"), SHINGLE))


def _window_keys(shingles: Column, stride: int, bands: int) -> Column:
    """Band keys (band number and smallest value) of the windows of a text's shingles."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(shingles) - (WINDOW - 1), F.lit(1)), F.lit(stride))

    def band(b: int) -> Column:
        permuted = F.transform(shingles, lambda h: F.xxhash64(F.lit(b), h))
        return let(permuted, lambda x: F.transform(starts, lambda i: F.xxhash64(F.lit(b), F.array_min(F.slice(x, i, WINDOW)))))

    keys = [band(b) for b in range(bands)]
    return F.when(F.size(shingles) >= WINDOW, F.concat(*keys)).otherwise(F.array().cast("array<bigint>"))


def find(docs: DataFrame, notices: DataFrame, containment: float = CONTAINMENT, bands: int = BANDS,
         broadcast_shingles: int = BROADCAST_SHINGLES) -> DataFrame:
    """(doc_id, text_hash, license_id, n_shingles, n_found) of every license that a text contains."""
    known = _shingled(notices.select(F.col("license_id").cast("string").alias("license_id"), F.col("text").cast("string").alias("text")))
    known = known.filter(F.size("w") > 0).select(
        "license_id", F.size("w").alias("n_w"), "s", "w",
        F.when(F.size("w") >= SHINGLE, F.array_distinct("s")).alias("t"))
    stats = known.agg(F.sum(F.size("w")).alias("n"),
                      F.sort_array(F.collect_set(F.when(F.col("n_w") < SHINGLE, F.col("n_w")))).alias("short")).first()
    fits = (stats["n"] or 0) <= broadcast_shingles
    short = list(stats["short"] or [])

    def whole(n: int) -> Column:
        """A template of fewer words than a shingle: its one window, apart from other lengths."""
        return F.transform(window_hashes(F.col("w"), n), lambda h: F.xxhash64(F.lit(n), h))

    one = F.col("t")
    for n in short:
        one = F.when(F.col("n_w") == n, whole(n)).otherwise(one)
    known = known.withColumn("t", one)
    keys = known.select("license_id", "t", F.explode(F.when(
        F.size("t") >= 2 * WINDOW, F.array_distinct(_window_keys(F.col("s"), 1, bands))).otherwise(F.col("t"))).alias("key"))

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    own = _shingled(rows).select("doc_id", "text_hash", "w", "s")
    singles = F.concat(F.col("s"), *[whole(n) for n in short]) if short else F.col("s")
    own = own.select("doc_id", "text_hash", singles.alias("u"), _window_keys(F.col("s"), STRIDE, bands).alias("k"))
    probes = own.select("doc_id", "text_hash", "u", F.explode(F.concat("u", "k")).alias("key"))
    if fits:
        met = probes.join(F.broadcast(keys), "key")
    else:
        # Without the texts' hashes: they come back for the retrieved pairs alone.
        met = probes.drop("u").join(keys, "key").join(own.drop("k"), ["doc_id", "text_hash"])
    pairs = met.groupBy("doc_id", "text_hash", "license_id").agg(F.first("t").alias("t"), F.first("u").alias("u"))
    return pairs.select("doc_id", "text_hash", "license_id", F.size("t").cast("long").alias("n_shingles"),
                        F.size(F.array_intersect("t", "u")).cast("long").alias("n_found")).filter(
        F.col("n_found") >= containment * F.col("n_shingles"))
