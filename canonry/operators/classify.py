"""Closed-set classification as Spark aggregations.

Multinomial naive Bayes (CLS1/CLS3) is three aggregations to train and one term
join plus two grouped aggregations to predict. For a row with ``L`` known term
occurrences the score of class ``c`` is

    ln(N_c / N) - L * (ln(n_c + alpha*V) - ln(alpha)) + sum_t k_t * (ln(n_tc + alpha) - ln(alpha))

The last sum runs only over postings with ``n_tc > 0`` (the join). A class that
shares no term with the row keeps its first two addends, which depend only on
``(c, L)``: a line over ``L``. The best such class is read off the upper envelope of
all classes' lines by each row's ``L``, so the argmax is exact without
pairing rows or lengths with classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canonry.functions.text import explode_terms
from canonry.operators.ranking import RANK_DECIMALS, rank_key
from canonry.operators.sizing import DEFAULT_BROADCAST_ROWS, bounded_broadcast, broadcast_if, note_rows
from canonry.session import cut_lineage

# Pseudo label of the per-term counter row used to count known occurrences.
_COUNTER = -2
# Tasks of an iteration of the logistic regression, per core, at most.
TASKS_PER_CORE = 4


@dataclass
class NBModel:
    classes: DataFrame    # label, n_rows, n_terms, prior, per_len
    postings: DataFrame   # term, label, n_tc, weight
    scoring: DataFrame    # term, lw: array<struct<label, weight>> incl. a counter entry (-2, 1.0)
    n_rows: int
    n_vocab: int
    alpha: float
    kind: str
    n: int
    normalize: bool
    envelope: dict | None = None  # found at the first prediction


def train_classifier(df: DataFrame, text_col: str = "text", label_col: str = "label",
                     kind: str = "word", n: int = 3, alpha: float = 1.0,
                     normalize: bool = True) -> NBModel:
    """Train multinomial naive Bayes from ``(text, label)`` rows (label >= 0)."""
    rows = df.select(F.col(label_col).alias("label"), F.col(text_col).alias("_text")) \
             .where(F.col("label").isNotNull() & (F.col("label") >= 0))
    terms = explode_terms(rows, ["label"], "_text", kind, n, normalize)
    counts = terms.groupBy("term", "label").agg(F.count(F.lit(1)).alias("n_tc"))
    la = F.log(F.lit(float(alpha)))
    # The scoring table (one row per term) is the one written copy of the term counts:
    # size checks, the class totals and every later prediction read it instead of
    # re-running the tokenising aggregation.
    scoring = scoring_table(counts.withColumn("weight", F.log(F.col("n_tc") + F.lit(float(alpha))) - la))
    postings = (scoring.select("term", F.explode("lw").alias("e")).where(F.col("e.label") != _COUNTER)
                .select("term", F.col("e.label").alias("label"), F.col("e.n_tc").alias("n_tc"),
                        F.col("e.weight").alias("weight")))
    per_class = cut_lineage(
        rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
        .join(postings.groupBy("label").agg(F.sum("n_tc").alias("n_terms")), "label", "left")
        .withColumn("n_terms", F.coalesce("n_terms", F.lit(0)).cast("long")), name="nb-classes")
    totals = per_class.agg(F.sum("n_rows"), F.count(F.lit(1))).first()
    n_rows, n_classes = int(totals[0] or 0), int(totals[1])
    n_vocab = scoring.count()
    note_rows(scoring, n_vocab)
    classes = note_rows(per_class
                        .withColumn("prior", F.log(F.col("n_rows") / F.lit(float(n_rows))))
                        .withColumn("per_len", F.log(F.col("n_terms") + F.lit(float(alpha) * n_vocab)) - la),
                        n_classes)
    return NBModel(classes, postings, scoring, int(n_rows), int(n_vocab), float(alpha),
                   kind, n, normalize)


def scoring_table(postings: DataFrame) -> DataFrame:
    """One row per term: its (label, weight, n_tc) entries plus a counter entry, written once.

    A prediction joins each known term occurrence to exactly one row here; the
    counter entry sums to L, the row's number of known occurrences. A term's list
    holds at most one entry per class.
    """
    entry = F.struct(F.col("label").cast("long").alias("label"), F.col("weight").cast("double").alias("weight"),
                     F.col("n_tc").cast("long").alias("n_tc"))
    counter = F.struct(F.lit(_COUNTER).cast("long").alias("label"), F.lit(1.0).alias("weight"),
                       F.lit(0).cast("long").alias("n_tc"))
    per_term = postings.groupBy("term").agg(F.collect_list(entry).alias("lw"))
    return cut_lineage(per_term.select("term", F.concat("lw", F.array(counter)).alias("lw")), name="nb-scoring")


def _hull(lines: pd.DataFrame) -> pd.DataFrame:
    """The lines ``prior - L * per_len`` that are highest for some L >= 0, by falling ``per_len``; equal lines: the smallest label."""
    best = lines.sort_values(["per_len", "prior", "label"], ascending=[False, False, True]).drop_duplicates("per_len")
    kept: list[tuple[float, float, int]] = []  # per_len, prior, label
    for line in zip(best["per_len"], best["prior"], best["label"]):
        # The last line is nowhere highest if the new one is above it before it passes the one before.
        while kept and (line[1] > kept[-1][1] or len(kept) > 1 and _crossing(kept[-2], line) <= _crossing(kept[-2], kept[-1])):
            kept.pop()
        kept.append(line)
    return pd.DataFrame([(label, prior, per) for per, prior, label in kept], columns=["label", "prior", "per_len"])


def _crossing(steep: tuple, flat: tuple) -> float:
    """The L from which ``flat`` is above ``steep`` (lines as in ``_hull``)."""
    return (steep[1] - flat[1]) / (steep[0] - flat[0])


def _envelope(model: NBModel) -> dict:
    """The upper envelope of all classes' scores without a shared term, and the best class at L = 0.

    Each partition of the classes gives its own envelope, one task joins these; what comes back are the
    classes that are best for some L, a handful (about the logarithm of their number). Found once per model.
    """
    if model.envelope is None:
        def run(frames):
            kept = None
            for f in frames:
                kept = _hull(f if kept is None else pd.concat([kept, f], ignore_index=True))
            if kept is not None:
                yield kept

        schema = "label long, prior double, per_len double"
        lines = model.classes.select(F.col("label").cast("long").alias("label"), "prior", "per_len")
        hull = sorted(lines.mapInPandas(run, schema).coalesce(1).mapInPandas(run, schema).collect(), key=lambda r: -r["per_len"])
        first = model.classes.agg(F.min_by(F.struct(F.col("label").cast("long").alias("label"), "prior"),
                                           F.struct((-rank_key("prior")).alias("s"), F.col("label").alias("t"))).alias("b")).first()["b"]
        model.envelope = {"lines": [(r["label"], r["prior"], r["per_len"]) for r in hull], "first": first}
    return model.envelope


def _default_at(model: NBModel, known: Column) -> Column:
    """(s, label, score) of the best class sharing no term, for ``known`` known occurrences (long)."""
    found = _envelope(model)
    lines = found["lines"]
    if not lines:
        return F.lit(None).cast("struct<s:double,label:bigint,score:double>")
    as_line = lambda x: (x[2], x[1], x[0])
    turns = [_crossing(as_line(a), as_line(b)) for a, b in zip(lines, lines[1:])]
    at = F.size(F.filter(F.lit(turns).cast("array<double>"), lambda t: t <= known))
    labels, priors, pers = (F.lit(list(c)) for c in zip(*lines))
    # The neighbours as well: at a turn both lines may agree to 9 decimals.
    near = F.sequence(F.greatest(at - 1, F.lit(0)), F.least(at + 1, F.lit(len(lines) - 1)))

    def scored(i: Column) -> Column:
        score = F.get(priors, i) - known * F.get(pers, i)
        return F.struct((-rank_key(score)).alias("s"), F.get(labels, i).cast("long").alias("label"), score.alias("score"))

    first = found["first"]
    at_zero = F.struct(F.lit(-round(first["prior"], RANK_DECIMALS)).alias("s"), F.lit(first["label"]).cast("long").alias("label"),
                       F.lit(first["prior"]).alias("score"))
    return F.when(known == 0, at_zero).otherwise(F.array_min(F.transform(near, scored)))


def predict_labels(model: NBModel, df: DataFrame, id_col: str, text_col: str,
                   max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS, keep_cols=()) -> DataFrame:
    """``(id, text)`` -> ``(id, *keep_cols, label, score)``, one output row per input row.

    ``keep_cols`` ride along the final left join, so callers need no second join
    (and no second shuffle) to put predictions back on their rows.

    Exact argmax; tie -> smallest label. Model tables are broadcast only under a
    proven row bound, otherwise joined by shuffle (AQE splits hot terms). Ids need not be unique or known:
    rows are told apart by id and text, and rows with both equal get the same answer.
    """
    text = F.col(text_col).cast("string")
    keys = [F.col(id_col).alias("_id"), F.xxhash64(text).alias("_h1"), F.xxhash64(text, F.lit(1)).alias("_h2")]
    by = ["_id", "_h1", "_h2"]
    occ = explode_terms(df.select(*keys, text.alias("_text")), by, "_text", model.kind, model.n, model.normalize)
    table = bounded_broadcast(model.scoring, max_broadcast_rows)
    cand = (occ.join(table, "term").select(*by, F.explode("lw").alias("e"))
            .groupBy(*by, F.col("e.label").alias("label")).agg(F.sum("e.weight").alias("inc")))
    # A row that is there several times has its terms that often.
    copies = df.select(*keys).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    same = lambda a, b: (a["_h1"] == b["_h1"]) & (a["_h2"] == b["_h2"]) & a["_id"].eqNullSafe(b["_id"])
    many = copies.select(*[F.col(c).alias(f"c{c}") for c in by], "_n")
    cand = cand.join(many, (F.col("_h1") == F.col("c_h1")) & (F.col("_h2") == F.col("c_h2"))
                     & F.col("_id").eqNullSafe(F.col("c_id")), "left")
    cand = cand.select(*by, "label", (F.col("inc") / F.coalesce("_n", F.lit(1))).alias("inc"))
    per_row = Window.partitionBy(*by)
    cand = (cand.withColumn("L", F.max(F.when(F.col("label") == _COUNTER, F.col("inc"))).over(per_row))
            .where(F.col("label") != _COUNTER))
    classes = broadcast_if(model.classes.select(F.col("label").cast("long"), "prior", "per_len"),
                           model.classes, max_broadcast_rows)
    cand = cand.join(classes, "label").withColumn(
        "score", F.col("prior") - F.col("L") * F.col("per_len") + F.col("inc"))
    best = F.max_by(F.struct(F.col("label"), F.col("score")), F.struct(rank_key("score"), -F.col("label")))
    matched = cand.groupBy(*by).agg(best.alias("m"), F.max("L").alias("L"))
    keep = [c for c in keep_cols if c != id_col]
    rows, found = df.select(*keys, *keep).alias("rows"), matched.alias("found")
    joined = rows.join(found, same({c: F.col(f"rows.{c}") for c in by}, {c: F.col(f"found.{c}") for c in by}), "left")
    known = F.coalesce(F.round("L").cast("long"), F.lit(0).cast("long"))
    out = joined.select(F.col("rows._id").alias(id_col), *[F.col(f"rows.{c}") for c in keep], F.col("m"),
                        _default_at(model, known).alias("d"))
    take_default = F.col("m").isNull() | (-F.col("d.s") > rank_key("m.score")) | (
        (-F.col("d.s") == rank_key("m.score")) & (F.col("d.label") < F.col("m.label")))
    return out.select(
        id_col, *keep, F.when(take_default, F.col("d.label")).otherwise(F.col("m.label")).alias("label"),
        F.when(take_default, F.col("d.score")).otherwise(F.col("m.score")).alias("score"))


def train_lr(df: DataFrame, text_col: str = "text", label_col: str = "label",
             num_features: int = 1 << 18, max_iter: int = 20):
    """Alternative learner on spark.ml: words -> hashed TF -> IDF -> logistic regression.

    Texts are tokenised once: the hashed counts are written, and the IDF and the iterations read them, in a few tasks a
    core, since each task of an iteration sends a gradient of all classes and features.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    words = RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)[\s\x1c-\x1f]+", toLowercase=True)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features)
    train = df.where(F.col(label_col) >= 0).withColumn(label_col, F.col(label_col).cast("double"))
    hashed = cut_lineage(counts.transform(words.transform(train)).select(label_col, "_tf"), name="lr-counts")
    hashed = hashed.coalesce(TASKS_PER_CORE * hashed.sparkSession.sparkContext.defaultParallelism)
    idf = IDF(inputCol="_tf", outputCol="_features").fit(hashed)
    lr = LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=max_iter, predictionCol="prediction")
    return PipelineModel(stages=[words, counts, idf, lr.fit(idf.transform(hashed))])


def predict_lr(model, df: DataFrame, id_col: str) -> DataFrame:
    return model.transform(df).select(id_col, F.col("prediction").cast("long").alias("label"))
