"""Registered queries: ``name -> fn(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or tables Spark derives from them) in
full: no id subsets, no row caps, whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonry.operators import serve
from canonry.plans import fixtures as fx

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def mention_standardizer(spark: SparkSession, sf_dir: str) -> serve.Standardizer:
    return serve.fit_standardizer(fx.train_mentions(spark, sf_dir), "mention", "entity_name")


@query
def standardize_mentions_char3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same contract with character 3-grams of the normalised mention as terms."""
    std = serve.fit_standardizer(fx.train_mentions(spark, sf_dir), "mention", "entity_name", kind="char_ngram", n=3)
    test = fx.test_mentions(spark, sf_dir).select("mention_id", "mention")
    return serve.standardize(test, std, "mention_id", "mention")


@query
def standardize_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: noisy test mentions -> canonical names (naive Bayes on word terms)."""
    std = mention_standardizer(spark, sf_dir)
    test = fx.test_mentions(spark, sf_dir).select("mention_id", "mention")
    return serve.standardize(test, std, "mention_id", "mention")


# ---------------------------------------------------------------- labels
from canonry.functions.arrays import replace_sentinel  # noqa: E402
from canonry.functions.text import explode_terms, normalize_text, strip_token  # noqa: E402
from canonry.operators import evaluate, inference, labels, ridge  # noqa: E402


def _vocab(spark, sf_dir):
    return labels.build_vocabulary(fx.train_mentions(spark, sf_dir), "entity_name")


@query
def vocabulary(spark, sf_dir):
    """Sorted distinct training names with dense 0-based ids."""
    return _vocab(spark, sf_dir)


@query
def vocab_size(spark, sf_dir):
    return labels.vocab_size(_vocab(spark, sf_dir))


@query
def class_set(spark, sf_dir):
    train = fx.mentions_with_ids(spark, sf_dir).where(F.col("split") == "train")
    return labels.class_set(train, "entity_id")


@query
def encode_labels(spark, sf_dir):
    test = fx.test_mentions(spark, sf_dir).select("mention_id", "entity_name")
    return labels.encode_labels(test, _vocab(spark, sf_dir), "entity_name", "label")


@query
def decode_labels(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    enc = labels.encode_labels(fx.test_mentions(spark, sf_dir).select("mention_id", "entity_name"),
                               vocab, "entity_name", "label")
    return labels.decode_labels(enc.select("mention_id", "label"), vocab, "label", "decoded")


@query
def uncovered_classes(spark, sf_dir):
    """Test classes missing from training when entity 0 is withheld from training."""
    m = fx.mentions_with_ids(spark, sf_dir)
    train = m.where((F.col("split") == "train") & (F.col("entity_id") != 0))
    return labels.uncovered_classes(m.where(F.col("split") == "test"), train, "entity_id")


@query
def classification_rows(spark, sf_dir):
    return labels.to_classification_rows(fx.mentions(spark, sf_dir), _vocab(spark, sf_dir))


@query
def seq_rows(spark, sf_dir):
    return labels.to_seq_rows(fx.mentions(spark, sf_dir))


# ---------------------------------------------------------------- text
@query
def normalize_documents(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", normalize_text("text").alias("norm_text"))


@query
def normalize_mask_digits(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", normalize_text("text", mask_digits=True).alias("norm_text"))


@query
def term_counts(spark, sf_dir):
    """Word terms of whole normalised documents: occurrences and document frequency."""
    occ = explode_terms(fx.table(spark, sf_dir, "documents"), ["doc_id"], "text", "word")
    per_doc = occ.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("k"))
    return per_doc.groupBy("term").agg(F.sum("k").alias("n_occ"), F.count(F.lit(1)).alias("n_docs"))


@query
def strip_markers(spark, sf_dir):
    """Remove a marker token ('.') from every document, then strip the ends."""
    return fx.table(spark, sf_dir, "documents").select("doc_id", strip_token("text", ".").alias("stripped"))


@query
def replace_sentinel_signs(spark, sf_dir):
    """Embedding signs as an integer array; the sentinel -1 becomes the pad value 0."""
    signs = F.transform("embedding", lambda x: F.signum(x).cast("int"))
    return fx.table(spark, sf_dir, "embeddings").select(
        "vec_id", replace_sentinel(signs, -1, 0).alias("tokens"))


@query
def lines_to_rows(spark, sf_dir):
    return serve.lines_to_rows(fx.table(spark, sf_dir, "documents"), "doc_id", "text")


# ---------------------------------------------------------------- serving
@query
def head_100(spark, sf_dir):
    """Smoke run: the first 100 test mentions by id, standardised."""
    std = mention_standardizer(spark, sf_dir)
    return serve.smoke(fx.test_mentions(spark, sf_dir).select("mention_id", "mention"), std,
                       "mention_id", "mention", 100)


@query
def batch_infer(spark, sf_dir):
    """User model in Arrow batches of 256 (test model: upper-case)."""
    m = fx.mentions(spark, sf_dir).select("mention_id", "mention")
    return inference.infer(m, "mention", inference.upper_model, batch_size=256, out="pred")


@query
def embed_custom(spark, sf_dir):
    """User encoder in batches of 64 (hashed char 3-grams, 64 dimensions)."""
    m = fx.mentions(spark, sf_dir).select("mention_id", "mention")
    return inference.embed(m, "mention", inference.hashed_ngram_encoder(64), batch_size=64)


# ---------------------------------------------------------------- sources
from canonry.session import cut_lineage, scratch_path  # noqa: E402
from canonry.sources import json_docs, tables  # noqa: E402


def _entities_file(spark, sf_dir):
    path = scratch_path(spark, "entities")
    json_docs.write_entities_lines(fx.entities(spark, sf_dir), path)
    return path


@query
def ingest_entities(spark, sf_dir):
    """Entities written as nested JSON Lines by Spark, read back flat."""
    ent = json_docs.read_entities(spark, _entities_file(spark, sf_dir), layout="lines")
    return ent.select("id", "name", "type_id", "type_name")


@query
def ingest_mentions(spark, sf_dir):
    """Training mentions grouped under entity keys (nested lists), exploded and resolved."""
    ent = json_docs.read_entities(spark, _entities_file(spark, sf_dir), layout="lines")
    path = scratch_path(spark, "train")
    train = fx.mentions_with_ids(spark, sf_dir).where(F.col("split") == "train")
    json_docs.write_mentions_lines(train.select("mention_id", "mention", "entity_id"), path, chunk=100)
    return json_docs.read_mentions(spark, path, ent, layout="lines")


@query
def ingest_test_mentions(spark, sf_dir):
    ent = json_docs.read_entities(spark, _entities_file(spark, sf_dir), layout="lines")
    path = scratch_path(spark, "infer")
    test = fx.mentions_with_ids(spark, sf_dir).where(F.col("split") == "test")
    json_docs.write_test_mentions_lines(test.select("mention_id", "mention", "entity_id"), path)
    return json_docs.read_test_mentions(spark, path, ent, layout="lines")


def _entities_document(spark, sf_dir):
    path = scratch_path(spark, "entities-document")
    json_docs.write_entities(fx.entities(spark, sf_dir), path, files=1)
    return json_docs.read_entities(spark, path)


@query
def ingest_entities_document(spark, sf_dir):
    """Entities as one JSON object keyed by id, read back flat."""
    return _entities_document(spark, sf_dir).select("id", "name", "type_id", "type_name")


@query
def ingest_mentions_document(spark, sf_dir):
    """Training mentions as one JSON object of keys with mention lists, exploded and resolved."""
    path = scratch_path(spark, "train-document")
    train = fx.mentions_with_ids(spark, sf_dir).where(F.col("split") == "train")
    json_docs.write_mentions(train.select("mention_id", "mention", "entity_id"), path, files=1)
    return json_docs.read_mentions(spark, path, _entities_document(spark, sf_dir))


@query
def ingest_test_mentions_document(spark, sf_dir):
    path = scratch_path(spark, "infer-document")
    test = fx.mentions_with_ids(spark, sf_dir).where(F.col("split") == "test")
    json_docs.write_test_mentions(test.select("mention_id", "mention", "entity_id"), path, files=1)
    return json_docs.read_test_mentions(spark, path, _entities_document(spark, sf_dir))


@query
def quarantine_unresolved(spark, sf_dir):
    """Mentions whose entity is missing from the entity table (all 'ring' entities removed)."""
    ent = fx.entities(spark, sf_dir).where(F.col("type_name") != "ring")
    m = fx.mentions_with_ids(spark, sf_dir).select("mention_id", "mention", "entity_id")
    _, quarantined = labels.resolve_entities(m, ent, on_missing="quarantine")
    return quarantined


DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query
def csv_roundtrip(spark, sf_dir):
    """Documents (quotes, newlines, blanks) through CSV with header and back."""
    path = scratch_path(spark, "documents-csv")
    tables.write_table_csv(fx.table(spark, sf_dir, "documents"), path)
    return tables.read_table_csv(spark, path, DOC_SCHEMA)


SPLITS_PER_FILE = 4


@query
def csv_roundtrip_split(spark, sf_dir):
    """The same through the reader that splits a file between records."""
    path = scratch_path(spark, "documents-csv-split")
    docs = fx.table(spark, sf_dir, "documents")
    # A file holds the rows of a few splits: one task writes it, and the reader still cuts it.
    tables.write_table_csv(docs.coalesce(-(-docs.rdd.getNumPartitions() // SPLITS_PER_FILE)), path)
    return tables.read_table_csv_split(spark, path, DOC_SCHEMA)


@query
def parquet_roundtrip(spark, sf_dir):
    """Documents through Parquet partitioned by language and back."""
    path = scratch_path(spark, "documents-parquet")
    tables.write_table(fx.table(spark, sf_dir, "documents"), path, partition_by="lang")
    return tables.read_table(spark, path, schema=DOC_SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")


# ---------------------------------------------------------------- metrics
from canonry.operators import metrics  # noqa: E402


def _binary(spark, sf_dir):
    """labels: quality as truth, toxic as prediction."""
    return fx.table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("p"))


@query
def confusion(spark, sf_dir):
    return metrics.confusion(_binary(spark, sf_dir))


@query
def classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(_binary(spark, sf_dir))


@query
def metrics_report(spark, sf_dir):
    return metrics.metrics_report(metrics.classification_metrics(_binary(spark, sf_dir)))


# ---------------------------------------------------------------- classification on documents
from canonry.operators import classify  # noqa: E402
from canonry.sources import models  # noqa: E402


def _lang_standardizer(spark, sf_dir) -> serve.Standardizer:
    train = fx.doc_split(spark, sf_dir, test=False)
    return serve.fit_standardizer(train, "text", "lang")


@query
def nb_train(spark, sf_dir):
    """Naive Bayes postings for documents -> language (word terms of whole texts)."""
    return _lang_standardizer(spark, sf_dir).model.postings.select("term", "label", "n_tc")


def _nb_predictions(spark, sf_dir, std=None):
    std = std or _lang_standardizer(spark, sf_dir)
    test = fx.doc_split(spark, sf_dir, test=True).select("doc_id", "text", "lang")
    pred = classify.predict_labels(std.model, test, "doc_id", "text")
    return std, labels.decode_labels(pred.select("doc_id", "label"), std.vocab, "label", "predicted")


@query
def nb_predict(spark, sf_dir):
    return _nb_predictions(spark, sf_dir)[1]


@query
def nb_evaluate(spark, sf_dir):
    std, pred = _nb_predictions(spark, sf_dir)
    truth = labels.encode_labels(fx.doc_split(spark, sf_dir, test=True).select("doc_id", "lang"),
                                 std.vocab, "lang", "y")
    pairs = truth.join(pred.select("doc_id", F.col("label").alias("p")), "doc_id")
    return metrics.classification_metrics(pairs, "y", "p")


@query
def nb_report(spark, sf_dir):
    """Evaluation report of the language model: rule line, then the four metrics."""
    return metrics.metrics_report(nb_evaluate(spark, sf_dir))


@query
def classifier_report(spark, sf_dir):
    """The language model evaluated in one call: lines of the report file it leaves."""
    path = scratch_path(spark, "nb-report")
    evaluate.evaluate_classifier(_lang_standardizer(spark, sf_dir), fx.doc_split(spark, sf_dir, test=True), "doc_id", "text", "lang", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def model_roundtrip(spark, sf_dir):
    """Save the language model, load it from its explicit path, predict: equals nb_predict."""
    path = scratch_path(spark, "nb-model")
    models.save_model(_lang_standardizer(spark, sf_dir), path)
    return _nb_predictions(spark, sf_dir, models.load_model(spark, path))[1]


@query
def lr_evaluate(spark, sf_dir):
    """spark.ml learner (hashed word TF-IDF + logistic regression) on documents -> language."""
    train = fx.doc_split(spark, sf_dir, test=False)
    vocab = labels.build_vocabulary(train, "lang")
    enc = lambda d: labels.encode_labels(d.select("doc_id", "text", "lang"), vocab, "lang", "label")
    model = classify.train_lr(enc(train), "text", "label")
    test = enc(fx.doc_split(spark, sf_dir, test=True))
    pred = classify.predict_lr(model, test, "doc_id").withColumnRenamed("label", "p")
    return metrics.classification_metrics(test.join(pred, "doc_id"), "label", "p")


RIDGE_DIM = 32  # small enough for the elimination in the oracle's SQL


def _ridge(spark, sf_dir):
    """Ridge classifier documents -> language, with its vocabulary."""
    train = fx.doc_split(spark, sf_dir, test=False).select("doc_id", "text", "lang")
    vocab = labels.build_vocabulary(train, "lang")
    return ridge.train_ridge(labels.encode_labels(train, vocab, "lang", "label"), "doc_id", dim=RIDGE_DIM), vocab


def _ridge_predictions(spark, sf_dir, model, vocab):
    test = fx.doc_split(spark, sf_dir, test=True).select("doc_id", "text", "lang")
    pred = ridge.predict_ridge(model, test, "doc_id", keep_cols=("lang",))
    return labels.decode_labels(pred.withColumn("score", F.round("score", 6)), vocab, "label", "predicted")


@query
def ridge_train(spark, sf_dir):
    """Ridge weights of every language and hashed entry (the constant is the last entry)."""
    weights = _ridge(spark, sf_dir)[0].weights
    return weights.select("label", F.posexplode("weights").alias("entry", "w")).select("label", "entry", F.round("w", 6).alias("weight"))


@query
def ridge_predict(spark, sf_dir):
    """Saved, loaded and applied to whole test documents."""
    model, vocab = _ridge(spark, sf_dir)
    path = scratch_path(spark, "ridge-model")
    models.save_ridge(model, path)
    pred = _ridge_predictions(spark, sf_dir, models.load_ridge(spark, path), vocab)
    return pred.select("doc_id", "label", "score", "predicted")


@query
def ridge_evaluate(spark, sf_dir):
    """Accuracy and weighted precision, recall and F1 of the ridge classifier."""
    model, vocab = _ridge(spark, sf_dir)
    pred = _ridge_predictions(spark, sf_dir, model, vocab).select("lang", F.col("label").alias("p"))
    return metrics.classification_metrics(labels.encode_labels(pred, vocab, "lang", "y"), "y", "p")


# ---------------------------------------------------------------- vectors
from canonry.operators import dense_cells, similarity as sim, sketch  # noqa: E402


def _emb_sides(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 5 == 0), e.where(F.col("vec_id") % 5 != 0)


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query
def cosine_consecutive(spark, sf_dir):
    """Cosine expression (no UDF) between each embedding and the next id: an equi-join, not all pairs."""
    from canonry.functions.vectors import cosine
    e = fx.table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next_embedding"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine("embedding", "next_embedding"), 6).alias("cosine"))


@query
def cosine_top1(spark, sf_dir):
    """Exact top-1 cosine neighbour (target side broadcast after a size check)."""
    q, t = _emb_sides(spark, sf_dir)
    return _rounded(sim.nearest(q, t, qid="vec_id", tid="vec_id", vec_col="embedding", method="auto"))


@query
def cosine_blocked(spark, sf_dir):
    """Same answer as cosine_top1 through the blocked plan (small blocks: many tasks)."""
    q, t = _emb_sides(spark, sf_dir)
    return _rounded(sim.nearest(q, t, qid="vec_id", tid="vec_id", vec_col="embedding",
                                method="blocked", block_rows=64))


@query
def cosine_top3_masked(spark, sf_dir):
    """Top-3 with masks: targets label < 5, queries label >= 5."""
    q, t = _emb_sides(spark, sf_dir)
    return _rounded(sim.top_k_similar(q, t, k=3, qid="vec_id", tid="vec_id", vec_col="embedding",
                                      query_filter=F.col("label") >= 5, target_filter=F.col("label") < 5))


@query
def cosine_top3_blocked(spark, sf_dir):
    """Top-3 with masks through the blocked plan."""
    q, t = _emb_sides(spark, sf_dir)
    return _rounded(sim.top_k_similar(q, t, k=3, qid="vec_id", tid="vec_id", vec_col="embedding",
                                      method="blocked", block_rows=48,
                                      query_filter=F.col("label") >= 5, target_filter=F.col("label") < 5))


@query
def nn_accuracy(spark, sf_dir):
    """Label transfer from the top-1 neighbour and its accuracy."""
    q, t = _emb_sides(spark, sf_dir)
    nb = sim.nearest(q, t, qid="vec_id", tid="vec_id", vec_col="embedding")
    pred = sim.transfer_labels(nb, t, "vec_id", "label", "p")
    pairs = pred.join(q.select(F.col("vec_id").alias("query_id"), F.col("label").alias("y")), "query_id")
    return metrics.accuracy(pairs, "y", "p")


def _tfidf_sides(spark, sf_dir):
    """Raw mentions (no normalisation on the neighbour path), char 3-grams, IDF fitted on train."""
    m = fx.mentions(spark, sf_dir)
    train, test = m.where(F.col("split") == "train"), m.where(F.col("split") == "test")
    ttf = sim.tfidf_terms(train, "mention_id", "mention", "char_ngram", 3, normalize=False, materialize=True)
    qtf = sim.tfidf_terms(test, "mention_id", "mention", "char_ngram", 3, normalize=False)
    idf = sim.tfidf_fit(ttf)
    return test, train, sim.tfidf_rows(qtf, idf, "mention_id"), sim.tfidf_rows(ttf, idf, "mention_id")


@query
def tfidf_nearest(spark, sf_dir):
    """TF-IDF char 3-gram nearest training mention per test mention, exact (blocked sparse)."""
    test, train, qv, tv = _tfidf_sides(spark, sf_dir)
    nb = sim.nearest(qv, tv, qid="mention_id", tid="mention_id", sparse=True, method="blocked")
    nb = sim.every_query(nb, test, train, "mention_id", "mention_id")
    return _rounded(sim.transfer_labels(nb, train, "mention_id", "entity_name", "predicted"))


@query
def tfidf_nearest_indexed(spark, sf_dir):
    """Same answer as tfidf_nearest through the inverted index."""
    test, train, qv, tv = _tfidf_sides(spark, sf_dir)
    nb = sim.nearest(qv, tv, qid="mention_id", tid="mention_id", sparse=True, method="index")
    nb = sim.every_query(nb, test, train, "mention_id", "mention_id")
    return _rounded(sim.transfer_labels(nb, train, "mention_id", "entity_name", "predicted"))


@query
def tfidf_documents_top3(spark, sf_dir):
    """Word TF-IDF of whole documents: the three nearest rows of every document whose id is divisible by 20."""
    tf = sim.tfidf_terms(fx.table(spark, sf_dir, "documents"), "doc_id", "text", "word", normalize=True, materialize=True)
    rows = sim.tfidf_rows(tf, sim.tfidf_fit(tf), "doc_id", numbered=True)
    return _rounded(sim.top_k_similar(rows, rows, k=3, qid="doc_id", tid="doc_id", query_filter=F.col("doc_id") % 20 == 0,
                                      sparse=True, method="index", materialize=False))


def _every_twentieth(spark, sf_dir):
    e = fx.table(spark, sf_dir, "embeddings")
    return e.where(F.col("vec_id") % 20 == 0), e


@query
def cosine_pruned(spark, sf_dir):
    """Same answer as cosine_top1 over cells: a cell is skipped where its ball bound rules it out."""
    q, t = _emb_sides(spark, sf_dir)
    return _rounded(sim.nearest(q, t, qid="vec_id", tid="vec_id", vec_col="embedding", method="cells"))


@query
def cells_top3(spark, sf_dir):
    """Inverted file over all embeddings, exact: every id divisible by 20 against all rows."""
    q, t = _every_twentieth(spark, sf_dir)
    return _rounded(sim.top_k_similar(q, t, k=3, qid="vec_id", tid="vec_id", vec_col="embedding", method="cells"))


@query
def cells_recall(spark, sf_dir):
    """Probes alone against the exact answer: is the measured recall 0.9 or more?"""
    q, t = _every_twentieth(spark, sf_dir)
    report = dense_cells.search_report(q, t, 3, "vec_id", "vec_id", "embedding")
    return report.select(F.col("n_queries").cast("long").alias("n_queries"), (F.col("recall") >= 0.9).alias("recall_reached"))


@query
def nn_standardize(spark, sf_dir):
    """Nearest-neighbour standardisation accuracy (labels from training neighbours)."""
    test, train, qv, tv = _tfidf_sides(spark, sf_dir)
    nb = sim.nearest(qv, tv, qid="mention_id", tid="mention_id", sparse=True)
    nb = sim.every_query(nb, test, train, "mention_id", "mention_id")
    pred = sim.transfer_labels(nb, train, "mention_id", "entity_name", "p")
    pairs = test.select(F.col("mention_id").alias("query_id"), F.col("entity_name").alias("y")) \
        .join(pred, "query_id", "left")
    return metrics.accuracy(pairs, "y", "p")


@query
def sketch_entries(spark, sf_dir):
    """Native encoder: signed count sketch of the mentions' character 3-grams, non-zero entries."""
    m = fx.mentions(spark, sf_dir)
    return sketch.sketch_entries(m, "mention_id", "mention").withColumn("weight", F.round("weight", 9))


@query
def sketch_nearest(spark, sf_dir):
    """Nearest training mention of each test mention by sketch, over cells, with its label."""
    m = fx.mentions(spark, sf_dir)
    train, test = m.where(F.col("split") == "train"), m.where(F.col("split") == "test")
    q, t = (sketch.sketch_vectors(d, "mention_id", "mention") for d in (test, train))
    nb = sim.nearest(q, t, qid="mention_id", tid="mention_id", method="cells")
    return _rounded(sim.transfer_labels(nb, train, "mention_id", "entity_name", "predicted"))


@query
def tfidf_vectors(spark, sf_dir):
    """Built-in embedding as long rows: (mention_id, term, weight) for all mentions."""
    m = fx.mentions(spark, sf_dir)
    return sim.tfidf_vectors(m, "mention_id", "mention").withColumn("weight", F.round("weight", 9))


# ---------------------------------------------------------------- generation and BLEU
from canonry.operators import bleu, translate  # noqa: E402
from canonry.streaming import scoring  # noqa: E402


def _turn_pairs(spark, sf_dir):
    """conversations: turn t is the hypothesis, turn t + 1 of the same conversation the reference."""
    c = fx.table(spark, sf_dir, "conversations")
    h = c.select("conv_id", "turn", F.col("text").alias("hypothesis"))
    r = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reference"))
    return h.join(r, ["conv_id", "turn"])


@query
def corpus_bleu(spark, sf_dir):
    return bleu.corpus_bleu(_turn_pairs(spark, sf_dir), "hypothesis", "reference", ["conv_id", "turn"], 4, "none")


@query
def corpus_bleu_13a(spark, sf_dir):
    return bleu.corpus_bleu(_turn_pairs(spark, sf_dir), "hypothesis", "reference", ["conv_id", "turn"], 4, "13a")


def _translation(spark, sf_dir):
    train = fx.train_mentions(spark, sf_dir)
    return translate.train_translation(train, "mention_id", "mention", "entity_name", iterations=5)


@query
def translate_table(spark, sf_dir):
    """IBM Model 1 t(t|s) after 5 EM iterations on the training mentions."""
    return _translation(spark, sf_dir).withColumn("p", F.round("p", 6))


def _generated(spark, sf_dir):
    test = fx.test_mentions(spark, sf_dir).select("mention_id", "mention", "entity_name")
    return translate.generate_names(_translation(spark, sf_dir), test, "mention_id", "mention")


@query
def generate_names(spark, sf_dir):
    return _generated(spark, sf_dir).select("mention_id", "mention", "generated")


@query
def generation_report(spark, sf_dir):
    """Generated names evaluated in one call: the line of the report file it leaves."""
    path = scratch_path(spark, "generation-report")
    evaluate.evaluate_generation(_generated(spark, sf_dir), "entity_name", "generated", path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query
def generation_exact_match(spark, sf_dir):
    return metrics.exact_match(_generated(spark, sf_dir), "entity_name", "generated")


# ---------------------------------------------------------------- serving and streaming
@query
def map_lines(spark, sf_dir):
    """Document blobs -> from/to table of standardised lines."""
    std = mention_standardizer(spark, sf_dir)
    return serve.map_lines(fx.table(spark, sf_dir, "documents"), std, "doc_id", "text")


@query
def request_response(spark, sf_dir):
    """Test mentions as JSON requests of <= 100 ids each, parsed, scored, answered as JSON."""
    std = mention_standardizer(spark, sf_dir)
    test = fx.test_mentions(spark, sf_dir).withColumn("request_id", F.expr("mention_id div 100"))
    bodies = serve.to_request(test, "request_id", "mention_id", "mention")
    rows = serve.from_request(bodies).withColumn("_key", F.struct("request_id", "pos"))
    scored = serve.standardize(rows, std, "_key", "text")
    return serve.to_response(scored, "request_id", "pos", "predicted")


@query
def standardize_stream(spark, sf_dir):
    """documents.parquet read as a stream (availableNow), scored per micro-batch: equals batch."""
    std = _lang_standardizer(spark, sf_dir)
    schema = fx.table(spark, sf_dir, "documents").schema
    # As a pattern the path may be one file or a folder of files; a plain one must be a folder.
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{sf_dir.rstrip('/')}/documents.parque[t]"))
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = scoring.standardize_stream(stream, std, "doc_id", "text", sink, ckpt)
    q.awaitTermination()
    return scoring.read_sink(spark, sink)
