"""Model queries: train + evaluate, batch scoring, probabilities, save/load round trip,
window accuracy, data summary, and the built-in text encoder with its drift."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vigil.operators.sampling import exact_split, latest
from vigil.plans import training
from vigil.plans.catalog import register, rounded
from vigil.plans.summary import data_summary
from vigil.session import ensure_checkpoint_dir, scratch_path
from vigil.sources import tables

SEED = 42
WINDOW = 200
_FITTED: dict[tuple, tuple] = {}


def split_corpus(spark: SparkSession, sf_dir: str):
    """Documents with the learnable label, split 80/20 exactly (seeded)."""
    return exact_split(tables.lang_reviews(spark, sf_dir), "review_id", 0.2, SEED)


def fitted(spark: SparkSession, sf_dir: str):
    """Fit once per (application, table folder); return (split, FittedModel)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FITTED:
        ensure_checkpoint_dir(spark)
        split = split_corpus(spark, sf_dir).checkpoint(eager=True)  # reliable: cuts lineage
        model = training.fit(split.filter(F.col("split") == "train"))
        _FITTED[key] = (split, model)
    return _FITTED[key]


def _scored(spark, sf_dir, part: str):
    """Label and scores of one side of the split; the texts are not kept again."""
    split, fm = fitted(spark, sf_dir)
    return training.score(fm.model, split.filter(F.col("split") == part)).select("sentiment", "prediction", "p1").checkpoint(eager=True)


@register("train_eval")
def q_train_eval(spark, sf_dir):
    """Test metrics and, beside them, the same metrics on the training split."""
    _, fm = fitted(spark, sf_dir)
    test, train = _scored(spark, sf_dir, "test"), _scored(spark, sf_dir, "train")
    m = training.evaluate(test).crossJoin(training.evaluate(train, prefix="train_"))
    return rounded(
        m.withColumn("n_train", F.lit(fm.n_train).cast("long")).withColumn("vocab_size", F.lit(fm.vocab_size).cast("long"))
    )


@register("run_log")
def q_run_log(spark, sf_dir):
    """The run row of the fitted model: name, tags, parameters, input schema and example."""
    from vigil.plans import lineage

    split, fm = fitted(spark, sf_dir)
    train = split.filter(F.col("split") == "train")
    return lineage.run_record(spark, f"run-{spark.sparkContext.applicationId}", 1, fm.params, train)


@register("batch_score")
def q_batch_score(spark, sf_dir):
    _, fm = fitted(spark, sf_dir)
    docs = tables.lang_reviews(spark, sf_dir)
    return rounded(
        training.score(fm.model, docs).select("review_id", "sentiment", "prediction", "prediction_label", "p1")
    )


@register("probability_map")
def q_probability_map(spark, sf_dir):
    _, fm = fitted(spark, sf_dir)
    docs = tables.lang_reviews(spark, sf_dir).select("review_id", "review")
    return training.probabilities(fm.model, docs).select("review_id", "probabilities")


@register("model_roundtrip")
def q_model_roundtrip(spark, sf_dir):
    _, fm = fitted(spark, sf_dir)
    path = scratch_path(spark, "model")
    fm.model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    docs = tables.lang_reviews(spark, sf_dir).select("review_id", "review")
    a = training.score(fm.model, docs).select("review_id", F.col("prediction").alias("a"), F.col("p1").alias("pa"))
    b = training.score(loaded, docs).select("review_id", F.col("prediction").alias("b"), F.col("p1").alias("pb"))
    return a.join(b, "review_id").select(
        "review_id", ((F.col("a") == F.col("b")) & (F.abs(F.col("pa") - F.col("pb")) < 1e-12)).alias("same")
    )


@register("window_accuracy")
def q_window_accuracy(spark, sf_dir):
    """Accuracy of the model on the latest window of labelled rows (arrival = doc id)."""
    from vigil.operators.evaluation import accuracy

    _, fm = fitted(spark, sf_dir)
    docs = tables.lang_reviews(spark, sf_dir).withColumn("ts", F.lit(None).cast("timestamp"))
    w = latest(docs, "ts", "review_id", WINDOW)
    scored = training.score(fm.model, w)
    return rounded(accuracy(scored, "sentiment", "prediction"))


@register("data_summary")
def q_data_summary(spark, sf_dir):
    test = _scored(spark, sf_dir, "test")
    split, _ = fitted(spark, sf_dir)
    perf = training.evaluate(test).select(
        "test_accuracy", "test_precision", "test_recall", "test_f1_score", "test_roc_auc", "test_log_loss"
    )
    return data_summary(split, rounded(perf), source="documents")


@register("hash_embed")
def q_hash_embed(spark, sf_dir):
    from vigil.functions.encoders import hashed_embedding

    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return hashed_embedding(docs, "text", "embedding").select("doc_id", "embedding")


@register("text_drift")
def q_text_drift(spark, sf_dir):
    """Drift between English documents (reference) and the rest, on built-in embeddings."""
    from vigil.functions.encoders import hashed_embedding
    from vigil.operators.cumulative import settled
    from vigil.operators.drift import embedding_drift

    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    emb = hashed_embedding(docs, "text", "embedding").withColumn(
        "grp", F.when(F.col("lang") == "en", "ref").otherwise("new")
    )
    return rounded(embedding_drift(settled(emb.select("embedding", "grp"))))  # texts are cleaned and hashed once
