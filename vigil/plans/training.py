"""Training, scoring and evaluating the TF-IDF + logistic-regression text classifier in MLlib.

Stages (all JVM-native, so the fitted model saves and loads without trusting user code):
  SQLTransformer   clean text and extract tokens (the cleaner as Spark SQL text)
  StopWordsRemover English stop words (Spark's list; a parameter)
  NGram x 2        bigrams and trigrams
  SQLTransformer   terms = unigrams ++ bigrams ++ trigrams
  CountVectorizerModel  fixed vocabulary: top ``max_features`` terms by corpus frequency
  ElementwiseProduct    idf = ln((1 + n) / (1 + df)) + 1 per vocabulary term
  Normalizer(p=2)
  LogisticRegression    L-BFGS, L2 with C = 1 => regParam = 1 / (C * n), no standardisation

The vocabulary and document frequencies come from distributed aggregates
(`vigil.operators.terms`); only the top ``max_features`` terms (a bounded list) reach the
driver to build the fixed-vocabulary stage.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import NGram, SQLTransformer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import TOKEN_PATTERN, default_stop_words, tokens_sql
from vigil.operators import evaluation as ev
from vigil.operators.terms import MAX_FEATURES, in_parts, stored_words, vector_stages, vocabulary_of
from vigil.session import scratch_path

# Fixed hyper-parameters of the classifier being matched.
MAX_ITER = 1000
C = 1.0
# What one task of an optimiser step reads, and the fan-in of its tree aggregation.
PARTITION_BYTES = 32 << 20
WORD_STAGES = 2  # the stages of the text front up to the words
FAN_IN = 32


def text_stages(text_col: str = "review", preprocess_sql: str | None = None) -> list:
    """The fit-free front of the pipeline: text -> terms (ARRAY<STRING>).

    ``preprocess_sql`` plugs a user text function in place of the default cleaner: a Spark
    SQL expression over ``{col}`` (e.g. ``"lower({col})"``). Being SQL text, it is saved
    with the model and needs no trusted code on load."""
    col = f"coalesce({text_col}, '')"  # a null text scores as an empty one
    if preprocess_sql is None:
        toks = tokens_sql(col)
    else:
        toks = f"regexp_extract_all({preprocess_sql.format(col=col)}, r'{TOKEN_PATTERN}', 0)"
    return [
        SQLTransformer(statement=f"SELECT *, {toks} AS __tokens FROM __THIS__"),
        StopWordsRemover(inputCol="__tokens", outputCol="__words", stopWords=list(default_stop_words())),
        NGram(n=2, inputCol="__words", outputCol="__bigrams"),
        NGram(n=3, inputCol="__words", outputCol="__trigrams"),
        SQLTransformer(statement="SELECT *, concat(__words, __bigrams, __trigrams) AS __terms FROM __THIS__"),
    ]


@dataclass
class FittedModel:
    model: PipelineModel
    n_train: int
    vocab_size: int
    params: dict


def partitions_for(feature_bytes: int) -> int:
    """Tasks of one optimiser step, by the bytes of the features."""
    return max(1, math.ceil(feature_bytes / PARTITION_BYTES))


def aggregation_depth(partitions: int) -> int:
    """Levels of the tree that sums the tasks' gradients: no node takes more than FAN_IN of them."""
    return max(2, math.ceil(math.log(partitions, FAN_IN)))


def fit(train: DataFrame, text_col: str = "review", label_col: str = "sentiment",
        max_features: int = MAX_FEATURES, max_iter: int = MAX_ITER, c: float = C,
        preprocess_sql: str | None = None) -> FittedModel:
    """Fit the pipeline on ``train`` in two steps (vocabulary first, then the classifier).

    The vocabulary is counted over the words of the texts, stored in the shared folder; n-grams,
    six times the text, are only made within a row. The features are made from the rows as they lie, so that
    a fit over the same partitions sums in the same order. Rows with a null or blank text (or a null label)
    are left out of the fit; their number is reported in ``params['dropped_rows']``."""
    front_stages = text_stages(text_col, preprocess_sql)
    usable = F.col(text_col).isNotNull() & (F.trim(F.col(text_col)) != "") & F.col(label_col).isNotNull()
    counted = train.agg(F.count(F.lit(1)).alias("all"), F.count_if(usable).alias("ok")).first()  # one row
    dropped, n = int(counted["all"] - counted["ok"]), counted["ok"]
    if n == 0:
        raise ValueError("no training rows")
    rows = train.filter(usable).select(text_col, F.col(label_col).cast("double").alias("__label"))
    words = stored_words(PipelineModel(stages=front_stages[:WORD_STAGES]).transform(in_parts(rows, text_col)), "__words")
    vocab = vocabulary_of(words, max_features)
    back_stages = vector_stages(vocab, n, "__terms", "features")
    stages = front_stages + back_stages
    # a term takes at most an index and a value of the sparse vector: 12 bytes
    length = F.size("__toks").cast("long")
    held = F.greatest(length, F.lit(0)) + F.greatest(length - 1, F.lit(0)) + F.greatest(length - 2, F.lit(0))
    # Every L-BFGS iteration is a job over the features: they are dealt evenly, by their bytes, over all
    # cores; MLlib packs a task's rows into blocks, and gradients are summed in a tree.
    parts = partitions_for(words.agg(F.sum(held * 12 + 24)).first()[0])  # one row
    lr = LogisticRegression(
        featuresCol="features",
        labelCol="__label",
        maxIter=max_iter,
        regParam=1.0 / (c * n),
        elasticNetParam=0.0,
        standardization=False,
        fitIntercept=True,
        aggregationDepth=aggregation_depth(parts),
        maxBlockSizeInMB=1.0,
    )
    # MLlib reads the vectors a few times, to cache them as blocks of its own, which its iterations read. Here they
    # are cached on disk, in parts that PARTITION_BYTES bounds: in memory they would lie there twice.
    vectors = PipelineModel(stages=stages).transform(rows).select("features", "__label")
    feats = vectors.repartition(parts).persist(StorageLevel.DISK_ONLY)
    feats.count()
    lr_model = lr.fit(feats)
    iterations = lr_model.summary.totalIterations
    feats.unpersist()
    params = {
        "max_features": str(max_features), "max_iter": str(max_iter), "C": str(c),
        "regParam": str(1.0 / (c * n)), "ngram_range": "(1, 3)", "solver": "lbfgs",
        "vocab_size": str(len(vocab)), "partitions": str(parts), "iterations": str(iterations),
        "dropped_rows": str(dropped),
    }
    return FittedModel(PipelineModel(stages=stages + [_without_summary(lr_model, train.sparkSession)]), n, len(vocab), params)


def _without_summary(model: LogisticRegressionModel, spark) -> LogisticRegressionModel:
    """The model saved and loaded. As fitted it carries a training summary, which holds the session; a task takes
    the model along, and a session in which a stream or an observation ran cannot be sent."""
    path = scratch_path(spark, "classifier")
    model.write().save(path)
    return LogisticRegressionModel.load(path)


def score(model: PipelineModel, df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Input columns plus prediction (INT), its class name and p1 (probability of class 1)."""
    names = names or ev.CLASS_NAMES
    out = model.transform(df)
    keep = [c for c in df.columns]
    pred = F.col("prediction").cast("int")
    return out.select(
        *keep,
        pred.alias("prediction"),
        F.try_element_at(F.array(*[F.lit(n) for n in names]), pred + 1).alias("prediction_label"),
        vector_to_array("probability")[1].alias("p1"),
    )


def probabilities(model: PipelineModel, df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Input columns plus a label-name -> probability map."""
    names = names or ev.CLASS_NAMES
    out = model.transform(df)
    probs = vector_to_array("probability")
    kv = []
    for i, nm in enumerate(names):
        kv += [F.lit(nm), probs[i]]
    return out.select(*df.columns, F.create_map(*kv).alias("probabilities"))


def evaluate(scored: DataFrame, label_col: str = "sentiment", prefix: str = "test_") -> DataFrame:
    """One row: {prefix}accuracy, precision, recall, f1_score (macro), roc_auc, log_loss."""
    s = scored.select(F.col(label_col).alias("y"), F.col("prediction").alias("yhat"), "p1")
    acc = ev.accuracy(s).select(F.col("accuracy").alias(f"{prefix}accuracy"))
    prf = ev.macro_prf(s).select(
        F.col("precision_macro").alias(f"{prefix}precision"),
        F.col("recall_macro").alias(f"{prefix}recall"),
        F.col("f1_macro").alias(f"{prefix}f1_score"),
    )
    auc = ev.roc_auc(s).select(F.col("roc_auc").alias(f"{prefix}roc_auc"))
    ll = ev.log_loss(s).select(F.col("log_loss").alias(f"{prefix}log_loss"))
    return acc.crossJoin(prf).crossJoin(auc).crossJoin(ll)
