"""TF-IDF inside the row and the fit's distribution."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from vigil.operators import terms
from vigil.plans import training
from vigil.sources import tables


def test_rows_that_share_an_id_or_have_none_get_their_own_norm(spark):
    rows = [(1, "apple banana apple cherry"), (1, "banana banana cherry walnut"), (None, "apple walnut"), (None, "walnut cherry"), (2, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary, n = terms.fit_vocabulary(docs, max_features=6)
    assert n == 6 and len(vocabulary) == 6
    weights = {r["term"]: math.log(7 / (1 + r["df"])) + 1 for r in vocabulary}
    expected = []
    for doc_id, text in rows:
        words = (text or "").split()
        grams = words + [" ".join(words[i:i + k]) for k in (2, 3) for i in range(len(words) - k + 1)]
        raw = defaultdict(float)
        for g in grams:
            if g in weights:
                raw[g] += weights[g]
        norm = math.sqrt(sum(v * v for v in raw.values()))
        expected += [(doc_id, g, round(v / norm, 9)) for g, v in raw.items()]
    got = [(r.doc_id, r.term, round(r.weight, 9)) for r in terms.tfidf_weights(docs, vocabulary, n).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_weights_need_no_exchange_by_document(spark):
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    vocabulary, n = terms.fit_vocabulary(docs, max_features=50)
    plan = terms.tfidf_weights(docs, vocabulary, n)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(doc_id" not in plan and "BroadcastHashJoin" in plan


def test_no_vocabulary_gives_no_weights(spark):
    docs = spark.createDataFrame([(1, "12 34"), (2, None)], "doc_id long, text string")
    vocabulary, n = terms.fit_vocabulary(docs)
    assert vocabulary == [] and terms.tfidf_weights(docs, [{"term": "unused", "df": 1}], n).count() == 0


@pytest.mark.parametrize("size,parts", [(0, 1), (1, 1), (200 << 20, 7), (100 << 40, 3276800)])
def test_tasks_follow_the_bytes_of_the_features(size, parts):
    assert training.partitions_for(size) == parts
    depth = training.aggregation_depth(parts)
    assert parts <= training.FAN_IN**depth and depth >= 2


def test_coefficients_do_not_depend_on_the_partitions(spark, monkeypatch):
    docs = tables.lang_reviews(spark, SF_SMALL)
    few = training.fit(docs, max_features=40)
    monkeypatch.setattr(training, "PARTITION_BYTES", 20_000)
    many = training.fit(docs, max_features=40)
    assert few.params["partitions"] == "1" and int(many.params["partitions"]) > 6
    a, b = (m.model.stages[-1] for m in (few, many))
    assert abs(a.coefficients.toArray() - b.coefficients.toArray()).max() < 1e-3
    assert abs(a.intercept - b.intercept) < 1e-3
    p = [training.score(m.model, docs).agg(F.sum("p1")).first()[0] for m in (few, many)]
    assert abs(p[0] - p[1]) < 1e-2


def test_vocabulary_leaves_out_only_what_cannot_be_in_it(spark):
    texts = ["red fox runs red fox runs far", "red fox sleeps", "blue cat sleeps far", "blue cat", "red fox runs", "", None, "lone"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    stats = terms.term_stats(terms.doc_terms(docs))
    for k in (1, 2, 3, 5, 6, 8, 9, 13, 1000):
        vocabulary, n = terms.fit_vocabulary(docs, max_features=k)
        assert n == len(texts) and [tuple(r) for r in vocabulary] == [tuple(r) for r in terms.top_vocabulary(stats, k).collect()]


def test_rare_words_are_in_no_counted_ngram(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"big house word{chr(97 + i)} big house") for i in range(20)], "doc_id long, text string")
    counted, stats = [], terms.term_stats
    monkeypatch.setattr(terms, "term_stats", lambda pairs: counted.append(pairs.count()) or stats(pairs))
    vocabulary, _ = terms.fit_vocabulary(docs, max_features=2)
    assert [(r["term"], r["tf"], r["df"]) for r in vocabulary] == [("big", 40, 20), ("big house", 40, 20)]
    assert counted == [60, 20, 0]


def test_texts_are_dealt_into_parts_of_bounded_size(spark, monkeypatch):
    docs = tables.table(spark, SF_SMALL, "documents").select("doc_id", "text")
    whole = sorted(terms.doc_terms(docs).collect())
    monkeypatch.setattr(terms, "PART_OCTETS", 10_000)
    pairs = terms.doc_terms(docs)
    assert pairs.rdd.getNumPartitions() > 20 and sorted(pairs.collect()) == whole


def test_stored_words_keep_their_rows(spark):
    rows = [(1, ["red", "fox"]), (2, []), (3, None), (4, ["fox"]), (5, ["a" * 70_000, "fox", "fox"])]
    words = terms.stored_words(spark.createDataFrame(rows, "id int, words array<string>").repartition(3), "words")
    assert words.rdd.getNumPartitions() == 3
    assert sorted((r["__toks"] for r in words.collect()), key=repr) == sorted((w for _, w in rows), key=repr)


def test_a_part_of_the_texts_stays_one_task(spark, monkeypatch):
    monkeypatch.setattr(terms, "PART_OCTETS", 10_000)
    docs = tables.lang_reviews(spark, SF_SMALL)
    parts, counted = terms.in_parts(docs, "review").rdd.getNumPartitions(), []
    assert parts > 20 and terms.stored_tokens(docs, "review").rdd.getNumPartitions() == parts
    count = training.vocabulary_of
    monkeypatch.setattr(training, "vocabulary_of", lambda toks, k: counted.append(toks.rdd.getNumPartitions()) or count(toks, k))
    training.fit(docs, max_features=40, max_iter=3)
    assert counted == [parts]


def test_a_fit_caches_vectors_but_no_terms(spark, monkeypatch):
    frame, cached = type(spark.range(1)), []
    persist = frame.persist
    monkeypatch.setattr(frame, "persist", lambda self, *a, **k: cached.append(self.columns) or persist(self, *a, **k))
    fitted = training.fit(tables.lang_reviews(spark, SF_SMALL), max_features=40, max_iter=3)
    assert cached == [["features", "__label"]] and fitted.vocab_size == 40


def test_a_fit_holds_its_vectors_on_disk(spark, monkeypatch):
    frame, levels = type(spark.range(1)), []
    count = frame.count
    monkeypatch.setattr(frame, "count", lambda self: levels.append(self.storageLevel) or count(self))
    training.fit(tables.lang_reviews(spark, SF_SMALL), max_features=40, max_iter=3)
    held = [x for x in levels if x.useDisk]
    assert len(held) == 1 and not held[0].useMemory and not held[0].useOffHeap


def test_a_fitted_model_scores_in_a_session_that_observed(spark):
    from pyspark.sql import Observation

    docs = tables.lang_reviews(spark, SF_SMALL)
    fitted = training.fit(docs, max_features=40, max_iter=3)
    seen = Observation("seen")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3} and not fitted.model.stages[-1].hasSummary
    assert training.score(fitted.model, docs).count() == len(training.score(fitted.model, docs).select("p1").collect()) == docs.count()
