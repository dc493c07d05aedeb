"""Misspelt terms weigh the same however many rows are labelled."""

import random

import helpers

from tessella.llm import toxicity


def _corpus(spark, n_clean, misspelt_clean=0):
    rng = random.Random(51)
    texts = [f"{helpers.prose(rng, 8)} moron {helpers.prose(rng, 8)}" for _ in range(20)]
    texts += [f"{helpers.prose(rng, 8)} morron {helpers.prose(rng, 8)}" for _ in range(misspelt_clean)]
    texts += [helpers.prose(rng, 12) for _ in range(n_clean)]
    ids = [i for i in range(4 * len(texts)) if not toxicity.held_out(i)][: len(texts)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in zip(ids, texts, strict=True)], helpers.SCHEMA)
    labels = spark.createDataFrame([(i, 0, int(k < 20)) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    return toxicity.fit(docs, labels)


def _score(model, text):
    terms, fuzzy = model
    return toxicity.score_text(text, toxicity.Matcher(toxicity.Lexicon(terms)), fuzzy)[0]


def test_misspellings_count_with_few_labels_as_with_many(spark):
    few, many = _corpus(spark, 60), _corpus(spark, 2500)
    assert ("moron", False) in few[0] and ("moron", False) in many[0]
    for text in ("you morron there", "you mron there", "you mor0n there", "you moorn there"):
        assert _score(few, text) == _score(many, text) >= toxicity.THRESHOLD, text


def test_clean_evidence_lowers_a_misspelling(spark):
    model = _corpus(spark, 60, misspelt_clean=3)
    assert _score(model, "you morron there") < toxicity.THRESHOLD <= _score(model, "you mron there")
    assert _score(model, "you moron there") >= toxicity.THRESHOLD


def test_more_edits_weigh_less():
    weights = [toxicity.unseen(0.95, 10, edits) for edits in range(3)]
    assert weights == sorted(weights, reverse=True) and weights[0] == 0.95
