"""Every operator over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import helpers
import pytest
from pyspark.sql import functions as F

from tessella.llm import bayes_minhash, bin_slack, compression_bands, edit_counts, flac, gam_quality, line_spread, merge_replay, surrogates, toxicity

CLASHING = ["n_lines", "n_removed", "n_entities", "ids", "decoded", "component_id", "kept", "score", "hits", "key", "rep", "length", "part", "rank", "media", "n_words", "label", "line", "keys", "mention"]


def model(spark):
    return gam_quality.fit_arrays(gam_quality.np.zeros((0, len(gam_quality.FEATURES))), gam_quality.np.zeros(0))


OPERATORS = {
    "edit_counts": lambda s, d: edit_counts.count(d),
    "toxicity": lambda s, d: toxicity.score(d, {("moron", False): 0.9}, {(-1, ""): 0.5}),
    "keep_clean": lambda s, d: toxicity.keep_clean(d, {("moron", False): 0.9}, {(-1, ""): 0.5}),
    "surrogates": lambda s, d: surrogates.replace(d),
    "flac": lambda s, d: flac.digests(flac.encode(d)),
    "compression": lambda s, d: compression_bands.judge(d),
    "lines": lambda s, d: line_spread.dedup_lines(d),
    "bpe": lambda s, d: merge_replay.decode(merge_replay.encode(d)),
    "near": lambda s, d: bayes_minhash.near_duplicates(d),
    "gam": lambda s, d: gam_quality.score(d, model(s)),
}


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(helpers.edge_rows(), helpers.SCHEMA)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING]).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, edge, name):
    got = OPERATORS[name](spark, edge)
    rows = got.collect()
    assert len(rows) == 10
    assert len(set(c.lower() for c in got.columns)) == len(got.columns)
    by = [r for r in rows if r.doc_id == 4]
    assert len(by) == 2 and by[0] == by[1]


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table(spark, edge, name):
    assert OPERATORS[name](spark, edge.limit(0)).collect() == []


def test_packing_edges(spark, edge):
    rows = bin_slack.pack(edge).collect()
    assert sorted(r.length for r in rows if r.doc_id in (1, 2)) == [1, 1]
    assert bin_slack.pack(edge.limit(0)).collect() == []
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= bin_slack.CAPACITY


def test_learning_from_nothing(spark, edge):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    terms, fuzzy = toxicity.fit(edge, labels)
    assert terms == {} and {r.score for r in toxicity.score(edge, terms, fuzzy).collect()} == {0.0}
    scores = {r.score for r in gam_quality.score(edge, gam_quality.fit(edge, labels)).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() <= 1
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(edge, nulls)[0] == {}
