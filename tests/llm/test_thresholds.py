"""Near copies between the pipeline's threshold and that of op9."""

import random

import helpers

import corpus_pipeline as P  # conftest.py puts the root on the path
from tessella.llm import bayes_minhash


def _edited(rng, n, changes):
    """A text of n words, and a copy with single words changed far from each other: 5 shingles of the n - 4 go for each."""
    w = helpers.prose(rng, n).split()
    other = list(w)
    for k in range(changes):
        other[(k + 1) * n // (changes + 1)] = f"x{k}"
    return " ".join(w), " ".join(other)


def _jaccard(a, b):
    a, b = (bayes_minhash.shingles(bayes_minhash.words_of(t)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_the_stage_drops_copies_from_80_percent_on(spark, sf):
    rng = random.Random(31)
    pairs = [_edited(rng, n, changes) for n in (204, 404, 604) for changes in range(1, 16)]
    rows = [(2 * k + side, t, "en", "a", len(t)) for k, pair in enumerate(pairs) for side, t in enumerate(pair)]
    near = {2 * k + 1: _jaccard(*pair) for k, pair in enumerate(pairs)}
    assert sum(0.80 <= j < 0.85 for j in near.values()) >= 5 and sum(j < 0.80 for j in near.values()) >= 5
    df = spark.createDataFrame(rows, helpers.SCHEMA)
    stayed = {r.doc_id for r in P.drop_near_duplicates(spark, df, sf).collect()}
    assert {i for i in near if i not in stayed} == {i for i, j in near.items() if j >= 0.80}
    got = bayes_minhash.near_duplicates(df).collect()
    assert {r.doc_id for r in got if not r.kept} == {i for i, j in near.items() if j >= 0.85}


def test_bands_miss_next_to_nothing():
    assert bayes_minhash.bands_for(85) == (32, 6)
    for percent in (80, 85, 90):
        assert bayes_minhash.shares_no_band(percent, *bayes_minhash.bands_for(percent)) <= 1e-6


def test_components_of_any_shape(spark):
    """Chains, cycles, stars and random graphs, against union and find."""
    rng = random.Random(32)
    links = [(k, k + 1) for k in range(100, 140)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)] + [(300, 300 + k) for k in range(1, 60)] + [(459, 400 + k) for k in range(59)]
    links += [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(110)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in bayes_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert bayes_minhash.components(spark.createDataFrame([], "a long, b long")).collect() == []
