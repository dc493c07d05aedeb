"""Entities that stand side by side, against values planted here and not found by the patterns."""

from itertools import permutations

import helpers

from tessella.llm import surrogates

VALUES = {
    "phone": "+1 (826) 555-4081",
    "bare": "+18265554081",
    "abroad": "+49 30 1234 5678",
    "local": "(212) 555-0187",
    "ip": "190.137.223.204",
    "card": "4111 1111 1111 1111",
    "ssn": "123-45-6789",
    "email": "ann.lee@mail8.example.com",
}


def test_neighbours_go_whole_and_alike(spark):
    pairs = list(permutations(VALUES, 2))
    rows = [(k, f"see {VALUES[a]} {VALUES[b]} there", "en", "a", 0) for k, (a, b) in enumerate(pairs)]
    alone = [(1000 + k, f"see {v} there", "en", "a", 0) for k, v in enumerate(VALUES.values())]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows + alone, helpers.SCHEMA)).collect()}
    of = {name: got[1000 + k].text[4:-6] for k, name in enumerate(VALUES)}
    assert all(of[name] != v for name, v in VALUES.items())
    for k, (a, b) in enumerate(pairs):
        assert (got[k].text, got[k].n_entities) == (f"see {of[a]} {of[b]} there", 2), (a, b)


def test_a_number_after_a_phone_stays(spark):
    rows = [(1, "call +1 (826) 555-4081 2024 was", "en", "a", 0), (2, "call +1 (826) 555-4081 now", "en", "a", 0)]
    got = {r.doc_id: r.text for r in surrogates.replace(spark.createDataFrame(rows, helpers.SCHEMA)).collect()}
    assert got[1].endswith(" 2024 was") and got[1][:-9] == got[2][:-4]


def test_planted_addresses_of_the_corpus(spark, sf):
    """Documents 1377 and 7052 of sf0.1 have an address right after a phone number."""
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").where("doc_id IN (1377, 7052)")
    got = " ".join(r.text for r in surrogates.replace(df).collect())
    assert not [x for x in ("137.223.204", "106.47.218", "555-4081", "555-7672") if x in got]
