"""Boilerplate by distinct sites: notices go whole, copies of documents keep their lines."""

import random

import helpers

from tessella.llm import line_spread


def after(spark, rows):
    """Texts by doc_id, and the plain version's."""
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], helpers.SCHEMA)
    got = {r.doc_id: r.text for r in line_spread.dedup_lines(df).collect()}
    bad = helpers.plain_boilerplate(rows)
    assert got == {i: t and "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad) for i, t, _ in rows}
    return got, bad


def own(rng, n):
    return [helpers.prose(rng, 9) for _ in range(n)]


def test_a_notice_of_three_lines_goes_whole(spark):
    rng = random.Random(71)
    notice = ["Licensed under the terms below.", "You may copy this work freely.", "No warranty is given."]
    rows = [(k, "\n".join([*own(rng, 2), *notice, *own(rng, 2)]), f"s{k % 20:02d}") for k in range(40)]
    got, bad = after(spark, rows)
    assert bad == set(notice) and all(len(t.split("\n")) == 4 for t in got.values())


def test_a_footer_goes_though_one_of_its_documents_is_copied(spark):
    rng = random.Random(72)
    rows = [(k, "\n".join([*own(rng, 4), "All rights reserved."]), f"s{k % 12:02d}") for k in range(24)]
    copy = "\n".join([*own(rng, 6), "All rights reserved."])
    rows += [(1000 + k, copy, f"s{k % 12:02d}") for k in range(600)]
    got, bad = after(spark, rows)
    assert bad == {"All rights reserved."} and got[1000] == got[1599] == copy.rsplit("\n", 1)[0]


def test_near_copies_on_many_sites_keep_their_lines(spark):
    rng = random.Random(73)
    base, rows = own(rng, 12), []
    for k in range(60):
        lines = list(base)
        lines[rng.randrange(12)] = helpers.prose(rng, 9)
        rows.append((k, "\n".join(lines), f"s{k % 15:02d}"))
    rows += [(100 + k, "\n".join(own(rng, 3)), f"s{k % 15:02d}") for k in range(30)]
    _, bad = after(spark, rows)
    assert bad == set()


def test_few_sites_and_odd_rows(spark):
    rng = random.Random(74)
    rows = [(k, f"{helpers.prose(rng, 9)}\n  only here \n\nlast", f"s{k % 4}") for k in range(20)]
    rows += [(100, None, "s9"), (101, "", None), (102, " \n \n", "s8"), (103, "last", None)]
    got, bad = after(spark, rows)
    assert bad == set() and got[100] is None and got[102] == " \n \n"


def test_thresholds_decide(spark):
    rng = random.Random(75)
    rows = [(k, "\n".join([*own(rng, 3), "seven sites"]), f"s{k % 7}") for k in range(14)]
    df = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], helpers.SCHEMA)
    removed = lambda n: sum(r.n_removed for r in line_spread.dedup_lines(df, min_sites=n).collect())
    assert (removed(7), removed(8)) == (14, 0)
