"""Operators over small literal tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessella.errors import EvalError
from tessella.operators import bm25, duplicates, evaluate, index, querylog, relations, retrieve, vectors
from tessella.operators.filters import SearchFilter
from tessella.schema import ISSUES, QUERY_LOG, RELATIONS, VECTORS
from tessella.sources.embedder import BagOfWords

ROWS = [
    (1, "o/a", 1, "issue", "login loop after redirect", "the login page loops forever", "open", ["bug", "auth"]),
    (2, "o/a", 2, "issue", "export PDF fails", "export to pdf crashes", "closed", ["export"]),
    (3, "o/b", 3, "pr", "memory leak in parser", "memory grows", "open", ["Bug"]),
    (4, "o/b", 4, "issue", "dark mode", "please add dark mode", "open", ["ux"]),
    (5, "o/b", 5, "issue", "导出CSV中文乱码", "打开后乱码", "open", None),
    (6, "o/b", 6, "issue", "存储过程无法展开", "点击无反应", "open", []),
]


@pytest.fixture(scope="module")
def world(spark):
    full = [(*r, "me", 0, "", "2024-01-01T00:00:00Z", None) for r in ROWS]
    issues = spark.createDataFrame(full, ISSUES).cache()
    e = BagOfWords(256)
    vecs = spark.createDataFrame(list(zip([r[0] for r in ROWS], e.embed([f"{r[4]} {r[5]}" for r in ROWS]))), VECTORS).cache()
    return issues, vecs, bm25.build(issues), e


def test_hybrid_search_finds_by_both_legs(world):
    issues, vecs, idx, e = world
    hits = retrieve.hybrid_search(issues, vecs, idx, e.embed(["login loop"])[0], "login loop").collect()
    assert (hits[0].number, hits[0].source) == (1, "vec+fts")
    assert hits[0].score == pytest.approx(2 / 61)
    assert len(hits) == 5


def test_cjk_query(world):
    issues, vecs, idx, e = world
    hits = bm25.search(idx, issues, "中文乱码", 10).collect()
    assert [h.id for h in hits] == [5]


@pytest.mark.parametrize("where, want", [(SearchFilter(repos=["o/a"]), {1, 2}), (SearchFilter(repos=[]), set()), (SearchFilter(state="closed"), {2}), (SearchFilter(state="all"), {1, 2, 3, 4, 5, 6}), (SearchFilter(labels=["BUG"]), {1, 3}), (SearchFilter(labels=["bug", "auth"]), {1}), (SearchFilter(labels=[]), {1, 2, 3, 4, 5, 6})])
def test_filters_hold_on_both_legs(world, where, want):
    issues, vecs, idx, e = world
    hits = retrieve.hybrid_search(issues, vecs, idx, e.embed(["login"])[0], "login", where, 10).collect()
    assert {h.number for h in hits} == want


def test_negative_top_k(world):
    with pytest.raises(ValueError):
        retrieve.hybrid_search(*world[:3], world[3].embed(["x"])[0], "x", top_k=-1)


def test_fusion(spark):
    legs = spark.createDataFrame([(9, 1), (2, 2)], "id long, rank int"), spark.createDataFrame([(2, 2), (7, 1)], "id long, rank int")
    got = [(r.id, r.source) for r in retrieve.rrf(*legs).collect()]
    assert got == [(2, "vec+fts"), (7, "fts"), (9, "vec")]


def test_related(world):
    issues, vecs, _, _ = world
    assert 1 not in {r.number for r in retrieve.find_related(issues, vecs, "o/a", 1).collect()}
    assert retrieve.find_related(issues, vecs, "o/a", 99).collect() == []
    assert {r.number for r in retrieve.find_related(issues, vecs, "o/a", 1, state="closed").collect()} == {2}


def test_duplicates(world):
    issues, vecs, idx, e = world
    hits = duplicates.check_duplicate(issues, vecs, idx, e.embed(["login loop after redirect"])[0], "login loop after redirect").collect()
    assert hits[0].number == 1 and hits[0].title_sim == 1.0
    assert duplicates.check_duplicate(issues, vecs, idx, e.embed(["zebra"])[0], "zebra quux").collect() == []


def test_batch_top_k_equals_single(world, spark):
    issues, vecs, _, _ = world
    cands = vectors.candidates(issues, vecs)
    qs = vecs.select(F.col("issue_id").alias("qid"), "embedding")
    got = {(r.qid, r["rank"]): r.id for r in vectors.top_k_batch(cands, qs, 3, 6).collect()}
    for row in vecs.collect():
        for r in vectors.top_k(cands, row.embedding, 3, 6).collect():
            assert got[row.issue_id, r["rank"]] == r.id
    assert vectors.top_k_batch(cands, qs.limit(0), 3).collect() == []


@pytest.mark.parametrize(
    "body, want",
    [
        ("Fixes #12 and #13", {("fixes", "o/r", 12), ("fixes", "o/r", 13)}),
        ("closes other/repo#5", {("closes", "other/repo", 5)}),
        ("see #7. fixed #8", {("refs", "o/r", 7), ("fixes", "o/r", 8)}),
        ("self #1 only", set()),
        ("prefix #9", {("refs", "o/r", 9)}),
        ("abc#4 #5x", set()),
        ("修复 #3", {("fixes", "o/r", 3)}),
        ("关闭 #3\n#3", {("closes", "o/r", 3), ("refs", "o/r", 3)}),
        ("resolved #6", {("refs", "o/r", 6)}),
        (None, set()),
    ],
)
def test_mentions(spark, body, want):
    df = spark.createDataFrame([("o/r", 1, "t", body)], "repo string, number long, title string, body string")
    assert {(r.kind, r.target_repo, r.target_number) for r in relations.extract(df).collect()} == want


def test_relations_replace_and_payload(spark):
    old = spark.createDataFrame([("r", 1, "fixes", "r", 2), ("r", 3, "refs", "r", 1)], RELATIONS)
    touched = spark.createDataFrame([("r", 1)], "repo string, number long")
    cleared = relations.replace(old, touched, old.limit(0))
    assert [(x.number, x.kind) for x in cleared.collect()] == [(3, "refs")]
    p = relations.payload(old, spark.createDataFrame([("r", 2)], "repo string, number long")).first()
    assert (p.fixes, p.closes, p.refs, p.fixed_by) == ([], [], [], ["r#1"])


def test_report_and_follow_up(spark):
    day = lambda n: datetime(2024, 1, 31 - n)
    rows = [(1, day(2), "search_issues", "a", None, ["at/r#9"], None), (2, day(3), "search_issues", "a", None, ["cat/r#9"], "x"), (3, day(4), "cli", "b", None, [], None), (4, day(5), None, "c", None, [], None), (5, datetime(2023, 12, 1), "cli", "d", None, [], None)]
    log = spark.createDataFrame(rows, QUERY_LOG)
    r = querylog.report(log, 30, "2024-01-31 00:00:00")
    assert tuple(r.totals.first()) == (4, 3, 1, 0.25)
    assert [(x.query, x.n) for x in r.top.collect()][0] == ("a", 2)
    assert {(x.tool, x.n) for x in r.by_tool.collect()} == {("search_issues", 2), ("cli", 1), ("-", 1)}
    assert querylog.report(log.limit(0), 30, "2024-01-31").totals.first().follow_up_rate == 0.0
    marked = {x.id: x.follow_up for x in querylog.mark_follow_up(log, "at/r#9").collect()}
    assert marked == {1: "at/r#9", 2: "x", 3: None, 4: None, 5: None}
    assert [x.query for x in querylog.recent_queries(log, 30, "2024-01-31").collect()] == ["a"]


def test_metrics(spark):
    rows = [("q", k + 1, g) for k, g in enumerate([0, 1, 0, 0, 2])] + [("z", 1, 0)]
    got = {r.query: r for r in evaluate.per_query(spark.createDataFrame(rows, "query string, rank int, grade int")).collect()}
    assert got["q"].ndcg5 == pytest.approx(1.7914882 / 3.6309298, abs=1e-6)
    assert (got["q"].mrr, got["q"].hit5, got["q"].recall5) == (0.5, 1.0, 1.0)
    assert (got["z"].ndcg5, got["z"].mrr, got["z"].hit5, got["z"].recall5) == (0, 0, 0, 0)
    none = spark.createDataFrame([], "query string, rank int, repo string, number long, grade int")
    with pytest.raises(EvalError):
        evaluate.run(none, spark.createDataFrame([], "query string, repo string, number long, expected_grade int"))


def test_drift(spark):
    hits = spark.createDataFrame([("q", 1, "r", k, k % 2) for k in range(4)], "query string, rank int, repo string, number long, grade int")
    anchors = spark.createDataFrame([("q", "r", k, 1) for k in range(4)], "query string, repo string, number long, expected_grade int")
    d = evaluate.drift(hits, anchors).first()
    assert (d.n_anchors, d.n_wrong, d.drift, d.valid, len(d.samples)) == (4, 2, 0.5, False, 2)


def test_evenly(spark):
    got = [r.id for r in querylog.evenly(spark.range(100), 8, "id").orderBy("id").collect()]
    assert got == [12 * k for k in range(8)]
    assert querylog.evenly(spark.range(0), 8, "id").collect() == []


def test_positions_of_many_rows(spark):
    """A million rows with further columns, in an order of two columns and with nulls, against a global sort."""
    n, k = 1_000_000, 3000
    df = spark.range(n).select((F.col("id") * 48271 % 1000003).alias("b"), F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("a"), F.lit("x").alias("c"), F.rand(3).alias("d"), "id")
    got = querylog.evenly(df, k, "a", "b", "id").collect()
    rows = df.select("a", "b", "id").toPandas().sort_values(["a", "b", "id"], na_position="first")
    stride = n // k
    want = rows.iloc[: stride * k : stride]["id"].tolist()
    assert len(got) == k and {r.id for r in got} == set(want) and all(r.c == "x" for r in got)


def test_positions_with_one_key_and_none(spark):
    from tessella.operators.order import numbered

    same = spark.range(50).select(F.lit(1).alias("a"), "id")
    assert sorted(r._at for r in numbered(same, "a").collect()) == list(range(50))
    assert numbered(same.limit(0), "a", "id").collect() == []
    assert [r._at for r in numbered(same, "a", "id").orderBy("id").collect()] == list(range(50))


def test_ties_are_settled_alike(spark):
    rows = [("k", 1, x, [x]) for x in "cab"] * 3
    df = spark.createDataFrame(rows, "key string, at int, v string, labels array<string>")
    for n in (1, 5):
        assert index.latest(df.repartition(n), ["key"], "at").first().v == "c"


def test_dimensions_must_agree(world):
    from tessella.errors import DimensionMismatch

    with pytest.raises(DimensionMismatch):
        retrieve.hybrid_search(*world[:3], [1.0, 0.0], "login")


def test_a_stored_index_finds_the_same_and_reads_no_text(world, spark, tmp_path):
    issues, _, idx, _ = world
    for name, df in bm25.stored(idx).items():
        df.write.parquet(f"{tmp_path}/{name}")
    there = bm25.TextIndex(*[spark.read.parquet(f"{tmp_path}/{n}") for n in ("postings", "lengths", "text_stats")])
    for q in ("login loop", "中文乱码", "memory", "dark-mode", "nothing"):
        made = bm25.search(there, issues, q, 10)
        assert [tuple(r) for r in made.collect()] == [tuple(r) for r in bm25.search(idx, issues, q, 10).collect()]
        assert "title" not in made._jdf.queryExecution().executedPlan().toString()
    changed = issues.where("id = 1").withColumn("title", F.lit("zebra"))
    new = bm25.updated(there, changed)
    assert [r.id for r in bm25.search(new, issues, "zebra", 10).collect()] == [1] and new.stats.first().n_docs == 6
    assert bm25.search(new, issues, "redirect", 10).collect() == []


def test_queries_of_keeps_the_order(spark):
    recent = spark.createDataFrame([("a",), ("c",)], "query string")
    anchors = spark.createDataFrame([("z",), ("a",), ("b",), ("z",)], "query string")
    assert [r.query for r in evaluate.queries_of(recent, anchors).collect()] == ["a", "c", "z", "b"]


def test_upsert_keeps_ids(spark):
    old = spark.createDataFrame([(7, "r", 1, "a"), (9, "r", 2, "b")], "id long, repo string, number long, title string")
    new = spark.createDataFrame([("r", 2, None), ("r", 5, "e"), ("q", 1, "f")], "repo string, number long, title string")
    got = {(r.repo, r.number): (r.id, r.title) for r in index.upsert(old, new).collect()}
    assert got == {("r", 1): (7, "a"), ("r", 2): (9, None), ("q", 1): (10, "f"), ("r", 5): (11, "e")}
    again = index.upsert(index.upsert(old, new), new)
    assert {(r.repo, r.number): r.id for r in again.collect()} == {k: v[0] for k, v in got.items()}
