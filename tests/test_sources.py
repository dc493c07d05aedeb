"""The raw layer, pages, sync, skeletons, settings, tools and commands, without any network."""

import gzip
import json

import pytest

from tessella import cli
from tessella.api import Tools
from tessella.config import Config
from tessella.errors import ConfigError, FingerprintMismatch, IndexMissing, SourceError, TessellaError
from tessella.functions import fingerprint
from tessella.operators.sync import sync_repo
from tessella.operators import querylog
from tessella.schema import FOLLOW_UPS, ISSUES, QUERY_LOG, RAW_COMMENT, RAW_ISSUE, VECTORS
from tessella.sources import github, raw, skeleton
from tessella.sources.embedder import BagOfWords, parse_grade
from tessella.sources.store import IndexStore
from tessella.streaming.ingest import ingest


def issue(n, title, updated, **more):
    return {"id": n, "number": n, "title": title, "body": f"body {n}", "state": "open", "labels": [{"name": "bug"}], "comments": 0, "created_at": updated, "user": {"login": "me"}, "updated_at": updated} | more


class Fake:
    """A tracker that honours ``since`` and serves pages of two."""

    def __init__(self, issues, comments=()):
        self.issues, self.comments = issues, list(comments)

    def issue_pages(self, repo, since=None):
        rows = [i for i in self.issues if not since or i["updated_at"] >= since]
        for k in range(0, len(rows), 2):
            yield json.dumps(rows[k : k + 2])

    def comment_pages(self, repo, since=None):
        if self.comments:
            yield json.dumps(self.comments)


def comment(i, n, body, login="amy"):
    return {"id": i, "user": {"login": login} if login else None, "body": body, "issue_url": f"https://h/repos/t/a/issues/{n}", "created_at": "x"}


def test_raw_merge(spark, tmp_path):
    store = raw.RawStore(spark, str(tmp_path))
    row = lambda title, at: spark.createDataFrame([(1, "issue", title, "b", "open", [], 0, "me", at, at)], RAW_ISSUE)
    store.merge_issues("t/a", row("old", "2024-01-02"))
    store.merge_issues("t/a", row("stale", "2024-01-01"))
    assert store.read("t/a", "issues").first().title == "old"
    store.merge_issues("t/a", row("new", "2024-01-02"))
    assert store.read("t/a", "issues").first().title == "new"
    talk = lambda body: spark.createDataFrame([(11, 1, "x", body, ""), (10, 1, "y", "first", "")], RAW_COMMENT)
    store.merge_comments("t/a", talk("seen"))
    store.merge_comments("t/a", talk("edited"))
    got = store.load("t/a").first()
    assert [(c.author, c.body) for c in got.comments] == [("y", "first"), ("x", "seen")]
    assert raw.RawStore(spark, str(tmp_path)).load("t/none").collect() == []


def test_pages_are_durable_and_merged_once(spark, tmp_path):
    store = raw.RawStore(spark, str(tmp_path))
    row = lambda n, title, at: spark.createDataFrame([(n, "issue", title, "b", "open", [], 0, "me", at, at)], RAW_ISSUE)
    for n in range(4):
        store.stage("t/a", "issues", row(n % 3, f"t{n}", "2024-01-01"))
    assert {r.number: r.title for r in store.read("t/a", "issues").collect()} == {0: "t3", 1: "t1", 2: "t2"}
    home = tmp_path / "raw" / "t__a" / "issues"
    assert len([p for p in (home / "pages").iterdir() if p.is_dir()]) == 4 and not list(home.glob("CURRENT-*"))
    store.merge("t/a", "issues")
    assert {r.number: r.title for r in store.read("t/a", "issues").collect()} == {0: "t3", 1: "t1", 2: "t2"}
    assert len(list(home.glob("CURRENT-*"))) == 1 and not [p for p in (home / "pages").iterdir() if p.is_dir()]


def test_pointers(spark, tmp_path):
    from tessella.errors import StoreConflict
    from tessella.sources.pointer import Pointer

    one, two = Pointer(spark, str(tmp_path)), Pointer(spark, str(tmp_path))
    assert one.read() == (0, None)
    n = one.swap({"a": "x"}, 0)
    with pytest.raises(StoreConflict):
        two.swap({"a": "lost"}, 0)
    assert two.read() == (n, {"a": "x"})
    (tmp_path / f"CURRENT-{n + 1:012d}").write_text('{"a": "cut o')  # a writer that died
    assert one.read() == (n, {"a": "x"})
    m = one.swap({"a": "y"}, n)
    assert m == n + 2 and two.read() == (m, {"a": "y"})
    assert one.drop_before(1) == ([{"a": "x"}], [{"a": "y"}]) and two.read() == (m, {"a": "y"})


def test_old_versions_go_and_logs_only_grow(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path))
    store.create()
    for k in range(6):
        store.publish({"manifest": store.with_manifest("n", str(k))})
    assert store.manifest("n") == "5" and len(list((tmp_path / "index").glob("manifest-*"))) == 3
    from datetime import datetime

    entry = lambda i, results: spark.createDataFrame([(i, datetime(2024, 1, i), "search_issues", "q", None, results, None)], QUERY_LOG)
    for i in (1, 2):
        store.append("query_log", entry(i, ["r#1"]))
    before = store.versions()
    mark = querylog.follow_up(store.table("query_log"), "r#1", datetime(2024, 2, 1)).first()
    store.append("follow_ups", spark.createDataFrame([tuple(mark)], FOLLOW_UPS))
    assert {r.id: r.follow_up for r in store.table("query_log").collect()} == {1: None, 2: "r#1"} and store.versions() == before


def test_archived_skeletons(spark, tmp_path):
    import tarfile

    store = IndexStore(spark, str(tmp_path / "a"))
    store.publish({"issues": spark.createDataFrame([(1, "r", 1, "issue", "t", "b", "open", ["x"], "me", 0, "", "2024", "h")], ISSUES), "issues_vec": spark.createDataFrame([(1, [1.0, 0.0])], VECTORS), "manifest": store.with_manifest("embedding_fp", "m|api|len=512|text=1") if store.exists() else spark.createDataFrame([("embedding_fp", fingerprint.full("m|api|len=512"))], "key string, value string")})
    skeleton.export(store, str(tmp_path / "out"))
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "out", "skeleton")
    other = IndexStore(spark, str(tmp_path / "b"))
    folder = skeleton.unpacked(other, str(tmp_path / "s.tar.gz"))
    assert skeleton.load(other, folder, fingerprint.full("m|api|len=512"))["issues"] == 1
    with pytest.raises(ConfigError):
        (tmp_path / "none").mkdir()
        with tarfile.open(tmp_path / "n.tar", "w") as tar:
            tar.add(tmp_path / "none", "x")
        skeleton.unpacked(other, str(tmp_path / "n.tar"))


def test_calls_are_spaced_and_go_through_the_proxy(monkeypatch):
    from tessella.sources import embedder as E

    seen, slept = [], []
    monkeypatch.setattr(E, "_post", lambda url, key, body, timeout, proxy=None: seen.append(proxy) or {"data": [{"embedding": [3.0, 4.0]} for _ in body["input"]]})
    monkeypatch.setattr(E.time, "sleep", slept.append)
    got = E.HttpEmbedder("http://h", "", "m", batch=1, interval=5.0, proxy="http://p").embed(["a", "b"])
    assert got[1] == pytest.approx([0.6, 0.8]) and seen == ["http://p"] * 2 and slept[0] == 0 and 4 < slept[1] <= 5
    one, two = E.ContentHash(16).embed(["a", "b"])
    assert one != two and one == E.ContentHash(16).embed(["a"])[0] and len(one) == 16


def test_pages(spark):
    page = json.dumps([issue(1, None, "2024", body=None, user=None), issue(2, "t", "2024", pull_request={"url": "u"})])
    rows = github.parse_issues(spark.createDataFrame([("t/a", page)], "repo string, json string")).collect()
    assert [(r.number, r.kind, r.title, r.author, r.labels) for r in rows] == [(1, "issue", "", "", ["bug"]), (2, "pr", "t", "me", ["bug"])]
    page = json.dumps([comment(1, 5, "hi"), comment(2, 5, "  "), comment(3, 6, "x", None), comment(4, "abc", "y")])
    rows = github.parse_comments(spark.createDataFrame([(page,)], "json string")).collect()
    assert [(r.id, r.issue_number, r.author) for r in rows] == [(1, 5, "amy"), (3, 6, "")]


def test_rest_retries_and_pages():
    slept, calls = [], []
    replies = [OSError("cut"), (429, {"retry-after": "7"}, ""), (200, {"link": '<http://h/2>; rel="next", <http://h/9>; rel="last"', "x-ratelimit-remaining": "10", "x-ratelimit-reset": "130"}, "[]"), (200, {}, "[1]")]

    def get(url):
        calls.append(url)
        r = replies[len(calls) - 1]
        if isinstance(r, Exception):
            raise r
        return r

    rest = github.Rest("http://h", get=get, sleep=slept.append, now=lambda: 100.0)
    assert list(rest.pages("http://h/1")) == ["[]", "[1]"]
    assert calls[-1] == "http://h/2" and 2 in slept and 7.0 in slept and 30.0 in slept
    with pytest.raises(SourceError):
        github.Rest("http://h", get=lambda u: (500, {}, ""), sleep=slept.append).fetch("http://h/x")


def test_sync_is_incremental_and_idempotent(spark, tmp_path):
    store, landing, e = IndexStore(spark, str(tmp_path)), raw.RawStore(spark, str(tmp_path)), BagOfWords(64)
    with pytest.raises(IndexMissing):
        store.versions()
    source = Fake([issue(1, "login loop", "2024-01-01T00:00:00Z"), issue(2, "pdf fixes #1", "2024-01-02T00:00:00Z"), issue(3, "dark", "2024-01-03T00:00:00Z")], [comment(1, 1, "me too"), comment(2, 1, "beep", "x[bot]")])
    first = sync_repo(spark, store, landing, source, e, "t/a")
    assert (first.fetched, first.embedded, first.skipped, first.cursor) == (3, 3, 0, "2024-01-03T00:00:00Z")
    ids = {r.number: r.id for r in store.table("issues").collect()}
    again = sync_repo(spark, store, landing, source, e, "t/a")
    assert (again.embedded, again.skipped) == (0, 2)
    source.issues[0] = issue(1, "login loop again", "2024-01-04T00:00:00Z")
    source.comments.append(comment(3, 2, "beep", "x[bot]"))
    third = sync_repo(spark, store, landing, source, e, "t/a")
    assert third.embedded == 1
    rows = {r.number: r for r in store.table("issues").collect()}
    assert {n: r.id for n, r in rows.items()} == ids and rows[1].title == "login loop again"
    assert store.table("issue_comments").count() == 3
    assert [(r.number, r.kind, r.target_number) for r in store.table("relations").collect()] == [(2, "fixes", 1)]
    assert store.table("issues_vec").count() == 3
    with pytest.raises(FingerprintMismatch):
        sync_repo(spark, store, landing, source, BagOfWords(32), "t/a")

    tools = Tools(spark, store, e)
    hits = tools.search_issues("login loop")
    assert hits[0]["number"] == 1 and set(hits[0]) == {"repo", "number", "kind", "title", "state", "snippet", "score", "source"}
    pack = tools.get_issue_context("t/a", 1)
    assert pack["relations"]["fixed_by"] == ["t/a#2"] and "- amy me too" in pack["comments"] and len(pack["related"]) == 2
    assert store.table("query_log").first().follow_up == "t/a#1"
    with pytest.raises(TessellaError):
        tools.get_issue_context("t/a", 99)
    assert tools.list_repos()[0]["issues"] == 3
    assert tools.check_duplicate("login loop again", "")[0]["number"] == 1
    with pytest.raises(FingerprintMismatch):
        Tools(spark, store, BagOfWords(32)).search_issues("x")

    out = str(tmp_path / "skeleton")
    skeleton.export(store, out)
    assert spark.read.parquet(f"{out}/issues").where("title <> '' OR body <> ''").count() == 0
    other = IndexStore(spark, str(tmp_path / "other"))
    with pytest.raises(FingerprintMismatch):
        skeleton.load(other, out, fingerprint.full("m|api|len=512"))
    report = skeleton.load(other, out, fingerprint.full(e.fingerprint()))
    assert (report["issues"], report["vectors"]) == (3, 3)
    assert {r.embedded_hash for r in other.table("issues").collect()} == {r.embedded_hash for r in store.table("issues").collect()}


def test_a_failed_page_keeps_those_before(spark, tmp_path):
    class Broken(Fake):
        def issue_pages(self, repo, since=None):
            yield json.dumps(self.issues[:1])
            raise SourceError("gone")

    landing = raw.RawStore(spark, str(tmp_path))
    with pytest.raises(SourceError):
        sync_repo(spark, IndexStore(spark, str(tmp_path)), landing, Broken([issue(1, "a", "2024")]), BagOfWords(8), "t/a")
    assert landing.read("t/a", "issues").count() == 1


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps({"number": 1, "title": t, "updated_at": at}) for t, at in (("new", "2024-02"), ("old", "2024-01"))]
    for k, line in enumerate(lines):
        with gzip.open(tmp_path / "in" / f"{k}.json.gz", "wt") as f:
            f.write(line + "\n\n{broken\n")
    store = IndexStore(spark, str(tmp_path))
    for _ in range(2):
        ingest(spark, store, "t/a", str(tmp_path / "in"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.id, r.title) for r in store.table("issues").collect()] == [(1, "new")]


def test_settings(tmp_path):
    c = Config(str(tmp_path), {})
    assert c.embedding().batch_size == 64 and c.search().rrf_k == 60 and c.token() is None and c.text() == (2, 2000)
    (tmp_path / "config.toml").write_text('token = "t"\nrepos = ["a/b"]\n[embedding]\nprovider = "openai"\nmodel = "m"\n[retrieval]\nrrf_k = 10\n[network]\nproxy = "p"\n')
    c = Config(str(tmp_path), {"TESSELLA_API_MODEL": "n", "ALL_PROXY": "q"})
    assert (c.embedding().model, c.embedding().batch_size, c.search().rrf_k, c.repos(), c.proxy()) == ("n", 16, 10, ["a/b"], "q")
    with pytest.raises(ConfigError):
        Config(str(tmp_path / "none"), {"TESSELLA_EMBEDDER": "custom"}).embedding()
    with pytest.raises(ConfigError):
        Config(str(tmp_path), {"TESSELLA_EMBEDDER": "nobody"}).embedding()


def test_commands(tmp_path):
    args = cli.parser().parse_args(["sync", "a/b", "--all"])
    with pytest.raises(ConfigError):
        cli.repos_of(args, Config(str(tmp_path), {}))
    assert cli.parser().parse_args(["report"]).days == 30
    assert cli.table([]) == cli.NO_HITS
    rows = cli.table([{"score": 0.5, "repo": "r", "number": 1, "kind": "pr", "state": "open", "source": "vec", "title": "中" * 60}])
    assert "r#1" in rows and cli.width(rows.split("vec  ")[1]) <= cli.TITLE_WIDTH
    a = [{"query": "q", "repo": "r", "number": 1, "expected_grade": 2, "note": "x"}]
    assert cli.anchors_of(json.dumps(a)) == cli.anchors_of(json.dumps({"anchors": a})) == [("q", "r", 1, 2)]
    assert parse_grade('{"grade": 2, "reason": "x"}') == (2, "x")
    assert skeleton.gunzip_if_needed(gzip.compress(b"x")) == skeleton.gunzip_if_needed(b"x") == b"x"
