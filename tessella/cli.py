"""Commands: sync, status, report, doctor, export, fetch, search, eval."""

from __future__ import annotations

import argparse
import json
import sys
import unicodedata
from datetime import datetime, timezone


from .api import Tools
from .config import Config
from .errors import ConfigError, TessellaError
from .operators import evaluate, querylog
from .operators.sync import SyncParams, sync_repo
from .session import session
from .sources import raw, skeleton
from .sources.embedder import HttpEmbedder, HttpJudge
from .sources.github import Rest
from .sources.store import IndexStore

TITLE_WIDTH, NO_HITS = 60, "(no hits)"


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def cut(text: str, most: int) -> str:
    if width(text) <= most:
        return text
    out = ""
    for c in text:
        if width(out + c) > most - 1:
            break
        out += c
    return out + "…"


def table(hits: list[dict]) -> str:
    """Hits as an aligned table."""
    if not hits:
        return NO_HITS
    rows = [[f"{h['score']:.4f}", f"{h['repo']}#{h['number']}", h["kind"], h["state"], h["source"], cut(h["title"], TITLE_WIDTH)] for h in hits]
    widths = [max(width(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("  ".join(c + " " * (w - width(c)) for c, w in zip(r, widths, strict=True)).rstrip() for r in rows)


def anchors_of(raw_json: str) -> list[tuple[str, str, int, int]]:
    """Anchors from a bare array, or from an object's ``anchors``; unknown keys are ignored."""
    made = json.loads(raw_json)
    rows = made.get("anchors", []) if isinstance(made, dict) else made
    return [(r["query"], r["repo"], int(r["number"]), int(r["expected_grade"])) for r in rows]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command")
    c = sub.add_parser("sync")
    c.add_argument("repo", nargs="?")
    c.add_argument("--all", action="store_true")
    c.add_argument("--rebuild", action="store_true")
    sub.add_parser("status")
    c = sub.add_parser("report")
    c.add_argument("--days", type=int, default=30)
    sub.add_parser("doctor")
    c = sub.add_parser("export")
    c.add_argument("--skeleton", action="store_true", required=True)
    c.add_argument("-o", "--output", required=True)
    c = sub.add_parser("fetch")
    c.add_argument("--from", dest="source", required=True)
    c = sub.add_parser("search")
    c.add_argument("query")
    c.add_argument("--repos", nargs="*", default=[])
    c.add_argument("--state")
    c.add_argument("--labels", nargs="*", default=[])
    c.add_argument("--top-k", type=int, default=5)
    c = sub.add_parser("eval")
    c.add_argument("--days", type=int)
    c.add_argument("--anchors")
    return p


def repos_of(args, config: Config) -> list[str]:
    if args.repo and args.all:
        raise ConfigError("give a repository or --all, not both")
    repos = [args.repo] if args.repo else config.repos()
    if not repos:
        raise ConfigError("no repository given, and none in the settings")
    return repos


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    config = Config()
    spark = session()
    store = IndexStore(spark, str(config.home))
    command = args.command or "status"
    try:
        return COMMANDS[command](args, config, spark, store)
    except TessellaError as e:
        print(e, file=sys.stderr)
        return 1


def _embedder(config: Config) -> HttpEmbedder:
    e = config.embedding()
    return HttpEmbedder(e.base, e.key, e.model, e.dimensions, e.batch_size, interval=config.batch_interval_ms() / 1000, proxy=config.proxy())


def _tools(config, spark, store) -> Tools:
    repeats, body_max = config.text()
    return Tools(spark, store, _embedder(config), config.search(), repeats, body_max)


def _sync(args, config, spark, store) -> int:
    repeats, body_max = config.text()
    for repo in repos_of(args, config):
        print(repo, sync_repo(spark, store, raw.RawStore(spark, str(config.home)), Rest("https://api.github.com", config.token(), proxy=config.proxy()), _embedder(config), repo, SyncParams(64, repeats, body_max), rebuild=args.rebuild))
    return 0


def _status(args, config, spark, store) -> int:
    querylog.repo_stats(store.table("issues"), store.table("sync_state")).show(1000, False)
    return 0


def _report(args, config, spark, store) -> int:
    made = querylog.report(store.table("query_log"), args.days, datetime.now(timezone.utc).replace(tzinfo=None))
    for part in (made.totals, made.top, made.by_tool):
        part.show(truncate=False)
    return 0


def _doctor(args, config, spark, store) -> int:
    e = config.embedding()
    print(f"home {config.home}\nendpoint {e.base}\nmodel {e.model}\nkey {'set' if e.key else 'not set'}\nproxy {config.proxy() or '-'}")
    print(f"probe: {len(_embedder(config).embed(['probe'])[0])} dimensions")
    return 0


def _export(args, config, spark, store) -> int:
    skeleton.export(store, args.output)
    return 0


def _fetch(args, config, spark, store) -> int:
    from .functions import fingerprint

    e = config.embedding()
    source = skeleton.unpacked(store, args.source, config.proxy()) if skeleton.is_archive(args.source) else args.source
    print(skeleton.load(store, source, fingerprint.full(HttpEmbedder(e.base, "", e.model, e.dimensions).fingerprint(), *config.text())))
    return 0


def _search(args, config, spark, store) -> int:
    print(table(_tools(config, spark, store).search_issues(args.query, args.repos or None, args.state, args.labels or None, args.top_k, "cli-search")))
    return 0


def _eval(args, config, spark, store) -> int:
    part = config.evaluation()
    now = datetime.now(timezone.utc).replace(tzinfo=None)
    given = anchors_of(open(args.anchors).read()) if args.anchors else []
    anchors = spark.createDataFrame(given, "query string, repo string, number long, expected_grade int")
    queries = evaluate.queries_of(querylog.recent_queries(store.table("query_log"), args.days or part["days"], now), anchors)
    judge, tools = HttpJudge(part["base_url"] or "", part["api_key"] or "", part["model"] or ""), _tools(config, spark, store)
    rows = []
    for q in (r.query for r in queries.toLocalIterator()):
        for rank, hit in enumerate(tools.search_issues(q, top_k=part["top_k"], tool="eval"), 1):
            rows.append((q, rank, hit["repo"], hit["number"], judge.grade(q, hit["title"], hit["snippet"])[0]))
    report = evaluate.run(spark.createDataFrame(rows, "query string, rank int, repo string, number long, grade int"), anchors) | {"judge_model": part["model"]}
    path = config.home / f"eval-{now.date().isoformat()}.json"
    path.write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str))
    print(json.dumps(report["scores"], indent=2))
    return 0 if report["valid"] else 2


COMMANDS = {"sync": _sync, "status": _status, "report": _report, "doctor": _doctor, "export": _export, "fetch": _fetch, "search": _search, "eval": _eval}

if __name__ == "__main__":
    sys.exit(main())
