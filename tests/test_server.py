"""The protocol server over a tool double."""

import json

from tessella import server


class Double:
    def search_issues(self, query, top_k=5):
        return [{"query": query, "top_k": top_k}]

    def list_repos(self):
        raise RuntimeError("no index")


def ask(method, ident=1, **params):
    out = list(server.serve(Double(), [json.dumps({"jsonrpc": "2.0", "id": ident, "method": method, "params": params})]))
    return json.loads(out[0]) if out else None


def test_handshake_and_list():
    assert ask("initialize")["result"]["serverInfo"]["name"] == "tessella"
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search_issues", "get_issue_context", "find_related", "list_repos", "check_duplicate"]
    assert ask("notifications/initialized", None) is None
    assert ask("ping")["result"] == {}


def test_calls():
    got = ask("tools/call", name="search_issues", arguments={"query": "错误", "top_k": 3, "state": None, "odd": 1})["result"]
    assert json.loads(got["content"][0]["text"]) == [{"query": "错误", "top_k": 3}] and not got["isError"]
    assert ask("tools/call", name="search_issues", arguments={})["error"]["code"] == server.BAD_PARAMS
    assert ask("tools/call", name="nothing")["error"]["code"] == server.BAD_PARAMS
    failed = ask("tools/call", name="list_repos")["result"]
    assert failed["isError"] and failed["content"][0]["text"] == "no index"
    assert ask("odd")["error"]["code"] == server.NO_METHOD
    assert json.loads(next(server.serve(Double(), ["{broken"])))["error"]["code"] == server.PARSE_ERROR
