"""Schemas of the tables, as DDL."""

ISSUES = (
    "id LONG, repo STRING, number LONG, kind STRING, title STRING, body STRING, state STRING, labels ARRAY<STRING>, "
    "author STRING, comments_count LONG, created_at STRING, updated_at STRING, embedded_hash STRING"
)
VECTORS = "issue_id LONG, embedding ARRAY<FLOAT>"
COMMENTS = "issue_id LONG, idx LONG, author STRING, body STRING"
RELATIONS = "repo STRING, number LONG, kind STRING, target_repo STRING, target_number LONG"
SYNC_STATE = "repo STRING, cursor_updated_at STRING, last_sync_at TIMESTAMP"
MANIFEST = "key STRING, value STRING"
QUERY_LOG = "id LONG, ts TIMESTAMP, tool STRING, query STRING, filters STRING, results ARRAY<STRING>, follow_up STRING"
FOLLOW_UPS = "log_id LONG, follow_up STRING, at TIMESTAMP"
#: The text index: each place of a term with its document's length, the lengths, and the one row of statistics that scores need.
POSTINGS = "term STRING, id LONG, field STRING, pos INT, dl LONG"
LENGTHS = "id LONG, dl LONG"
TEXT_STATS = "n_docs LONG, total LONG"
RAW_ISSUE = (
    "number LONG, kind STRING, title STRING, body STRING, state STRING, labels ARRAY<STRING>, comments_count LONG, "
    "author STRING, created_at STRING, updated_at STRING"
)
RAW_COMMENT = "id LONG, issue_number LONG, author STRING, body STRING, created_at STRING"
ISSUE_PAGE = (
    "ARRAY<STRUCT<id: LONG, number: LONG, title: STRING, body: STRING, state: STRING, labels: ARRAY<STRUCT<name: STRING>>, "
    "comments: LONG, created_at: STRING, user: STRUCT<login: STRING>, updated_at: STRING, pull_request: STRUCT<url: STRING>>>"
)
COMMENT_PAGE = "ARRAY<STRUCT<id: LONG, user: STRUCT<login: STRING>, body: STRING, issue_url: STRING, created_at: STRING>>"
#: Tables of a snapshot, with their schemas.
TABLES = {
    "issues": ISSUES,
    "issues_vec": VECTORS,
    "issue_comments": COMMENTS,
    "relations": RELATIONS,
    "sync_state": SYNC_STATE,
    "manifest": MANIFEST,
    "query_log": QUERY_LOG,
    "follow_ups": FOLLOW_UPS,
    "postings": POSTINGS,
    "lengths": LENGTHS,
    "text_stats": TEXT_STATS,
}
#: What folders of tables that only grow begin with.
APPENDED = "appended"
