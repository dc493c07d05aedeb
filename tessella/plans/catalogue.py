"""All queries of the engine's own operators, by name, with their oracle SQL.

Scores are rounded to six places before they are ranked, so that both engines break ties alike;
the library's operators rank unrounded scores unless told otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vector import decode_f32, dot, encode_f32, l2_normalise
from ..operators import bm25, context, duplicates, evaluate, index, querylog, relations, retrieve
from ..operators import vectors as V
from ..operators.filters import SearchFilter
from ..session import scratch
from ..sources import github, raw
from . import tables as R

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TERM, TITLE, DECIMALS = "ndon", "The onthe ndon", 6

#: The documents in the issues' role, as R.issues() has them.
ISSUES_SQL = """issues AS (
  SELECT doc_id AS id, source AS repo, doc_id AS number, CASE WHEN doc_id % 5 = 0 THEN 'pr' ELSE 'issue' END AS kind,
         split_part(text, chr(10), 1) AS title, text AS body, CASE WHEN lang = 'en' THEN 'open' ELSE 'closed' END AS state,
         [lang, source] AS labels, 'user' || (doc_id % 7) AS author, doc_id % 3 AS comments_count, '2024-01-01T00:00:00Z' AS created_at,
         '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS updated_at, lang, source
  FROM documents)"""
#: The tokens of a text: the diacritics are those of the tables.
TOKENS_SQL = "regexp_extract_all(translate(lower({}), 'éóèñüçäöêí', 'eoenucaoei'), '[\\p{{L}}\\p{{N}}]+')"
SNIPPET_SQL = "substring(regexp_replace(body, '^\\s+|\\s+$', '', 'g'), 1, 200)"


def query(oracle: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return add


def _vec_sql(where: str = "TRUE", top: int = 30, qid: int = 0) -> str:
    return f"""q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = {qid}),
vec AS (
  SELECT id, sim, row_number() OVER (ORDER BY sim DESC, id) AS rank FROM (
    SELECT i.id, round(list_dot_product(e.embedding::DOUBLE[], q.qv), 6) AS sim FROM issues i JOIN embeddings e ON e.vec_id = i.id, q WHERE {where}
  ) ORDER BY sim DESC, id LIMIT {top})"""


def _bm25_sql(terms: list[str], where: str = "TRUE", top: int = 30) -> str:
    """For queries of plain one-token words."""
    wanted = ", ".join(f"({k}, '{t}')" for k, t in enumerate(terms))
    return f"""toks AS (SELECT id, {TOKENS_SQL.format("title")} AS a, {TOKENS_SQL.format("body")} AS b FROM issues),
lens AS (SELECT id, len(a) + len(b) AS dl FROM toks),
stats AS (SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM lens),
words AS (SELECT id, unnest(list_concat(a, b)) AS term FROM toks),
wanted(phrase, term) AS (VALUES {wanted}),
tf AS (SELECT phrase, id, count(*) AS f FROM words JOIN wanted USING (term) GROUP BY phrase, id),
df AS (SELECT phrase, count(*) AS d FROM tf GROUP BY phrase),
idf AS (SELECT phrase, CASE WHEN ln((n - d + 0.5) / (d + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d + 0.5) / (d + 0.5)) END AS w FROM df, stats),
scored AS (
  SELECT tf.id, round(-sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM tf JOIN idf USING (phrase) JOIN lens ON lens.id = tf.id, stats
  GROUP BY tf.id HAVING count(*) = {len(terms)}),
fts AS (SELECT s.id, bm25, row_number() OVER (ORDER BY bm25, s.id) AS rank FROM scored s JOIN issues i ON i.id = s.id WHERE {where} ORDER BY bm25, s.id LIMIT {top})"""


_FUSED_SQL = """fused AS (
  SELECT coalesce(vec.id, fts.id) AS id, coalesce(1.0::DOUBLE / (60 + vec.rank), 0) + coalesce(1.0::DOUBLE / (60 + fts.rank), 0) AS score,
         CASE WHEN vec.id IS NOT NULL AND fts.id IS NOT NULL THEN 'vec+fts' WHEN vec.id IS NOT NULL THEN 'vec' ELSE 'fts' END AS source
  FROM vec FULL JOIN fts ON vec.id = fts.id)"""


def _hybrid_sql(where: str, terms: list[str], top: int) -> str:
    return f"""WITH {ISSUES_SQL}, {_vec_sql(where)}, {_bm25_sql(terms, where)}, {_FUSED_SQL},
top AS (SELECT * FROM fused ORDER BY score DESC, id LIMIT {top})
SELECT i.id, repo, number, kind, title, state, {SNIPPET_SQL} AS snippet, round(score, 9) AS score, top.source FROM top JOIN issues i ON i.id = top.id"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 9))


@query(_hybrid_sql("TRUE", [TERM], 10))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    return _rounded(retrieve.hybrid_search(issues, R.vectors(spark, sf_dir), R.text_index(spark, sf_dir), R.query_vector(spark, sf_dir), TERM, top_k=10, decimals=DECIMALS))


FILTER = SearchFilter(repos=["src0", "src1", "src2", "src3"], state="open", labels=["EN"])


@query(_hybrid_sql("i.repo IN ('src0', 'src1', 'src2', 'src3') AND i.state = 'open' AND list_contains(list_transform(i.labels, lambda x: lower(x)), 'en')", [TERM], 10))
def hybrid_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    return _rounded(retrieve.hybrid_search(issues, R.vectors(spark, sf_dir), R.text_index(spark, sf_dir), R.query_vector(spark, sf_dir), TERM, FILTER, 10, decimals=DECIMALS))


@query(_hybrid_sql("FALSE", [TERM], 10))
def hybrid_no_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty list of repositories matches nothing."""
    issues = R.issues(spark, sf_dir)
    return _rounded(retrieve.hybrid_search(issues, R.vectors(spark, sf_dir), R.text_index(spark, sf_dir), R.query_vector(spark, sf_dir), TERM, SearchFilter(repos=[]), 10, decimals=DECIMALS))


@query(f"WITH {ISSUES_SQL}, {_vec_sql(top=20)} SELECT id, sim, rank::INT AS rank FROM vec")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(V.candidates(R.issues(spark, sf_dir), R.vectors(spark, sf_dir)), R.query_vector(spark, sf_dir), 20, DECIMALS)


@query(
    f"""WITH {ISSUES_SQL}, qs AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0),
near AS (SELECT qid, i.id, round(list_dot_product(e.embedding::DOUBLE[], qv), 6) AS sim FROM issues i JOIN embeddings e ON e.vec_id = i.id, qs)
SELECT qid, id, sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM near) WHERE rank <= 5"""
)
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    cands = V.candidates(R.issues(spark, sf_dir), R.vectors(spark, sf_dir))
    qs = R.vectors(spark, sf_dir).where("issue_id % 50 = 0").select(F.col("issue_id").alias("qid"), "embedding")
    return V.top_k_batch(cands, qs, 5, DECIMALS)


@query(f"WITH {ISSUES_SQL}, {_bm25_sql([TERM], top=25)} SELECT id, bm25 FROM fts")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    return bm25.search(R.text_index(spark, sf_dir), issues, TERM, 25, decimals=DECIMALS)


@query(f"WITH {ISSUES_SQL}, {_bm25_sql(['the', 'ndon', 'ndon'], top=25)} SELECT id, bm25 FROM fts")
def bm25_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word must be there, and a repeated one counts again."""
    issues = R.issues(spark, sf_dir)
    return bm25.search(R.text_index(spark, sf_dir), issues, "the ndon NDON", 25, decimals=DECIMALS)


@query(
    f"""WITH {ISSUES_SQL},
words AS (
  SELECT id, field, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (
    SELECT id, 't' AS field, {TOKENS_SQL.format("title")} AS w FROM issues UNION ALL SELECT id, 'b', {TOKENS_SQL.format("body")} FROM issues)),
pairs AS (SELECT id, count(*) AS f FROM (SELECT id, term, lead(term) OVER (PARTITION BY id, field ORDER BY pos) AS after FROM words) WHERE term = 'of' AND after = 'the' GROUP BY id)
SELECT id, f FROM pairs"""
)
def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined words are a phrase, within one field."""
    return bm25.matches(R.text_index(spark, sf_dir), "of-the").select("id", "f")


@query(
    f"""WITH {ISSUES_SQL}, {_vec_sql("i.id <> 3", 10, 3)}
SELECT i.id, repo, number, title, vec.sim AS score FROM vec JOIN issues i ON i.id = vec.id"""
)
def find_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    repo = issues.where("id = 3").select("repo").first()[0]
    return retrieve.find_related(issues, R.vectors(spark, sf_dir), repo, 3, 10, decimals=DECIMALS)


@query(
    f"""WITH {ISSUES_SQL}, {_vec_sql()}, {_bm25_sql(["of", "the"])}, {_FUSED_SQL},
pool AS (SELECT f.*, i.repo, i.number, i.kind, i.title, i.state FROM fused f JOIN issues i ON i.id = f.id ORDER BY f.score DESC, f.id LIMIT 15),
cut AS (SELECT *, list_filter(regexp_split_to_array(lower(title), '\\s+'), lambda x: x <> '') AS ta, ['of', 'the'] AS tb FROM pool),
judged AS (
  SELECT *, CASE WHEN len(ta) = 0 THEN 0 ELSE round(2.0::DOUBLE * list_sum(list_transform(tb, lambda t: least(1, len(list_filter(ta, lambda x: x = t))))) / (len(ta) + 2), 6) END AS title_sim FROM cut)
SELECT id, repo, number, kind, title, state, round(score, 9) AS score, title_sim, source FROM judged
WHERE score + 0.3 * (2.0::DOUBLE / 61) * title_sim >= 0.6 * (2.0::DOUBLE / 61)
ORDER BY score + 0.3 * (2.0::DOUBLE / 61) * title_sim DESC, score DESC, id LIMIT 5"""
)
def check_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    return _rounded(duplicates.check_duplicate(issues, R.vectors(spark, sf_dir), R.text_index(spark, sf_dir), R.query_vector(spark, sf_dir), "of the", decimals=DECIMALS))


@query(
    """WITH t AS (SELECT p_partkey, lower(p_name) AS a, lag(lower(p_name)) OVER (ORDER BY p_partkey) AS b FROM part),
s AS (SELECT p_partkey, list_filter(regexp_split_to_array(trim(a), '\\s+'), lambda x: x <> '') AS ta, list_filter(regexp_split_to_array(trim(b), '\\s+'), lambda x: x <> '') AS tb FROM t WHERE b IS NOT NULL)
SELECT p_partkey, round(2.0::DOUBLE * coalesce(list_sum(list_transform(list_distinct(ta), lambda t: least(len(list_filter(ta, lambda x: x = t)), len(list_filter(tb, lambda x: x = t))))), 0) / (len(ta) + len(tb)), 9) AS title_sim FROM s"""
)
def title_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = R.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    before = part.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return part.join(before, "p_partkey").select("p_partkey", F.round(T.title_similarity(F.col("p_name"), F.col("before")), 9).alias("title_sim"))


@query(
    """WITH vr AS (SELECT qid, id, rank FROM (
  SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 30),
lr AS (SELECT q.vec_id AS qid, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) AS rank FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q ON e.label = q.label),
part AS (SELECT qid, id, 1.0::DOUBLE / (60 + rank) AS s FROM vr UNION ALL SELECT qid, id, 1.0::DOUBLE / (60 + rank) FROM lr WHERE rank <= 30)
SELECT qid, id, round(score, 9) AS score, rank::INT AS rank FROM (SELECT qid, id, sum(s) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(sum(s), 9) DESC, id) AS rank FROM part GROUP BY qid, id) WHERE rank <= 10"""
)
def rrf_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked legs a query, fused: nearest vectors, and vectors of the query's label."""
    from pyspark.sql import Window

    emb = R.read(spark, sf_dir, "embeddings")
    qs = emb.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding", "label")
    near = V.top_k_batch(emb.select(F.col("vec_id").alias("id"), "embedding"), qs.select("qid", "embedding"), 30, DECIMALS).select("qid", "id", "rank")
    first = emb.select(F.col("vec_id").alias("id"), "label").withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("rank <= 30")
    by_label = first.join(qs.select("qid", "label"), "label").select("qid", "id", "rank")
    fused = near.unionByName(by_label).groupBy("qid", "id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))).where("rank <= 10")


@query("SELECT source AS repo, count(*) AS issues, '-' AS last_sync FROM documents WHERE source <> 'src1' GROUP BY source UNION ALL SELECT source, count(*), '2024-01-31 00:00:00' FROM documents WHERE source = 'src1' GROUP BY source")
def repo_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = spark.createDataFrame([("src1", R.NOW)], "repo string, at string").select("repo", F.lit("").alias("cursor_updated_at"), F.col("at").cast("timestamp").alias("last_sync_at"))
    return querylog.repo_stats(R.issues(spark, sf_dir), state)


@query(f"WITH {ISSUES_SQL} SELECT repo, label, count(*) AS n FROM (SELECT repo, unnest(labels) AS label FROM issues) GROUP BY repo, label")
def label_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.label_facets(R.issues(spark, sf_dir))


@query(
    f"""WITH {ISSUES_SQL}, f AS (SELECT repo, label, count(*) AS n FROM (SELECT repo, unnest(labels) AS label FROM issues) GROUP BY repo, label)
SELECT repo, sum(CASE WHEN label = repo THEN n END)::BIGINT AS issues, string_agg(label || ':' || n, ',' ORDER BY n DESC, label) AS labels FROM f GROUP BY repo"""
)
def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = spark.createDataFrame([], "repo string, cursor_updated_at string, last_sync_at timestamp")
    out = querylog.list_repos(R.issues(spark, sf_dir), state)
    return out.select("repo", "issues", F.array_join(F.transform("labels", lambda x: F.concat(x["name"], F.lit(":"), x["count"])), ",").alias("labels"))


_LOG_SQL = f"""log AS (SELECT event_id AS id, ts, CASE WHEN event_type = 'click' THEN 'search_issues' ELSE event_type END AS tool, props AS query,
  'r#' || user_id AS result, CASE WHEN value > 150 THEN 'r#' || user_id END AS follow_up FROM events),
part AS (SELECT * FROM log WHERE ts >= TIMESTAMP '{R.NOW}' - INTERVAL 10 DAY)"""


@query(f"WITH {_LOG_SQL} SELECT count(*) AS total, count(DISTINCT query) AS unique_queries, count(follow_up) AS follow_ups, CASE WHEN count(*) > 0 THEN count(follow_up)::DOUBLE / count(*) ELSE 0 END AS follow_up_rate FROM part")
def query_report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.report(R.log(spark, sf_dir), 10, R.NOW).totals


@query(f"WITH {_LOG_SQL} SELECT query, count(*) AS n FROM part GROUP BY query ORDER BY n DESC, query LIMIT 10")
def query_report_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.report(R.log(spark, sf_dir), 10, R.NOW).top


@query(f"WITH {_LOG_SQL} SELECT coalesce(tool, '-') AS tool, count(*) AS n FROM part GROUP BY 1")
def query_report_by_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.report(R.log(spark, sf_dir), 10, R.NOW).by_tool


@query(f"WITH {_LOG_SQL} SELECT DISTINCT query FROM part WHERE tool = 'search_issues'")
def recent_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.recent_queries(R.log(spark, sf_dir), 10, R.NOW)


@query(
    f"""WITH {_LOG_SQL}, tgt AS (SELECT min(result) AS t FROM log WHERE tool = 'search_issues'),
latest AS (SELECT max(id) AS m FROM log, tgt WHERE tool = 'search_issues' AND result = t)
SELECT id, CASE WHEN id = m THEN t ELSE follow_up END AS follow_up FROM log, tgt, latest"""
)
def mark_follow_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = R.log(spark, sf_dir)
    target = log.where("tool = 'search_issues'").agg(F.min(F.element_at("results", 1))).first()[0]
    return querylog.mark_follow_up(log, target).select("id", "follow_up")


@query("SELECT conv_id AS issue_id, count(*) AS n, string_agg(CASE WHEN role = 'system' THEN 'helper[bot]' ELSE role END || ': ' || text, chr(10) ORDER BY turn) AS talk FROM conversations GROUP BY conv_id")
def comment_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = context.gathered(R.comments(spark, sf_dir))
    return got.select("issue_id", F.size("comments").cast("long").alias("n"), F.array_join(F.transform("comments", lambda c: F.concat(c["author"], F.lit(": "), c["body"])), "\n").alias("talk"))


@query(
    f"""WITH RECURSIVE {ISSUES_SQL},
lines AS (SELECT conv_id AS id, '- ' || CASE WHEN role = 'system' THEN 'helper[bot]' ELSE role END || ' ' || substring(text, 1, 500) || chr(10) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
sized AS (SELECT id, line, k, coalesce(sum(length(line)) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines),
talk AS (SELECT id, string_agg(line, '' ORDER BY k) AS comments FROM sized WHERE before <= 4000 GROUP BY id)
SELECT repo, number, title, state, array_to_string(labels, ',') AS labels, comments_count, updated_at, substring(body, 1, 8000) AS body, coalesce(comments, '') AS comments
FROM issues LEFT JOIN talk USING (id)"""
)
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.pack(R.issues(spark, sf_dir), R.comments(spark, sf_dir)).withColumn("labels", F.array_join("labels", ","))


@query("SELECT doc_id AS id, sha1(repeat(regexp_replace(split_part(text, chr(10), 1), '^\\s+|\\s+$', '', 'g') || chr(10), 2) || substring(text, 1, 2000)) AS hash FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables without images: their stripping changes nothing here."""
    none = F.array().cast("array<struct<author:string,body:string>>")
    return R.issues(spark, sf_dir).select("id", T.text_hash(F.col("title"), F.col("body"), none).alias("hash"))


@query(
    f"""WITH {ISSUES_SQL},
lines AS (SELECT conv_id AS id, turn, '- ' || role || ' ' || substring(text, 1, 500) || chr(10) AS line FROM conversations WHERE role <> 'system'),
talk AS (SELECT id, substring(string_agg(line, '' ORDER BY turn), 1, 3000) AS said FROM lines GROUP BY id)
SELECT id, sha1(repeat(regexp_replace(title, '^\\s+|\\s+$', '', 'g') || chr(10), 2) || substring(body, 1, 2000) || CASE WHEN said IS NULL THEN '' ELSE chr(10) || chr(10) || '[讨论]' || chr(10) || said END) AS hash
FROM issues LEFT JOIN talk USING (id)"""
)
def text_hash_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = context.with_comments(R.issues(spark, sf_dir), R.comments(spark, sf_dir))
    return both.select("id", T.text_hash(F.col("title"), F.col("body"), F.col("comments")).alias("hash"))


@query("SELECT event_id, user_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def raw_merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.latest(R.read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "event_id")


def _hashed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored issues whose hash is known for ids not divisible by three, and their current hashes."""
    none = F.array().cast("array<struct<author:string,body:string>>")
    now = R.issues(spark, sf_dir).withColumn("hash", T.text_hash(F.col("title"), F.col("body"), none))
    return now.withColumn("embedded_hash", F.when(F.col("id") % 3 != 0, F.col("hash"))), now.select("repo", "number", "hash")


@query(f"WITH {ISSUES_SQL} SELECT repo, number, CASE WHEN id % 3 <> 0 AND vec_id IS NOT NULL THEN 'skip' ELSE 'embed' END AS action FROM issues LEFT JOIN embeddings ON vec_id = id")
def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, hashed = _hashed(spark, sf_dir)
    return index.decide(hashed, old, R.vectors(spark, sf_dir)).select("repo", "number", "action")


@query(
    f"""WITH {ISSUES_SQL}, old AS (SELECT * FROM issues WHERE id % 2 = 0), new AS (SELECT repo, number, 'new ' || kind AS title FROM issues WHERE id % 3 = 0),
fresh AS (SELECT repo, number, row_number() OVER (ORDER BY repo, number) + (SELECT max(id) FROM old) AS id FROM new WHERE (repo, number) NOT IN (SELECT (repo, number) FROM old))
SELECT coalesce(o.id, f.id) AS id, coalesce(o.repo, n.repo) AS repo, coalesce(o.number, n.number) AS number, coalesce(n.title, o.title) AS title, o.state
FROM old o FULL JOIN new n ON o.repo = n.repo AND o.number = n.number LEFT JOIN fresh f ON f.repo = n.repo AND f.number = n.number"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the issues are stored; a third comes anew, with another title."""
    issues = R.issues(spark, sf_dir)
    new = issues.where("id % 3 = 0").select("repo", "number", F.concat(F.lit("new "), "kind").alias("title"))
    return index.upsert(issues.where("id % 2 = 0"), new).select("id", "repo", "number", "title", "state")


def _mentioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues whose whole texts end with mentions of two others; the tables' texts have none of their own."""
    tail = F.concat(F.lit("This fixes #"), F.col("number") % 50, F.lit("\nsee org/lib#"), F.col("number") % 7, F.lit(" too"))
    return R.issues(spark, sf_dir).select("repo", "number", "title", F.concat("body", F.lit("\n"), tail).alias("body"))


_EDGES_SQL = f"""{ISSUES_SQL}, edges AS (
  SELECT repo, number, 'fixes' AS kind, repo AS target_repo, number % 50 AS target_number FROM issues WHERE number % 50 <> number
  UNION ALL SELECT repo, number, 'refs', 'org/lib', number % 7 FROM issues)"""


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges")
def relations_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.extract(_mentioning(spark, sf_dir))


@query(f"WITH {_EDGES_SQL} SELECT repo, number, kind FROM edges WHERE target_repo = 'org/lib' AND target_number = 3")
def relations_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.reverse(relations.extract(_mentioning(spark, sf_dir)), "org/lib", 3).select("repo", "number", "kind")


@query(
    f"""WITH {_EDGES_SQL}, fwd AS (SELECT repo, number, string_agg(target_repo || '#' || target_number, ',') FILTER (kind = 'fixes') AS fixes, string_agg(target_repo || '#' || target_number, ',') FILTER (kind = 'refs') AS refs FROM edges GROUP BY repo, number),
back AS (SELECT target_repo AS repo, target_number AS number, string_agg(repo || '#' || number, ',' ORDER BY repo || '#' || number) AS fixed_by FROM edges WHERE kind = 'fixes' GROUP BY 1, 2)
SELECT i.repo, i.number, coalesce(fixes, '') AS fixes, '' AS closes, coalesce(refs, '') AS refs, coalesce(fixed_by, '') AS fixed_by
FROM issues i LEFT JOIN fwd f ON f.repo = i.repo AND f.number = i.number LEFT JOIN back b ON b.repo = i.repo AND b.number = i.number"""
)
def relations_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = _mentioning(spark, sf_dir)
    out = relations.payload(relations.extract(issues), issues)
    return out.select("repo", "number", *[F.array_join(c, ",").alias(c) for c in ("fixes", "closes", "refs", "fixed_by")])


@query("SELECT page_id, html || ' see [图片] and [图片] end' AS body FROM pages")
def strip_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, which have no images of their own, with two at the end."""
    body = F.concat("html", F.lit(" see ![shot]("), F.col("url"), F.lit(") and https://h/i"), F.col("page_id"), F.lit(".PNG?x=1 end"))
    return R.read(spark, sf_dir, "pages").select("page_id", T.strip_image_links(body).alias("body"))


@query("SELECT doc_id AS id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') || ' 导出 CSV 中文 文乱 乱码 ' || doc_id AS text FROM documents")
def cjk_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issues(spark, sf_dir).select("id", T.cjk_bigram(F.concat("body", F.lit("导出 CSV 中文乱码"), F.col("id"))).alias("text"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y))))), 9) AS total FROM v"""
)
def embedding_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = R.read(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("e"))
    return scaled.select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = R.read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return emb.join(other, "vec_id").select("vec_id", F.round(dot(F.col("embedding"), F.col("other")), 6).alias("sim"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking for each source: all its labelled documents by id, graded by their labels."""
    from pyspark.sql import Window

    both = R.read(spark, sf_dir, "labels").join(R.read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))
    return ranked.select(F.col("source").alias("query"), "rank", F.col("source").alias("repo"), F.col("doc_id").alias("number"), (F.col("quality") * (2 - F.col("toxic")) * (F.col("doc_id") % 3 > 0).cast("int")).alias("grade"))


_GRADED_SQL = """graded AS (SELECT source AS query, rank, doc_id, quality * (2 - toxic) * (CASE WHEN doc_id % 3 > 0 THEN 1 ELSE 0 END) AS grade FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM labels JOIN documents USING (doc_id)))"""
_METRICS_SQL = f"""{_GRADED_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, rank) AS b FROM graded),
sums AS (SELECT query, sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 5 THEN (2 ** grade - 1) / log2(b + 1) ELSE 0 END) AS ideal,
  min(CASE WHEN rank <= 5 AND grade > 0 THEN rank END) AS first, count(CASE WHEN rank <= 5 AND grade > 0 THEN 1 END) AS found, count(CASE WHEN grade > 0 THEN 1 END) AS rel FROM best GROUP BY query),
metrics AS (SELECT query, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg5, coalesce(1.0::DOUBLE / first, 0) AS mrr, CASE WHEN found > 0 THEN 1.0::DOUBLE ELSE 0 END AS hit5,
  CASE WHEN rel > 0 THEN found::DOUBLE / rel ELSE 0 END AS recall5, rel AS n_relevant FROM sums)"""


@query(f"WITH {_METRICS_SQL} SELECT query, round(ndcg5, 9) AS ndcg5, round(mrr, 9) AS mrr, hit5, round(recall5, 9) AS recall5, n_relevant FROM metrics")
def eval_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.per_query(_graded(spark, sf_dir))
    return out.select("query", F.round("ndcg5", 9).alias("ndcg5"), F.round("mrr", 9).alias("mrr"), "hit5", F.round("recall5", 9).alias("recall5"), "n_relevant")


@query(f"WITH {_METRICS_SQL} SELECT count(*) AS n_queries, round(avg(ndcg5), 6) AS ndcg5, round(avg(mrr), 6) AS mrr, round(avg(hit5), 6) AS hit5, round(coalesce(avg(CASE WHEN n_relevant > 0 THEN recall5 END), 0), 6) AS recall5 FROM metrics")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluate.summary(evaluate.per_query(_graded(spark, sf_dir)))
    return out.select("n_queries", *[F.round(c, 6).alias(c) for c in ("ndcg5", "mrr", "hit5", "recall5")])


@query(
    f"""WITH {_GRADED_SQL}, pairs AS (SELECT *, (doc_id % 3)::INT AS expected FROM graded)
SELECT count(*) AS n_anchors, count(CASE WHEN grade <> expected THEN 1 END) AS n_wrong, CASE WHEN count(*) > 0 THEN count(CASE WHEN grade <> expected THEN 1 END)::DOUBLE / count(*) ELSE 0 END AS drift,
  CASE WHEN count(*) > 0 THEN count(CASE WHEN grade <> expected THEN 1 END)::DOUBLE / count(*) ELSE 0 END <= 0.2 AS valid FROM pairs"""
)
def anchor_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = _graded(spark, sf_dir)
    anchors = graded.select("query", "repo", "number", (F.col("number") % 3).cast("int").alias("expected_grade"))
    return evaluate.drift(graded, anchors).drop("samples")


@query(
    f"""WITH {_GRADED_SQL}, n AS (SELECT count(*) AS c FROM graded), ord AS (SELECT *, row_number() OVER (ORDER BY query, rank) - 1 AS place FROM graded)
SELECT query, rank, doc_id AS number FROM ord, n WHERE place % greatest(1, c // least(20, c)) = 0 AND place < 20 * greatest(1, c // least(20, c))"""
)
def sample_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return querylog.evenly(_graded(spark, sf_dir), 20, "query", "rank").select("query", "rank", "number")


@query("SELECT doc_id AS id, e.vec_id IS NOT NULL AS has_vec FROM documents LEFT JOIN embeddings e ON e.vec_id = doc_id")
def exists_has_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.has_vector(R.issues(spark, sf_dir), R.vectors(spark, sf_dir)).select("id", "has_vec")


@query(f"WITH {ISSUES_SQL} SELECT id, repo, number, kind, title, author FROM issues WHERE id % 97 = 0")
def meta_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    return context.metas(issues, issues.where("id % 97 = 0").select("id")).select("id", "repo", "number", "kind", "title", "author")


@query("SELECT conv_id AS issue_id, turn AS idx, CASE WHEN role = 'system' THEN 'helper[bot]' ELSE role END AS author, text AS body FROM conversations WHERE conv_id = 3")
def comments_of_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.comments(spark, sf_dir).where("issue_id = 3").orderBy("idx")


@query("SELECT DISTINCT number FROM (SELECT doc_id AS number FROM documents UNION ALL SELECT conv_id FROM conversations)")
def touched_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.touched(R.issues(spark, sf_dir), R.comments(spark, sf_dir).withColumnRenamed("issue_id", "issue_number"))


@query(f"WITH {ISSUES_SQL} SELECT max(updated_at) AS cursor FROM issues WHERE updated_at >= '2024-01-05T00:00:00Z'")
def sync_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.issues(spark, sf_dir).where(F.col("updated_at") >= "2024-01-05T00:00:00Z").agg(F.max("updated_at").alias("cursor"))


@query(
    f"""WITH {ISSUES_SQL}
SELECT id, repo, kind, number, state, updated_at, '' AS title, '' AS body, 0::BIGINT AS comments_count, vec_id IS NOT NULL AS has_vec FROM issues LEFT JOIN embeddings ON vec_id = id"""
)
def skeleton_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import skeleton

    bare = skeleton.issues_without_text(R.issues(spark, sf_dir))
    flags = index.has_vector(bare, R.vectors(spark, sf_dir)).select("id", "has_vec")
    return bare.select("id", "repo", "kind", "number", "state", "updated_at", "title", "body", "comments_count").join(flags, "id")


@query(f"WITH {ISSUES_SQL} SELECT id, repo, number, title, state FROM issues WHERE number = 5 AND repo = (SELECT repo FROM issues WHERE id = 5)")
def issue_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    repo = issues.where("id = 5").select("repo").first()[0]
    return context.issue(issues, repo, 5).select("id", "repo", "number", "title", "state")


@query(f"WITH {ISSUES_SQL} SELECT 'r/t' AS repo, number, kind, title, md5(body) AS body_md5, state, array_to_string(labels, ',') AS labels, author, comments_count, created_at, updated_at FROM issues")
def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues as pages of a hundred, read back."""
    row = F.struct(
        "id", "number", "title", "body", "state", F.transform("labels", lambda x: F.struct(x.alias("name"))).alias("labels"), F.col("comments_count").alias("comments"), "created_at", F.struct(F.col("author").alias("login")).alias("user"),
        "updated_at", F.when(F.col("kind") == "pr", F.struct(F.lit("u").alias("url"))).alias("pull_request"),
    )
    pages = R.issues(spark, sf_dir).groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.to_json(F.collect_list(row)).alias("json")).select(F.lit("r/t").alias("repo"), "json")
    out = github.parse_issues(pages)
    return out.withColumn("labels", F.array_join("labels", ",")).withColumn("body_md5", F.md5(F.col("body").cast("binary"))).drop("body")


@query("SELECT conv_id * 1000 + turn AS id, conv_id AS issue_number, role AS author, text AS body, 'x' AS created_at FROM conversations WHERE trim(text) <> ''")
def comment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All comments as a page for each issue, read back."""
    row = F.struct((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.struct(F.col("role").alias("login")).alias("user"), F.col("text").alias("body"), F.concat(F.lit("https://h/repos/t/a/issues/"), "conv_id").alias("issue_url"), F.lit("x").alias("created_at"))
    pages = R.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(row)).alias("json"))
    return github.parse_comments(pages.select("json"))


@query(f"WITH {ISSUES_SQL}, said AS (SELECT conv_id AS number, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS talk FROM conversations GROUP BY conv_id) SELECT repo, number, kind, title, md5(body) AS body_md5, updated_at, coalesce(n, 0) AS n_comments, coalesce(talk, '') AS talk FROM (SELECT * REPLACE ('r/t' AS repo) FROM issues) LEFT JOIN said USING (number)")
def raw_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All issues and comments landed as compressed lines, merged, and loaded with their comments."""
    store = raw.RawStore(spark, scratch(spark, "raw"))
    store.merge_issues("r/t", raw.to_raw(R.issues(spark, sf_dir)))
    talk = R.read(spark, sf_dir, "conversations").select(F.col("turn").alias("id"), F.col("conv_id").alias("issue_number"), F.col("role").alias("author"), F.col("text").alias("body"), F.lit("").alias("created_at"))
    store.merge_comments("r/t", talk.withColumn("id", F.col("issue_number") * 1000 + F.col("id")))
    said = F.array_join(F.transform("comments", lambda c: F.concat(c["author"], F.lit(": "), c["body"])), "\n")
    return store.load("r/t").select("repo", "number", "kind", "title", F.md5(F.col("body").cast("binary")).alias("body_md5"), "updated_at", F.size("comments").cast("long").alias("n_comments"), said.alias("talk"))


@query(f"WITH {_EDGES_SQL} SELECT * FROM edges WHERE number % 3 <> 0")
def relations_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third issue is touched and has no mentions any more."""
    issues = _mentioning(spark, sf_dir)
    edges = relations.extract(issues)
    return relations.replace(edges, issues.where("number % 3 = 0"), edges.limit(0))


@query(f"WITH {ISSUES_SQL}, {_bm25_sql([TERM], top=10)} SELECT 7::BIGINT AS id, 'search_issues' AS tool, '{TERM}' AS query, string_agg(repo || '#' || number, ',' ORDER BY bm25, i.id) AS results FROM fts JOIN issues i ON i.id = fts.id")
def log_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = R.issues(spark, sf_dir)
    hits = bm25.search(R.text_index(spark, sf_dir), issues, TERM, 10, decimals=DECIMALS).join(issues.select("id", "repo", "number"), "id").withColumn("score", -F.col("bm25"))
    return querylog.entry(hits, 7, R.NOW, "search_issues", TERM, None).select("id", "tool", "query", F.array_join("results", ",").alias("results"))


@query("SELECT vec_id, len(embedding) * 4 AS n_bytes, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def blob_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as blobs of 32-bit floats and back."""
    blobs = R.read(spark, sf_dir, "embeddings").select("vec_id", encode_f32(F.col("embedding")).alias("blob"))
    back = blobs.select("vec_id", F.octet_length("blob").cast("long").alias("n_bytes"), decode_f32(F.col("blob")).alias("v"))
    return back.select("vec_id", "n_bytes", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 4 THEN doc_id END AS number FROM documents")
def number_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth address ends in no number."""
    url = F.concat(F.lit("https://h/repos/"), "repo", F.lit("/issues/"), F.col("number"), F.when(F.col("id") % 5 == 4, "x").otherwise(""))
    return R.issues(spark, sf_dir).select("id", github.issue_number(url).alias("number"))


@query(f"WITH {_LOG_SQL} SELECT DISTINCT query FROM (SELECT query FROM part WHERE tool = 'search_issues' UNION ALL SELECT text FROM benchmark)")
def evaluation_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = R.read(spark, sf_dir, "benchmark").select(F.col("text").alias("query"))
    return evaluate.queries_of(querylog.recent_queries(R.log(spark, sf_dir), 10, R.NOW), anchors)
