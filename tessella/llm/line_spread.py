"""Line deduplication by distinct-site spread.

A line is boilerplate where it stands on many distinct sites. What carries a line to a site must
not be a copy of a whole document, though: equal texts count at one site, the least of theirs, and
texts that consist for the greater part of widespread lines (near copies of one document do) don't
count at all. So sites are counted twice: once over all texts, which gives the widespread lines,
and then for these over the texts that have enough lines of their own.

Sites of each line hash are counted by HyperLogLog sketches, built before the shuffle and merged
by aggregation. Where an estimate is too near the threshold to be sure, the line's exact distinct
count decides. Boilerplate lines go from every document, copies included.

Aggregates are written before rows are joined with them, so that adaptive execution can split the
rows of a hot line or text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, written

#: A line is boilerplate from so many distinct sites on.
MIN_SITES = 5
#: A text with more than this share of its characters in widespread lines is a copy; repeated lines of a text count once.
MAX_SHARE = 2 / 3
LOG_K = 10
#: Estimates within this share of the threshold are counted exactly; a sketch's standard error at LOG_K is 3.25 %.
NEAR = 0.15
LINE, TEXT = ["h1", "h2"], ["t1", "t2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(value: Column, a: str, b: str) -> list[Column]:
    """128 bits of a value."""
    return [F.xxhash64(value).alias(a), F.xxhash64(F.lit(7), value).alias(b)]


def _key(line: Column) -> Column:
    """A line's hash, without the spaces around it."""
    return F.struct(*_hashes(F.trim(line), *LINE))


def texts(docs: DataFrame) -> DataFrame:
    """A row for each document with a line: t1, t2 (the text's hash), site, lines (h1, h2 and length of each distinct one), chars (their sum).

    Equal texts have one site.
    """
    line = F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), lambda x: F.struct(*_hashes(F.trim(x), *LINE), F.length(F.trim(x)).alias("n")))
    keyed = docs.select(*_hashes(F.col("text"), *TEXT), F.coalesce("source", F.lit("")).alias("site"), F.array_distinct(line).alias("lines")).where(F.size("lines") > 0)
    keyed = written(keyed.withColumn("chars", F.aggregate("lines", F.lit(0), lambda n, x: n + x["n"])), "texts")
    copied = written(keyed.groupBy(*TEXT).agg(F.min("site").alias("first"), F.max("site").alias("last")).where("first <> last").drop("last"), "copied-texts")
    return keyed.join(copied, TEXT, "left").withColumn("site", F.coalesce("first", "site")).drop("first")


def widespread(rows: DataFrame, min_sites: int) -> DataFrame:
    """The lines (h1, h2) of ``rows`` (h1, h2, site) that stand on enough distinct sites, with n_sites: an estimate where it is far from the threshold, else exact."""
    sketched = written(rows.groupBy(*LINE).agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_K)).alias("n_sites")).where(F.col("n_sites") >= min_sites * (1 - NEAR)), "line-sketches")
    sure = F.col("n_sites") > min_sites * (1 + NEAR)
    doubtful = written(rows.join(sketched.where(~sure).select(*LINE), LINE).select(*LINE, "site").distinct(), "doubtful-lines")  # distinct rows first, so that a frequent line is spread over many tasks
    exact = doubtful.groupBy(*LINE).agg(F.count("*").alias("n_sites")).where(F.col("n_sites") >= min_sites)
    return written(sketched.where(sure).unionByName(exact), "widespread-lines")


def boilerplate(sited: DataFrame, min_sites: int = MIN_SITES, max_share: float = MAX_SHARE) -> tuple[DataFrame, DataFrame]:
    """The hashes of boilerplate lines (h1, h2, n_sites), and the texts' rows of widespread lines (t1, t2, h1, h2, and others).

    ``sited`` as from texts(). Lines that occur less often than the threshold have no sketch:
    distinct counts can't exceed occurrences.
    """
    rows = sited.select(*TEXT, "site", "chars", F.explode("lines").alias("line")).select(*TEXT, "site", "chars", "line.*")
    often = written(rows.groupBy(*LINE).agg(F.count("*").alias("times")).where(F.col("times") >= min_sites).select(*LINE), "often")
    frequent = written(rows.join(often, LINE), "frequent-lines")
    spread = written(frequent.join(widespread(frequent, min_sites).select(*LINE), LINE), "spread-lines")
    shared = spread.select(*TEXT, "chars", *LINE, "n").distinct().groupBy(*TEXT, "chars").agg(F.sum("n").alias("shared"))
    copies = written(shared.where(F.col("shared") > max_share * F.col("chars")).select(*TEXT), "copies")
    own = written(spread.join(copies, TEXT, "left_anti"), "own-lines")
    return widespread(own, min_sites), spread


def dedup_lines(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with boilerplate lines taken out of text, and n_lines, n_removed added.

    ``docs`` needs text and source (null: one site of its own). Lines are compared without the
    spaces around them; blank lines are never boilerplate. Null texts stay null; an empty table
    gives an empty one. Equal texts lose the same lines; further columns pass as they are, except
    that columns named like an added one are replaced.
    """
    bad, spread = boilerplate(texts(docs), **thresholds)
    hits = spread.join(bad.select(*LINE), LINE).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.struct(*LINE).alias("h")).distinct()
    hits = written(hits.groupBy("_t1", "_t2").agg(F.collect_list("h").alias("_hits")), "hits")  # at most a text's own lines
    keep = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains("_hits", _key(x)))
    n_lines = F.size(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""))
    n_left = F.size(F.filter(keep, lambda x: F.trim(x) != ""))
    t1, t2 = _hashes(F.col("text"), "t1", "t2")
    joined = docs.drop("n_lines", "n_removed").join(hits, (t1 == F.col("_t1")) & (t2 == F.col("_t2")), "left")
    return (
        joined.withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_removed", F.when(F.col("_hits").isNull(), 0).otherwise(F.col("n_lines") - n_left).cast("long"))
        .withColumn("text", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(F.array_join(keep, "\n")))
        .drop("_hits", "_t1", "_t2")
    )


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars_left"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


ORACLE_SQL = f"""
WITH parts AS (
  SELECT doc_id, text, u.line, trim(u.line, ' ') AS plain, u.pos
  FROM documents, LATERAL (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos) u
),
sited AS (SELECT text, min(coalesce(source, '')) AS site FROM documents WHERE text IS NOT NULL GROUP BY text),
own AS (SELECT DISTINCT text, plain FROM parts WHERE plain <> ''),
spread AS (SELECT plain FROM own JOIN sited USING (text) GROUP BY plain HAVING count(DISTINCT site) >= {MIN_SITES}),
shares AS (
  SELECT text, sum(length(plain)) FILTER (plain IN (SELECT plain FROM spread)) AS shared, sum(length(plain)) AS chars FROM own GROUP BY text
),
bad AS (
  SELECT plain FROM own JOIN sited USING (text) JOIN shares USING (text)
  WHERE plain IN (SELECT plain FROM spread) AND coalesce(shared, 0) <= {MAX_SHARE!r}::DOUBLE * chars
  GROUP BY plain HAVING count(DISTINCT site) >= {MIN_SITES}
),
marked AS (SELECT p.*, b.plain IS NOT NULL AS gone FROM parts p LEFT JOIN bad b ON p.plain = b.plain),
made AS (
  SELECT doc_id, count(*) FILTER (plain <> '') AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS left_text
  FROM marked GROUP BY doc_id
)
SELECT doc_id, n_lines, n_removed, length(left_text)::BIGINT AS n_chars_left, md5(left_text) AS text_md5 FROM made
"""
