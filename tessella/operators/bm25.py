"""Full-text search: an inverted index as DataFrames, and BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_phrases, tokens

#: BM25's parameters, and the weight of terms that most documents have.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


@dataclass
class TextIndex:
    """``postings``: term, id, field, pos, dl (the document's length). ``lengths``: id, dl. ``stats``: n_docs, total, in one row.

    All derive from the issues. Stored, postings are sorted by term, so that a search reads the
    row groups of its terms alone, and no text.
    """

    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame


def stats_of(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0).cast("long")).alias("total"))


def build(issues: DataFrame) -> TextIndex:
    """The index of title and body; ``issues`` needs id, title, body."""
    cut = issues.select("id", tokens(F.col("title")).alias("title"), tokens(F.col("body")).alias("body")).withColumn("dl", (F.size("title") + F.size("body")).cast("long"))
    fields = F.array(F.struct(F.lit("t").alias("field"), F.col("title").alias("words")), F.struct(F.lit("b").alias("field"), F.col("body").alias("words")))
    postings = cut.select("id", "dl", F.explode(fields).alias("f")).select("id", "dl", "f.field", F.posexplode("f.words").alias("pos", "term")).select("term", "id", "field", "pos", "dl")
    lengths = cut.select("id", "dl")
    return TextIndex(postings, lengths, stats_of(lengths))


def updated(index: TextIndex, issues: DataFrame) -> TextIndex:
    """The index after the given issues have changed or come; the others keep their rows."""
    new, ids = build(issues), issues.select("id").distinct()
    lengths = index.lengths.join(ids, "id", "left_anti").unionByName(new.lengths)
    return TextIndex(index.postings.join(ids, "id", "left_anti").unionByName(new.postings), lengths, stats_of(lengths))


def stored(index: TextIndex) -> dict[str, DataFrame]:
    """The index' tables by name, as they are written: postings in ranges of terms, sorted. A frequent term's postings span several ranges."""
    return {"postings": index.postings.repartitionByRange("term", "id").sortWithinPartitions("term", "id"), "lengths": index.lengths, "text_stats": index.stats}


def matches(index: TextIndex, query: str) -> DataFrame:
    """phrase, id, dl, f: how often each phrase of the query stands in a document, and its length. A phrase lies within one field."""
    spark = index.postings.sparkSession
    phrases = py_phrases(query)
    rows = [(i, j, term, len(p)) for i, p in enumerate(phrases) for j, term in enumerate(p)]
    table = spark.createDataFrame(rows, "phrase int, j int, term string, size int")
    terms = sorted({r[2] for r in rows})
    found = index.postings.where(F.col("term").isin(terms)).join(F.broadcast(table), "term")  # the query's terms alone
    if all(len(p) == 1 for p in phrases):
        return found.groupBy("phrase", "id").agg(F.first("dl").alias("dl"), F.count("*").alias("f"))
    at = found.groupBy("phrase", "id", "field", (F.col("pos") - F.col("j")).alias("start")).agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("dl").alias("dl"))
    return at.where("n = size").groupBy("phrase", "id").agg(F.first("dl").alias("dl"), F.count("*").alias("f"))


def score(index: TextIndex, query: str, decimals: int | None = None) -> DataFrame:
    """id, bm25 (negative; the smaller the better) of the documents that have every phrase of the query.

    Numbers of documents and the mean length are the whole index's: filters never change scores.
    A query without tokens finds nothing.
    """
    spark = index.postings.sparkSession
    n_phrases = len(py_phrases(query))
    if not n_phrases:
        return spark.createDataFrame([], "id long, bm25 double")
    found = matches(index, query)
    freq = found.groupBy("phrase").agg(F.count("*").alias("doc_freq"))
    idf = F.log((F.col("n_docs") - F.col("doc_freq") + 0.5) / (F.col("doc_freq") + 0.5))
    weights = freq.crossJoin(F.broadcast(index.stats)).select("phrase", F.when(idf <= 0, LEAST_IDF).otherwise(idf).alias("idf"), (F.col("total") / F.col("n_docs")).alias("avg_dl"))  # one row of stats
    part = F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    whole = found.join(F.broadcast(weights), "phrase").groupBy("id").agg((-F.sum(part)).alias("bm25"), F.count("*").alias("n")).where(F.col("n") == n_phrases)
    return whole.select("id", F.col("bm25") if decimals is None else F.round("bm25", decimals).alias("bm25"))


def search(index: TextIndex, issues: DataFrame, query: str, limit: int, predicate=None, decimals: int | None = None) -> DataFrame:
    """id, bm25 of the best ``limit`` documents that pass the filter."""
    scored = score(index, query, decimals)
    if predicate is not None:
        scored = scored.join(issues.where(predicate).select("id"), "id", "left_semi")
    return scored.orderBy("bm25", "id").limit(limit)
