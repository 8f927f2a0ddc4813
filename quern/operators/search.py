"""Ranked search, batch search and prefix suggestions.

score = sum over keywords of tf * (ln((N + 1) / (df + 1)) + 1), plus 5 once for a document that holds all (two or more)
keywords at consecutive positions in query order. Repeated keywords count again. Ranks go by score
to six places, then by document id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import batch
from quern.operators.index import Index, document_frequencies
from quern.plans.shared import stored

TOP, SUGGESTIONS, BONUS = 10, 20, 5.0
#: Different keywords that are broadcast at most, some 30 bytes each; more meet the postings by shuffle.
FEW_TERMS = 200_000


def idf(size: Column, df: Column) -> Column:
    return F.log((size + 1) / (df + 1)) + 1


def terms_of(df: DataFrame, query: str, strict: bool = False) -> list[str]:
    """Keywords of one query, on the driver."""
    spark = df.sparkSession
    return spark.range(1).select(T.query_terms(F.lit(query), strict)).first()[0]


def keywords(queries: DataFrame, strict: bool = False) -> DataFrame:
    """``qid, qpos, term`` of ``queries`` (qid, query)."""
    return queries.select("qid", F.posexplode(T.query_terms(F.col("query"), strict)).alias("qpos", "term"))


def _sent(df: DataFrame, n: int) -> DataFrame:
    """``df`` of n rows, broadcast if these are few."""
    return F.broadcast(df) if n <= FEW_TERMS else df


def scored(postings: DataFrame, words: DataFrame, size: int, dfs: DataFrame | None = None) -> DataFrame:
    """``qid, doc_id, score, place`` of every document that holds a keyword; place is the score to six places, which ranks."""
    wanted = words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    counts = postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    known = dfs.select("term", "df") if dfs is not None else counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = wanted.join(known, "term").select("qid", "term", (F.col("times") * idf(F.lit(float(size)), F.col("df"))).alias("weight"))
    sums = counts.join(weight, "term").groupBy("qid", "doc_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("score"), F.count(F.lit(1)).alias("terms"))
    length = words.groupBy("qid").agg(F.count(F.lit(1)).alias("words"), F.countDistinct("term").alias("terms"))
    # only documents that hold every keyword can hold the phrase
    full = sums.join(length.where("words > 1"), ["qid", "terms"]).select("qid", "doc_id", "words")
    runs = postings.join(words, "term").join(full, ["qid", "doc_id"]).groupBy("qid", "doc_id", (F.col("pos") - F.col("qpos")).alias("at"), "words").agg(F.count(F.lit(1)).alias("n"))
    phrase = runs.where("n = words").select("qid", "doc_id").distinct().withColumn("bonus", F.lit(BONUS))
    out = sums.join(phrase, ["qid", "doc_id"], "left").select("qid", "doc_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return out.withColumn("place", F.round("score", 6))


def batch_search(postings: DataFrame, queries: DataFrame, size: int, k: int = TOP, strict: bool = False, dfs: DataFrame | None = None) -> DataFrame:
    """``qid, rank, doc_id, score``: the k best documents of each of ``queries`` (qid, query)."""
    words = stored(keywords(queries, strict), "keywords")
    terms = words.select("term").distinct()
    terms = _sent(terms, terms.limit(FEW_TERMS + 1).count())
    # before anything is shuffled, only the postings of the keywords stay
    counts = document_frequencies(postings.join(terms, "term", "left_semi")) if dfs is None else dfs.select("term", "df").join(terms, "term", "left_semi")
    known = stored(counts.withColumn("idf", idf(F.lit(float(size)), F.col("df"))).withColumn("tid", F.monotonically_increasing_id()), "known")
    found = batch.best(postings.join(_sent(known.select("term", "tid"), known.count()), "term"), words, known, k, BONUS)
    best = Window.partitionBy("qid").orderBy(batch.place(F.col("score")).desc(), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "doc_id", F.round("score", 4).alias("score"))


def search(index: Index, query: str, k: int = TOP, strict: bool = False) -> DataFrame:
    """``rank, doc_id, score`` of the k best documents. The query's keywords are literals, so scans read only their postings."""
    spark = index.postings.sparkSession
    terms = terms_of(index.postings, query, strict)
    if not terms:
        return spark.createDataFrame([], "rank int, doc_id long, score double")
    words = spark.createDataFrame([(0, i, t) for i, t in enumerate(terms)], "qid int, qpos int, term string")
    held = F.col("term").isin(sorted(set(terms)))
    found = scored(index.postings.where(held), F.broadcast(words), index.size, index.terms.where(held)).orderBy(F.desc("place"), "doc_id").limit(k)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("place"), "doc_id")))
    return ranked.select("rank", "doc_id", F.round("score", 4).alias("score"))


def suggest(terms: DataFrame, prefix: str, k: int = SUGGESTIONS) -> DataFrame:
    """``n, term``: the first k terms by first appearance that begin with ``prefix``, case included; none for an empty prefix."""
    found = terms.where(F.col("term").startswith(prefix) if prefix else F.lit(False)).orderBy("first_doc", "first_pos").limit(k)
    return found.select((F.row_number().over(Window.orderBy("first_doc", "first_pos")) - 1).alias("n"), "term")


def idfs(postings: DataFrame, size: int) -> DataFrame:
    """``term, idf`` to six places."""
    return document_frequencies(postings).select("term", F.round(idf(F.lit(float(size)), F.col("df")), 6).alias("idf"))
