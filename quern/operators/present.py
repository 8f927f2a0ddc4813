"""Search results as rows, JSON and marked text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def result_rows(ranked: DataFrame, docs: DataFrame, name_col: str = "file_name", text_col: str = "text") -> DataFrame:
    """``rank, doc_id, file_name, score, snippet``: ranked documents that exist; ranks keep their numbers."""
    shown = docs.select("doc_id", F.col(name_col).alias("file_name"), T.snippet(T.ascii_lower(F.col(text_col))).alias("snippet"))
    return shown.join(F.broadcast(ranked), "doc_id").select("rank", "doc_id", "file_name", "score", "snippet")


def result_json(rows: DataFrame) -> DataFrame:
    """``rank, json``: an object with rank, fileName, score and abstract for each result."""
    return rows.select("rank", F.to_json(F.struct("rank", F.col("file_name").alias("fileName"), F.format_string("%.4f", "score").alias("score"), F.col("snippet").alias("abstract"))).alias("json"))


def highlighted(rows: DataFrame, query: str) -> DataFrame:
    """``rank, html``: escaped snippets with the query's words marked."""
    return rows.select("rank", T.highlight(F.col("snippet"), query).alias("html"))
