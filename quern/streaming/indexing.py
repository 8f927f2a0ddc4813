"""An index of a stream of documents by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quern.operators.index import Index, tokens, vocabulary


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, files_each: int = 100) -> DataFrame:
    """Documents of Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def index_stream(docs: DataFrame, path: str, checkpoint: str, stop=None) -> StreamingQuery:
    """Add streamed documents (doc_id, text, ...) to the index at ``path`` until the source has no more files.

    Each micro-batch writes a folder of its own for documents, postings and, last, the vocabulary of its documents, and
    writes the same folders again if it runs again after a restart from ``checkpoint``. All rows of a
    document must come in one batch, since document frequencies of batches are added up.
    """

    def put(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/docs/batch={n}")
        known = spark.read.schema(batch.schema).parquet(f"{path}/docs/batch={n}")
        found = tokens(known, stop)
        found.repartitionByRange("term").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/postings/batch={n}")
        again = spark.read.schema(found.schema).parquet(f"{path}/postings/batch={n}")
        last = again.agg(F.max("doc_id").alias("last_doc"))
        vocabulary(again).crossJoin(F.broadcast(last)).write.mode("overwrite").parquet(f"{path}/terms/batch={n}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream(spark: SparkSession, path: str) -> Index:
    """The index that ``index_stream`` has written so far, ready for searches and for ``save``.

    Terms come from the batches' vocabularies, not from the postings. A batch's postings count once its vocabulary is written;
    its documents may be there before.
    """
    parts = spark.read.parquet(f"{path}/terms")
    done, last = parts.agg(F.max("batch"), F.max("last_doc")).first()
    first = F.min(F.struct("first_doc", "first_pos")).alias("f")
    terms = parts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), first).select("term", "df", "cf", "f.first_doc", "f.first_pos")
    postings = spark.read.parquet(f"{path}/postings").where(F.col("batch") <= F.lit(-1 if done is None else done)).drop("batch")
    docs = spark.read.parquet(f"{path}/docs").drop("batch")
    return Index(postings, terms, docs, 0 if last is None else last + 1)
