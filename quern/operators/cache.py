"""Least-recently-used caching: of results on the driver, and of an access log at scale."""

from __future__ import annotations

from collections import OrderedDict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.shared import prepare, stored

CAPACITY = 100
#: Accesses of a log that one task replays.
RANGE_ROWS = 500_000


class ResultCache:
    """Results by raw query text, line ends stripped; case and blanks matter. Empty results are kept as well."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity if capacity > 0 else CAPACITY
        self.entries: OrderedDict[str, list] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, query: str, top: int | None = None) -> list | None:
        """The cached rows, at most ``top``; None if there are none."""
        key = query.rstrip("\r\n")
        if key not in self.entries:
            self.misses += 1
            return None
        self.hits += 1
        self.entries.move_to_end(key)
        return self.entries[key][:top]

    def put(self, query: str, rows: list[Any]) -> None:
        key = query.rstrip("\r\n")
        self.entries.pop(key, None)
        while len(self.entries) >= self.capacity:
            self.entries.popitem(last=False)
        self.entries[key] = list(rows)

    def free(self) -> None:
        """Drop the entries; counters stay."""
        self.entries.clear()

    @property
    def count(self) -> int:
        return len(self.entries)


def lru_hits(log: DataFrame, capacity: int, order_col: str, key_col: str) -> DataFrame:
    """``n, key, hit``: whether each access of a log finds its key in a cache of ``capacity`` keys.

    The log is cut into ranges of its order. What a range leaves in the cache depends only on its last
    ``capacity`` distinct keys, so each range is summed up first, the cache at its start follows from the summaries
    before it, and all ranges run at once. A range has about ``RANGE_ROWS`` accesses, and the driver holds ``capacity`` keys for each.
    """
    spark = log.sparkSession
    prepare(spark)
    kind = log.schema[key_col].dataType.simpleString()
    log = log.select(F.col(order_col).cast("long").alias("n"), F.col(key_col).alias("key"))
    parts = stored(log.repartitionByRange(max(1, -(-log.count() // RANGE_ROWS)), "n").withColumn("part", F.spark_partition_id()), "log")
    last = parts.groupBy("part", "key").agg(F.max("n").alias("n"))
    kept = last.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n")))).where(F.col("r") <= capacity)
    cache: OrderedDict = OrderedDict()
    before, now = {}, None
    for row in kept.orderBy("part", "n").select("part", "key").collect():
        if row.part != now:
            now = row.part
            before[now] = list(cache)
        cache.pop(row.key, None)
        cache[row.key] = True
        while len(cache) > capacity:
            cache.popitem(last=False)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n")
        held, hit = OrderedDict((k, True) for k in before[int(rows["part"].iloc[0])]), []
        for key in rows["key"].tolist():
            hit.append(key in held)
            held.pop(key, None)
            held[key] = True
            if len(held) > capacity:
                held.popitem(last=False)
        return pd.DataFrame({"n": rows["n"], "key": rows["key"], "hit": hit})

    return parts.groupBy("part").applyInPandas(run, f"n long, key {kind}, hit boolean")


def lru_stats(hits: DataFrame, capacity: int) -> DataFrame:
    """``accesses, hits, misses, held`` of a log's hits."""
    return hits.agg(F.count(F.lit(1)).alias("accesses"), F.sum(F.col("hit").cast("long")).alias("hits"), F.sum((~F.col("hit")).cast("long")).alias("misses"), F.least(F.countDistinct("key"), F.lit(capacity)).cast("long").alias("held"))
