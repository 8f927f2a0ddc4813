"""A search session: results from the cache or the index, stage times, a log, and the answer as one object."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime

from quern.operators import present, search
from quern.operators.cache import CAPACITY, ResultCache
from quern.operators.index import Index

log = logging.getLogger("quern.search")


def log_time(at: datetime) -> str:
    """Year to milliseconds, as log lines begin."""
    return at.strftime("%Y-%m-%d %H:%M:%S.") + f"{at.microsecond // 1000:03d}"


class Session:
    """Answers queries on an index; ranked ids are cached by raw query, texts are read for each answer."""

    def __init__(self, index: Index, capacity: int = CAPACITY, name_col: str = "file_name", clock: Callable[[], float] = time.perf_counter):
        self.index, self.cache, self.name_col, self.clock = index, ResultCache(capacity), name_col, clock

    def ranked(self, query: str, k: int = search.TOP, lap: Callable[[str], None] = lambda stage: None) -> list[tuple]:
        """``rank, doc_id, score`` of the k best documents, from the cache where it has as many."""
        lap("cache lookup")
        found = self.cache.get(query)
        if found is not None and found[0] >= k:
            return found[1][:k]
        lap("scoring")
        rows = [tuple(r) for r in search.search(self.index, query, k).collect()]
        lap("scored")
        self.cache.put(query, [k, rows])
        return rows

    def answer(self, query: str, k: int = search.TOP, bench: str = "") -> dict:
        """docList (rank, fileName, score, abstract), benchText, queryTimeMs (of scoring, 0 from the cache) and timestamps (stage, timeMs)."""
        began, stages = self.clock(), []

        def lap(stage: str) -> None:
            stages.append({"stage": stage, "timeMs": round((self.clock() - began) * 1000, 3)})
            log.info("[%s] %s: %.3f ms", log_time(datetime.now()), stage, stages[-1]["timeMs"])

        rows = self.ranked(query, k, lap)
        spark = self.index.docs.sparkSession
        shown = present.result_rows(spark.createDataFrame(rows, "rank int, doc_id long, score double"), self.index.docs, self.name_col).orderBy("rank").collect() if rows else []
        lap("shown")
        at = {s["stage"]: s["timeMs"] for s in stages}
        return {
            "docList": [{"rank": r.rank, "fileName": r.file_name, "score": r.score, "abstract": r.snippet} for r in shown],
            "benchText": bench,
            "queryTimeMs": round(at["scored"] - at["scoring"], 3) if "scored" in at else 0,
            "timestamps": stages,
        }
