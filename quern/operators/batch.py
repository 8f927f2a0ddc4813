"""Many queries at once: exhaustive scores in blocks of documents.

Documents are dealt into blocks by a hash of their id, so a block's postings are sent once. Each block, as one task, goes
through all queries, file by file, adds up a dense score for each of its documents, looks for the phrase where it has every
keyword, and hands on the best k; these partial lists merge by rank. No table of all queries and documents that share a
keyword is written, and a task's memory follows the block and one file of queries, not the tables.

Defined results: rows of one query id are one query; a null one is a query without the phrase's points; documents with a null id
are one document, which ranks last among equals and gets no such points; queries without a known keyword give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.plans import memo
from quern.plans.shared import filesystem, prepare, stored

#: Pairs of term and document in a block, and keywords in a file of queries.
BLOCK_PAIRS, FILE_WORDS = 1_200_000, 40_000
#: Scores are ranked to so many parts of one; best ones of a block are cut with two parts to spare.
PARTS = 1_000_000


def packed(words: DataFrame, known: DataFrame) -> DataFrame:
    """``qid, phrase, words`` of each query, in files of some ``FILE_WORDS`` words: its known keywords (qpos, tid, idf), and whether all are known."""
    mine = words.join(known.select("term", "tid", "idf"), "term", "left")
    own = F.when(F.col("tid").isNotNull(), F.struct("qpos", "tid", "idf"))
    n = F.count(F.lit(1))
    whole = F.col("qid").isNotNull() & (n > 1) & (F.count("tid") == n) & (F.countDistinct("qpos") == n)
    out = mine.groupBy("qid").agg(whole.alias("phrase"), F.sort_array(F.collect_list(own)).alias("words")).where(F.size("words") > 0)
    return stored(out.repartition(max(1, -(-words.count() // FILE_WORDS))), "queries")


class Block:
    """Postings of some documents: documents in order of their ids, then for each term its documents, frequencies and places."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        rows = pa.Table.from_batches(batches)
        ids = rows.column("doc_id").combine_chunks().dictionary_encode(null_encoding="encode")
        order = pc.sort_indices(ids.dictionary, null_placement="at_end").to_numpy()
        self.ids = ids.dictionary.take(pa.array(order))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.missing = len(order) - 1 if self.ids.null_count else -1
        # a place is the document above bit 32 and the position below, so that a phrase is a run of places
        at = (place[ids.indices.to_numpy()] << 32) + rows.column("pos").to_numpy()
        tids = rows.column("tid").to_numpy()
        del rows, ids, place
        order = np.lexsort((at, tids))
        self.at, tids = at[order], tids[order]
        del at, order
        docs = self.at >> 32
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(tids) != 0) | (np.diff(docs) != 0)]))
        self.docs, self.tf = docs[starts], np.diff(starts, append=len(tids)).astype(np.float64)
        cuts = np.flatnonzero(np.diff(tids[starts], prepend=-1))
        names = tids[starts[cuts]].tolist()
        pairs, places = [*cuts.tolist(), len(starts)], [*starts[cuts].tolist(), len(tids)]
        self.pairs = dict(zip(names, zip(pairs[:-1], pairs[1:])))
        self.places = dict(zip(names, zip(places[:-1], places[1:])))

    def phrase(self, words: list[tuple[int, int]]) -> np.ndarray:
        """Documents that hold the terms (qpos, tid) at positions as far from each other."""
        if any(tid not in self.places for _, tid in words):
            return np.zeros(0, np.int64)
        parts = sorted((stop - start, start, stop, qpos) for qpos, (start, stop) in ((q, self.places[tid]) for q, tid in words))
        _, start, stop, qpos = parts[0]
        found = np.unique(self.at[start:stop]) - qpos
        for _, start, stop, qpos in parts[1:]:
            held = self.at[start:stop]
            to = np.searchsorted(held, found + qpos)
            found = found[(to < len(held)) & (held[np.minimum(to, len(held) - 1)] == found + qpos)]
            if not len(found):
                break
        docs = np.unique((found + min(q for q, _ in words)) >> 32)
        return docs[docs != self.missing]

    def best(self, words: list[tuple[int, int, float]], phrase: bool, k: int, bonus: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best."""
        scores, hit = np.zeros(len(self.ids)), None
        if any(w <= 0 for _, _, w in words):
            hit = np.zeros(len(self.ids), bool)
        weights: dict[int, float] = {}
        for _, tid, w in words:
            weights[tid] = weights.get(tid, 0.0) + w
        for tid, w in weights.items():
            if tid in self.pairs:
                start, stop = self.pairs[tid]
                docs = self.docs[start:stop]
                scores[docs] += w * self.tf[start:stop]
                if hit is not None:
                    hit[docs] = True
        if phrase:
            scores[self.phrase([(q, t) for q, t, _ in words])] += bonus
        some = scores > 0 if hit is None else hit
        if hit is None and len(scores) > k:
            some &= scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - 2 / PARTS
        docs = np.flatnonzero(some)
        first = docs[np.lexsort((docs, -np.floor(scores[docs] * PARTS + 0.5)))[:k]]
        return first, scores[first]


def place(score: Column) -> Column:
    """What ranks: the score in parts, as a block ranks it."""
    return F.floor(score * PARTS + 0.5)


def _asked(folder: str) -> Iterator[pa.Table]:
    """The files of queries, one after another."""
    system, path = filesystem(folder)
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda x: x.path):
        if info.path.endswith(".parquet"):
            with system.open_input_file(info.path) as f:
                yield pq.read_table(f, use_threads=False)


def best(postings: DataFrame, words: DataFrame, known: DataFrame, k: int, bonus: float) -> DataFrame:
    """``qid, doc_id, score``: of each block, the k best documents of each query. known: ``term, df, idf, tid``, stored; postings: ``doc_id, tid, pos``."""
    prepare(words.sparkSession)
    blocks = max(1, -(-(known.agg(F.sum("df")).first()[0] or 0) // BLOCK_PAIRS))
    folder = packed(words, known)._quern_path
    kinds = StructType([StructField("qid", words.schema["qid"].dataType), StructField("doc_id", postings.schema["doc_id"].dataType), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Block(batches)
        memo.give_back()
        for asked in _asked(folder):
            lists = asked.column("words").combine_chunks()
            ends, flat = lists.offsets.to_numpy(), lists.flatten()
            rows = list(zip(*(flat.field(x).to_pylist() for x in ("qpos", "tid", "idf"))))
            phrase, out = asked.column("phrase").to_pylist(), []
            for i in range(asked.num_rows):
                out.append(own.best(rows[ends[i] - ends[0] : ends[i + 1] - ends[0]], phrase[i], k, bonus))
            if out:
                docs, score = (np.concatenate(x) for x in zip(*out))
                at = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
                qids = asked.column("qid").combine_chunks().take(pa.array(at))
                yield pa.RecordBatch.from_arrays([qids, own.ids.take(pa.array(docs)), pa.array(score)], names=["qid", "doc_id", "score"])

    dealt = postings.select("doc_id", "tid", "pos", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("c"))
    return dealt.groupBy("c").applyInArrow(run, kinds)
