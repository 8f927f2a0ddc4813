"""Exact top-k search by inner product: exhaustive, a term (dimension) at a time.

Vectors become sparse integer rows. Candidates are dealt into blocks, each held as postings
(term -> rows of the block and their weights), queries into blocks of sparse rows. For each pair
of a query block and a candidate block one task scatters the weighted postings of every query
term into a dense score array, selects the best k by partition, and the partial lists merge.
Both block sizes are fixed, so a task's memory does not grow with the tables.

Scores are sums of 64-bit integers, or of Python's where a bound of the sum does not fit those.

Defined results: component x becomes floor(scale * x); one beyond 64 bits raises an error, as does a score
beyond them among the best k; null vectors and those with null, NaN or infinite components take no part;
missing components (shorter vectors) count as 0; ties go to the smaller id; a row never is its
own candidate, though another row with the same id is; rows with null ids take no part; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.shared import prepare, stored

#: Rows of a candidate block and of a query block: equal, since each side is sent once for each block of the other. Score arrays hold 32 * CANDIDATES longs at once.
CANDIDATES, QUERIES = 4096, 4096
LIMIT = 1 << 63


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``row`` (its place in the scan), ``id``, and ``w``: the integer components of usable vectors."""
    x = F.col(vector_col)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    scaled = lambda v: v.cast("double") * F.lit(float(scale))
    fits = lambda v: (scaled(v) >= F.lit(float(-LIMIT))) & (scaled(v) < F.lit(float(LIMIT)))
    whole = F.transform(x, lambda v: F.when(fits(v), F.floor(scaled(v))).otherwise(F.raise_error(F.lit("a scaled component does not fit 64 bits")).cast("long")))
    return df.select(F.col(id_col).alias("id"), x).where(F.col("id").isNotNull() & F.col(vector_col).isNotNull() & ~F.exists(x, bad)).select(F.monotonically_increasing_id().alias("row"), "id", whole.alias("w"))


def _sparse(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, row and weight of the components that are not 0, by term."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(np.array([len(x) for x in column], dtype=np.int64)) if len(column) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    rows = np.repeat(np.arange(len(ends)), ends - starts)
    terms = np.arange(len(flat)) - starts[rows]
    some = np.flatnonzero(flat)
    order = some[np.argsort(terms[some], kind="stable")]
    return terms[order], rows[order], flat[order]


def _most(weights: np.ndarray) -> int:
    """The greatest absolute weight."""
    return max(int(weights.max()), -int(weights.min())) if len(weights) else 0


def block_top(query: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """The best k of one candidate block for each query of one query block."""
    order = np.argsort(found.column("id").to_numpy(), kind="stable")  # a smaller place is a smaller id
    found = found.take(pa.array(order))
    q_row, q_id = query.column("row").to_numpy(), query.column("id").to_numpy()
    c_row, c_id = found.column("row").to_numpy(), found.column("id").to_numpy()
    terms, posted, weights = _sparse(found.column("w"))
    bounds = np.flatnonzero(np.diff(terms, prepend=-1, append=-1)) if len(terms) else np.zeros(0, np.int64)
    postings = {int(terms[a]): (posted[a:b], weights[a:b]) for a, b in zip(bounds[:-1], bounds[1:])} if len(terms) else {}
    q_terms, q_rows, q_weights = _sparse(query.column("w"))
    n, out, most = len(c_id), [], _most(weights)
    for first in range(0, len(q_id), 32):
        last = min(first + 32, len(q_id))
        mine = (q_rows >= first) & (q_rows < last)
        own_terms, own_rows, own_weights = q_terms[mine], q_rows[mine] - first, q_weights[mine]
        # a sum that might not fit 64 bits is taken over Python's integers
        kind = np.int64 if _most(own_weights) * most * len(np.unique(own_terms)) < LIMIT else object
        scores, own_weights = np.zeros((last - first, n), dtype=kind), own_weights.astype(kind)
        at = np.flatnonzero(np.diff(own_terms, prepend=-1, append=-1)) if len(own_terms) else np.zeros(0, np.int64)
        for a, b in zip(at[:-1], at[1:]):
            if (hit := postings.get(int(own_terms[a]))) is not None:
                add = own_weights[a:b, None] * hit[1][None, :].astype(kind)
                if len(hit[0]) == n and b - a == last - first:
                    scores += add
                else:
                    scores[np.ix_(own_rows[a:b], hit[0])] += add
        for i in range(last - first):
            s, free = scores[i], np.ones(n, dtype=bool)
            free[c_row == q_row[first + i]] = False
            at_free = np.flatnonzero(free)
            if len(at_free) > k:
                least = np.partition(s[at_free], len(at_free) - k)[len(at_free) - k]
                above, equal = at_free[s[at_free] > least], at_free[s[at_free] == least]
                at_free = np.concatenate([above, equal[: k - len(above)]])
            out.append((first + i, at_free, s[at_free]))
    places = np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
    chosen = np.concatenate([x[1] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64)
    score = np.concatenate([x[2].astype(np.int64) for x in out]) if out else np.zeros(0, np.int64)
    return pa.table({"q_row": q_row[places], "query_id": q_id[places], "id": c_id[chosen], "score": score})


def top_k(df: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row where ``is_query`` (of column ``id``) holds."""
    spark = df.sparkSession
    prepare(spark)
    rows = stored(quantised(df, id_col, vector_col, scale), "vectors")
    asked = rows.where(is_query(F.col("id")))
    n, m = rows.count(), asked.count()
    blocks, groups = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    spread = lambda i, of: F.pmod(F.xxhash64("row", F.lit(i)), F.lit(of)).cast("int")
    found = rows.withColumn("c", spread(1, blocks)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    query = asked.withColumn("q", spread(2, groups)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        return block_top(left, right, k)

    part = query.groupBy("q", "c").cogroup(found.groupBy("q", "c")).applyInArrow(merge, "q_row long, query_id long, id long, score long")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "id")
    ranked = part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
