"""Near-duplicate classes by BagMinHash signatures over multisets of word shingles.

A document is the multiset of its shingles (``SHINGLE`` consecutive words). Each shingle owns Poisson processes in time over
dyadic cells of weight, [0, 1), [1, 2), [2, 4), ...: a point falls on a component of the signature
and, within its cell, on a unit of weight, and exists for all documents in which the shingle has
more copies than that unit. A component keeps its first point. Two documents keep the same point with the probability
of their weighted Jaccard similarity. Points are only made up to a horizon by which all components
have one, so the work per document follows the signature's size, not the weights.

Bands of the signature make candidates, exact multiset overlap decides, connected components of the links make
classes. Texts of equal words are one node from the start. In a bucket all nodes are first compared with its
least node; nodes of a bucket that these links leave in different classes are then compared with each
other, so no class that candidates' links make is torn. Large buckets are compared in blocks, where matrix products
give all similarities and only links that join classes leave the task.

Defined results: words are runs of ASCII letters (case ignored), digits and other characters beyond ASCII; a text of fewer words than a
shingle, but not none, is one shingle; texts without words (null, empty) are alike to no other
row: each has its own class; the class id is the least document id of the class, null if all its ids are null; repeated
rows are in one class, and of ties in the least id the row with the least text stays; long texts are compared whole; other columns, whatever
their names, are ignored by ``classes`` and kept as they are by ``deduplicated``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.decontaminate import words_of
from quern.plans import memo
from quern.plans.arrow import slices
from quern.plans.components import components
from quern.plans.names import fresh
from quern.plans.shared import dropped, files_for, prepare, stored

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 6: a pair at similarity 0.8 shares a band with probability 0.9999, one at 0.3 with 0.02.
BANDS, ROWS = 32, 6
#: Buckets up to SMALL nodes give pairs, larger ones are compared in blocks of BLOCK nodes.
SMALL, BLOCK, BLOCK_BYTES = 16, 256, 16 << 20
#: Partners of a node that one task compares with it, about.
FAN = 256
CACHE_ENTRIES = 300_000
FULL = 0xFFFFFFFFFFFFFFFF
EMPTY = np.uint64(FULL)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = got
        return got


_hashes = _Hashes()


def shingles(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the shingles of a text's words, in order, with repeats."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(h))):
        out = (out + h[i : i + n]) * GOLDEN
        out ^= out >> np.uint64(29)
    return mix(out)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (documents x size) of multisets given as distinct elements and counts, none empty."""
    out = np.full((len(sets), size), EMPTY)
    weight = np.array([c.sum() for _, c in sets], dtype=np.float64)
    horizon = size * (np.log(size) + 4) / np.maximum(weight, 1)
    todo = np.arange(len(sets))
    while len(todo):
        doc = np.repeat(todo, [len(sets[i][0]) for i in todo])
        element = np.concatenate([sets[i][0] for i in todo])
        count = np.concatenate([sets[i][1] for i in todo]).astype(np.int64)
        level = 0
        while len(doc):
            low, cells = (0, 1) if level == 0 else (1 << level - 1, 1 << level - 1)
            _points(out, horizon, doc, mix(element + np.uint64(level * int(GOLDEN) & FULL)), count, low, cells)
            more = count > low + cells
            doc, element, count, level = doc[more], element[more], count[more], level + 1
        todo = todo[(out[todo] == EMPTY).any(axis=1)]
        out[todo] = EMPTY
        horizon[todo] *= 2
    return out


def _points(out: np.ndarray, horizon: np.ndarray, doc: np.ndarray, seed: np.ndarray, count: np.ndarray, low: int, cells: int) -> None:
    """Put the points of one cell [low, low + cells) of each element up to the horizon of its document into ``out``."""
    size, time, flat, step = out.shape[1], np.zeros(len(doc)), out.reshape(-1), 0
    while len(doc):
        step += 1
        bits = mix(seed + np.uint64(step * 0xD1B54A32D192ED03 & FULL))
        time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / cells
        on = time <= horizon[doc]
        doc, seed, count, time, bits = doc[on], seed[on], count[on], time[on], bits[on]
        more = mix(bits ^ np.uint64(0xA0761D6478BD642F))
        at = (more >> np.uint64(32)) % np.uint64(size)
        name = more & np.uint64(0xFFFFFF)
        # first 40 bits of the time, which order like it, and 24 that tell points apart
        key = (time.view(np.uint64) >> np.uint64(23) << np.uint64(24)) | name
        cell, where = low, np.ones(len(doc), bool)
        if cells > 1:
            cell = low + (mix(more) >> np.uint64(11)).astype(np.float64) * (cells * 2.0**-53)
            where = cell.astype(np.int64) < count
        np.minimum.at(flat, doc[where] * size + at[where].astype(np.int64), key[where])


def bands_of(signature: np.ndarray) -> np.ndarray:
    """64-bit keys (documents x BANDS): equal where a band's components are."""
    parts = signature.reshape(len(signature), BANDS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mix(key * GOLDEN + parts[:, :, i])
    return key.view(np.int64)


def node_of(words: list[bytes]) -> bytes | None:
    """128 bits of a text's words: equal for texts of equal words; None without words."""
    return hashlib.md5(b" ".join(words)).digest() if words else None


def node_column(text):
    """``node_of`` the words of a column of texts."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words != "", F.unhex(F.md5(words)))


def signed(docs: DataFrame) -> DataFrame:
    """``doc, node, bands`` of ``docs`` (columns doc and text); without words node is null and bands are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("bagminhash", _hashes.clear)
        for batch in slices(batches, "text", 1 << 20):
            sets, nodes = [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                nodes.append(node_of(words))
                if words:
                    sets.append(np.unique(shingles(words), return_counts=True))
            keys = bands_of(signatures(sets)) if sets else np.zeros((0, BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum([BANDS * (x is not None) for x in nodes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1), pa.int64()))], names=["doc", "node", "bands"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, node binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose texts' multisets overlap enough; ``texts`` (id, text) has a row for each node.

    A worker gets the text of ``a`` once before those of up to ``FAN`` of its partners or so, and holds one slice of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("bagminhash", _hashes.clear)
        own, x = None, None
        for batch in slices(batches, "text"):
            found: tuple[list, list] = [], []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4))):
                if b is None:
                    own, x = a, shingles(words_of(text))
                elif a != own:
                    raise ValueError("a pair's first text is missing")
                elif overlap(x, shingles(words_of(text))) >= similarity:
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    first = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    # texts are streamed past small tables of ids, not sorted for the join
    wanted = members.select(F.col("b").alias("id"), "a", "part", "b").unionByName(first.select(F.col("a").alias("id"), "a", "part", "b"))
    rows = texts.join(wanted.hint("shuffle_hash"), "id").select("a", "part", F.col("b").isNotNull().alias("later"), "b", "text")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "later").mapInArrow(run, "a long, b long")


def linked(rows: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links that join different classes (column root) within a block, or between two blocks, of a bucket.

    All similarities of the block come from products of its 0/1 matrix of elements, where the n-th copy of a shingle is an element of its
    own. Of links that join the same classes the first is enough.
    """
    ids, roots, block = (rows.column(c).to_numpy() for c in ("id", "root", "block"))
    sizes, elements = [], []
    for text in rows.column("text").to_pylist():
        x, n = np.unique(shingles(words_of(text)), return_counts=True)
        copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        elements.append(mix(np.repeat(x, n) + copy.astype(np.uint64) * GOLDEN))
        sizes.append(len(copy))
    size = np.array(sizes, np.float32)
    _, column, df = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(ids)), sizes)
    shared = df[column] > 1
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    column = np.cumsum(np.diff(column, prepend=column[:1]) > 0) if len(column) else column
    both = np.zeros((len(ids), len(ids)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (first, first + 4096))
        part = np.zeros((len(ids), 4096), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        both += part @ part.T
    # the same division as in overlap, in double precision
    alike = both.astype(np.float64) / (size[:, None].astype(np.float64) + size[None, :] - both) >= similarity
    alike &= (roots[:, None] != roots[None, :]) & ((block[:, None] != block[None, :]) | (block.min() == block.max()))
    group = {int(r): int(r) for r in roots}

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = x = group[group[x]]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(alike)))):
        x, y = find(int(roots[i])), find(int(roots[j]))
        if x != y:
            group[x] = y
            out.append((int(ids[i]), int(ids[j])))
    return out


def _within(rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between classes within large buckets (``key, id, root, n``), block by block."""

    def run(rows: pa.Table) -> pa.Table:
        memo.only("bagminhash", _hashes.clear)
        links = linked(rows, similarity)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    # a block holds BLOCK nodes or BLOCK_BYTES of text, about
    sized = rest.join(texts.select("id", F.octet_length("text").cast("long").alias("bytes")), "id")
    total = sized.groupBy("key").agg(F.sum("bytes").alias("total"))
    blocks = rest.join(total, "key").withColumn("blocks", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int"))
    own = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a block meets every block of its bucket once
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    meets = meets.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "root", "block")
    return meets.join(texts, "id").groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def _keys() -> list:
    """Null ids are told from 0 by a flag."""
    return [F.coalesce("doc", F.lit(0)).alias("doc"), F.col("doc").isNull().alias("none")]


def _texts(docs: DataFrame, nodes: DataFrame, repeated: DataFrame) -> DataFrame:
    """``id, text`` of ``nodes`` (id, node, doc): the text of the row with the node's least id.

    An id of one row names its text. Where an id repeats (``repeated``: doc, none), its rows are told apart by their words.
    """
    places = nodes.select("id", "node", *_keys()).join(repeated.withColumn("many", F.lit(True)), ["doc", "none"], "left")
    rows = docs.select(*_keys(), "text")
    one = rows.join(places.where("many IS NULL").hint("shuffle_hash"), ["doc", "none"]).select("id", "text")
    if not repeated.take(1):
        return one
    # stored first: a condition on words would be taken to the scan of all texts
    more = stored(rows.join(repeated.hint("shuffle_hash"), ["doc", "none"], "left_semi"), "rows").withColumn("node", node_column(F.col("text")))
    more = more.join(places.where("many"), ["doc", "none", "node"])
    return one.unionByName(more.groupBy("id").agg(F.min("text").alias("text")))


def _classes(df: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``doc, node`` of every row; ``node, doc, n, root`` of every node: its least id, its rows, its class; and ``doc, none`` of ids of several rows."""
    prepare(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    own = stored(signed(docs), "signed")
    few = files_for(own)
    repeated = stored(own.select(*_keys()).groupBy("doc", "none").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").coalesce(few), "repeated")
    grouped = own.where("node IS NOT NULL").groupBy("node").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = stored(grouped.select(F.monotonically_increasing_id().alias("id"), "*").coalesce(few), "nodes")
    keyed = nodes.select("id", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count(F.lit(1)).alias("n")).where("a != z").drop("z")
    live = stored(keyed.join(least, "key").coalesce(few), "buckets")
    texts = stored(_texts(docs, nodes.join(live.select("id").distinct(), "id", "left_semi"), repeated), "texts")
    pairs = stored(live.where("id != a").select("a", F.col("id").alias("b")).distinct().coalesce(files_for(live)), "pairs")
    # comparing texts keeps all its tasks, so links are dealt again before they are written
    links = stored(verified(pairs, texts, similarity).repartition(files_for(pairs)), "links")
    roots = components(links)
    # what the stars leave apart within a bucket
    placed = live.join(roots.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
    apart = placed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("key")
    rest = stored(placed.join(apart, "key").coalesce(files_for(live)), "rest")
    small = rest.where(F.col("n") <= SMALL)
    left, right = small.select("key", F.col("id").alias("a"), F.col("root").alias("r")), small.select("key", F.col("id").alias("b"), F.col("root").alias("s"))
    across = left.join(right, "key").where("r < s").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    across = stored(across.join(pairs, ["a", "b"], "left_anti").coalesce(files_for(rest)), "pairs")
    more = links.unionByName(verified(across, texts, similarity)).unionByName(_within(rest.where(F.col("n") > SMALL), texts, similarity))
    more = stored(more.repartition(files_for(links, across, rest)), "links")
    roots = components(more)
    out = stored(nodes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").select("node", "doc", "n", F.coalesce("root", "id").alias("root")).coalesce(few), "classes")
    dropped(texts, links, rest, live, pairs, across, more, nodes)
    return own.select("doc", "node"), out, repeated


def classes(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` (as ``id_col``), ``class_id`` and ``n_class``, the number of its documents, for every row."""
    own, nodes, repeated = _classes(df, similarity, id_col, text_col)
    dropped(repeated)
    named = nodes.groupBy("root").agg(F.min("doc").alias("class_id"), F.sum("n").alias("n_class"))
    out = own.join(nodes.select("node", "root").join(named, "root").select("node", "class_id", "n_class"), "node", "left")
    return out.select(F.col("doc").alias(id_col), F.when(F.col("node").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def deduplicated(df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all its columns: that of the least id; texts without words all stay.

    Rows are chosen by id: texts are streamed past the ids that stay. Only rows whose id repeats are told
    apart by their words, and of those that agree in both the one with the least text stays.
    """
    own, nodes, repeated = _classes(df, similarity, id_col, text_col)
    first = nodes.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "node")).alias("x")).select("x.node", F.coalesce("x.doc", F.lit(0)).alias("doc"), "x.none")
    wordless = own.where("node IS NULL").select(*_keys()).distinct()
    many = repeated.withColumn("many", F.lit(True))
    chosen = first.select("doc", "none").distinct().unionByName(wordless).distinct().join(many, ["doc", "none"], "left").select("doc", "none", F.coalesce("many", F.lit(False)).alias("many"))
    chosen = stored(chosen.coalesce(files_for(nodes)), "chosen")
    doc, none, node, copy = fresh(df.columns, "doc", "none", "node", "copy")
    rows = df.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), none: F.col(id_col).isNull()})
    key = [doc, none]
    ids = chosen.select(F.col("doc").alias(doc), F.col("none").alias(none), "many")
    one = rows.join(ids.where("NOT many").drop("many").hint("shuffle_hash"), key, "left_semi").select(*df.columns)
    if not chosen.where("many").take(1):
        return one
    # stored first: a condition on words would be taken to the scan of all texts
    more = stored(rows.join(ids.where("many").drop("many").hint("shuffle_hash"), key, "left_semi"), "rows").withColumn(node, node_column(F.col(text_col)))
    wanted = first.select(F.col("doc").alias(doc), F.col("none").alias(none), F.col("node").alias(node))
    same = Window.partitionBy(*key, node).orderBy(text_col)
    told = more.where(F.col(node).isNotNull()).join(wanted, [*key, node], "left_semi").withColumn(copy, F.row_number().over(same)).where(F.col(copy) == 1)
    return one.unionByName(told.select(*df.columns)).unionByName(more.where(F.col(node).isNull()).select(*df.columns))
