"""The positional inverted index as DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.plans.shared import filesystem, prepare, remove, stored

VERSION = 1
# Fixed values of the binary layout: magic number and version.
MAGIC, BINARY_VERSION = 0x5458544D, 1
#: Postings of a batch that a reader of the binary layout hands on.
BATCH_ROWS = 1 << 16
#: Postings that a task packs at once, and bits of a document id within a block, 16 at most.
PIECE_ROWS, BLOCK_BITS = 1 << 22, 14
#: Bytes at which a file of the binary layout ends.
FILE_BYTES = 16 << 20
#: A place in a piece, by whether a position needs more than 16 bits.
PLACE = {False: np.dtype([("doc", "<u2"), ("pos", "<u2")]), True: np.dtype([("doc", "<u2"), ("pos", "<u4")])}


def tokens(docs: DataFrame, stop: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", max_tokens: int | None = None) -> DataFrame:
    """``doc_id, pos, term``: a row for each index term of each document."""
    found = docs.select(F.col(id_col).alias("doc_id"), T.doc_tokens(F.col(text_col), stop, max_tokens).alias("terms"))
    return found.select("doc_id", F.posexplode("terms").alias("pos", "term"))


def term_frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(postings: DataFrame) -> DataFrame:
    return term_frequencies(postings).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(postings: DataFrame) -> DataFrame:
    """``term, df, cf, first_doc, first_pos`` of every term."""
    by_doc = postings.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.min("pos").alias("pos"))
    first = F.min(F.struct("doc_id", "pos"))
    return by_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), first.alias("f")).select("term", "df", "cf", F.col("f.doc_id").alias("first_doc"), F.col("f.pos").alias("first_pos"))


def term_order(terms: DataFrame) -> DataFrame:
    """``term, first_doc, first_pos, term_ord``: place of each term by first appearance, from 0.

    Numbered in ranges: ranges are sorted each by itself and start at the sum of the counts before them. They are stored
    first, since two plans of one repartition need not cut it in the same places.
    """
    ranges = terms.select("term", "first_doc", "first_pos").repartitionByRange("first_doc", "first_pos").sortWithinPartitions("first_doc", "first_pos")
    # the id has the partition above bit 33 and the row's place in it below
    at = stored(ranges.withColumn("at", F.monotonically_increasing_id()), "ranges")
    parts = at.select("term", "first_doc", "first_pos", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("n"))
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(base), "part").select("term", "first_doc", "first_pos", (F.col("base") + F.col("n")).alias("term_ord"))


def corpus_size(postings: DataFrame) -> int:
    """Greatest document id with a term, plus 1."""
    last = postings.agg(F.max("doc_id")).first()[0]
    return 0 if last is None else last + 1


@dataclass
class Index:
    """Postings (term, doc_id, pos), terms (see ``vocabulary``), documents (doc_id, text, ...) and the corpus size."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    size: int

    def save(self, path: str) -> None:
        """Parquet, postings in order of terms, so that a search reads only the row groups of its keywords."""
        self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id", "pos").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        spark = self.postings.sparkSession
        spark.createDataFrame([(self.size, VERSION)], "n_docs long, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")


def build(docs: DataFrame, stop: Sequence[str] | None = None) -> Index:
    """The index of ``docs`` (doc_id, text, ...). Texts are tokenised once, into a table in the shared folder; the rest derives from it."""
    postings = stored(tokens(docs, stop), "postings")
    return Index(postings, vocabulary(postings), docs, corpus_size(postings))


def load(spark: SparkSession, path: str) -> Index:
    corpus = spark.read.parquet(f"{path}/corpus").first()
    if corpus.version != VERSION:
        raise ValueError(f"index version {corpus.version}")
    return Index(*(spark.read.parquet(f"{path}/{x}") for x in ("postings", "terms", "docs")), corpus.n_docs)


def _entry(term: str, places: np.ndarray) -> bytes:
    if places.min() < 0 or places.max() > 0xFFFFFFFF:
        raise ValueError(f"a document id or position of {term!r} does not fit 32 bits")
    return _packed(term, places)


def _packed(term: str, places: np.ndarray) -> bytes:
    name = term.encode("utf-8")
    return struct.pack("<B", len(name)) + name + struct.pack("<I", len(places)) + places.astype("<u4").tobytes()


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[bytes]:
    """Terms of sorted ``term, doc_id, pos`` rows in the layout; a term's rows may lie in several batches."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        terms = batch.column("term").dictionary_encode()
        codes = terms.indices.to_numpy()
        places = np.column_stack([batch.column(x).to_numpy() for x in ("doc_id", "pos")])
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for start, stop in zip(cuts, cuts[1:]):
            term = terms.dictionary[int(codes[start])].as_py()
            if term != name:
                if held:
                    yield _entry(name, np.concatenate(held))
                name, held = term, []
            held.append(places[start:stop])
    if held:
        yield _entry(name, np.concatenate(held))


def _ordered(index: Index) -> DataFrame:
    return index.postings.join(term_order(index.terms).select("term", "term_ord"), "term").select("term_ord", "term", "doc_id", "pos")


def _arrays(batches: Sequence[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of ``term, doc_id, pos`` rows: the terms, and each row's term, document and position, in order of all three."""
    terms = pa.chunked_array([x.column("term") for x in batches]).unify_dictionaries()
    names, codes = terms.chunk(0).dictionary, np.concatenate([x.indices.to_numpy() for x in terms.chunks]).astype(np.uint64)
    if any(x.column(k).null_count for x in batches for k in ("doc_id", "pos")):
        raise ValueError("a null document id or position has no place in the binary layout")
    docs, pos = (np.concatenate([x.column(k).to_numpy() for x in batches]).astype(np.int64) for k in ("doc_id", "pos"))
    if ((docs | pos) >> 32).any():
        at = int(np.flatnonzero((docs | pos) >> 32)[0])
        raise ValueError(f"a document id or position of {names[int(codes[at])].as_py()!r} does not fit 32 bits")
    place = docs.astype(np.uint64) << np.uint64(32) | pos.astype(np.uint64)
    if (place[1:] < place[:-1]).any():
        order = np.argsort(place)
        codes, place = codes[order], place[order]
    # codes and rows fit 32 bits each, and sorting them as one number keeps rows of a term in order
    both = np.sort(codes << np.uint64(32) | np.arange(len(codes), dtype=np.uint64))
    place = place[both & np.uint64(0xFFFFFFFF)]
    return names, (both >> np.uint64(32)).astype(np.int64), (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """``_arrays`` of so many batches together as hold some ``PIECE_ROWS`` rows."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(pa.RecordBatch.from_arrays([batch.column("term").dictionary_encode(), batch.column("doc_id"), batch.column("pos")], names=["term", "doc_id", "pos"]))
            rows += batch.num_rows
        if rows >= PIECE_ROWS:
            yield _arrays(held)
            held, rows = [], 0
    if held:
        yield _arrays(held)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``term, block, wide, places``: places of a term in a block of 2**BLOCK_BITS documents, packed as ``PLACE[wide]``; a term and block in several rows."""
    for names, codes, docs, pos in _gathered(batches):
        blocks = docs >> BLOCK_BITS
        starts = np.flatnonzero((np.diff(codes, prepend=-1) != 0) | (np.diff(blocks, prepend=-1) != 0))
        wide = bool((pos >> 16).any())
        places = np.empty(len(docs), PLACE[wide])
        places["doc"], places["pos"] = docs & ((1 << BLOCK_BITS) - 1), pos
        ends = pa.py_buffer((np.append(starts, len(docs)) * places.itemsize).astype(np.int32))
        packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(places.tobytes())])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(codes[starts])), pa.array(blocks[starts]), pa.array(np.full(len(starts), wide)), packed], names=["term", "block", "wide", "places"])


def _places(batch: pa.RecordBatch) -> Iterator[tuple[str, int, np.ndarray]]:
    """Term, block and ``doc_id, pos`` pairs of each row of ``_pieces``."""
    rows, wide, blocks = batch.column("places"), batch.column("wide").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
    sizes = pc.binary_length(rows).to_numpy() // np.where(wide, PLACE[True].itemsize, PLACE[False].itemsize)
    packed = np.concatenate([np.frombuffer(x.as_buffer(), PLACE[w]).astype(PLACE[True]) for x, w in zip(rows, wide.tolist())]) if wide.any() else np.frombuffer(b"".join(rows.to_pylist()), PLACE[False])
    places = np.column_stack([packed["doc"] + (np.repeat(blocks, sizes) << BLOCK_BITS), packed["pos"]]).astype("<u4")
    ends = np.cumsum(sizes).tolist()
    for term, block, start, stop in zip(batch.column("term").to_pylist(), blocks.tolist(), [0, *ends], ends):
        yield term, block, places[start:stop]


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """Entries of each file, by first place, from sorted rows of ``_pieces``. A file that has ``FILE_BYTES`` ends where a term or block does."""
    entries, bytes_, name, last, held, size = [], 0, None, None, [], 0

    def close() -> None:
        nonlocal bytes_, held, size
        if held:
            places = np.concatenate(held)
            at = places[:, 0].astype(np.uint64) << np.uint64(32) | places[:, 1]
            if (at[1:] < at[:-1]).any():
                order = np.argsort(at)
                at, places = at[order], places[order]
            entries.append((int(at[0]), _packed(name, places)))
            bytes_, held, size = bytes_ + len(entries[-1][1]), [], 0

    for batch in batches:
        if not batch.num_rows:
            continue
        for term, block, places in _places(batch):
            if term != name or (block != last and bytes_ + size >= FILE_BYTES):
                close()
                if bytes_ >= FILE_BYTES:
                    yield [x for _, x in sorted(entries)]
                    entries, bytes_ = [], 0
            name, last = term, block
            held.append(places)
            size += places.nbytes
    close()
    if entries:
        yield [x for _, x in sorted(entries)]


def save_binary(index: Index, path: str, files: int | None = None) -> DataFrame:
    """Files in the little-endian layout in the folder ``path``, which all executors reach: ``file, terms`` of each.

    Postings are dealt to files by the hash of term and block of documents, so a frequent term is spread over files that
    each hold a part of its postings; ranges would need all postings packed twice, once to sample them. Each file is an index of its own, in which terms go by first appearance and
    postings by document and position; ``read_binary`` of the folder is the whole. A task that runs again writes the same
    bytes to the same files.

    A task's postings are packed by term and block before they are sent, so the one shuffle holds pieces and not postings.
    """
    spark = index.postings.sparkSession
    prepare(spark)
    pieces = index.postings.select("term", "doc_id", "pos").mapInArrow(_pieces, "term string, block long, wide boolean, places binary")
    parts = pieces.repartition(*([files] if files else []), "term", "block").sortWithinPartitions("term", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = filesystem(path)
        for n, entries in enumerate(_files(batches)):
            name = f"part-{TaskContext.get().partitionId():06d}-{n:06d}.dat"
            with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(struct.pack("<III", MAGIC, BINARY_VERSION, len(entries)))
                f.write(b"".join(entries))
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(entries)], pa.int64())], names=["file", "terms"])

    remove(spark, path)
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    return stored(parts.mapInArrow(run, "file string, terms long"), "files")


def encode_binary(index: Index) -> bytes:
    """The index as one piece in the little-endian layout, for exchange with single-node tools: the driver holds all of it.

    ``save_binary`` writes an index of any size.
    """
    rows = _ordered(index).orderBy("term_ord", "doc_id", "pos").select("term", "doc_id", "pos")
    body = list(_entries(rows.toArrow().to_batches()))
    return struct.pack("<III", MAGIC, BINARY_VERSION, len(body)) + b"".join(body)


def _decoded(data: bytes) -> Iterator[tuple[str, np.ndarray]]:
    magic, _, count = struct.unpack_from("<III", data, 0)
    if magic != MAGIC:
        raise ValueError("not an index file")
    at = 12
    for _ in range(count):
        size = data[at]
        term = data[at + 1 : at + 1 + size].decode("utf-8")
        (n,) = struct.unpack_from("<I", data, at + 1 + size)
        at += 5 + size
        yield term, np.frombuffer(data, "<u4", 2 * n, at).reshape(n, 2)
        at += 8 * n


def decode_binary(data: bytes) -> Iterator[tuple[str, int, int]]:
    """``term, doc_id, pos`` of the layout; another magic number raises, another version is read as well as it goes."""
    for term, places in _decoded(data):
        for doc, pos in places.tolist():
            yield term, doc, pos


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """``term, doc_id, pos`` of the index files of a file or folder in the binary layout; a file is a task, its rows go out in batches."""
    prepare(spark)

    def batch(held: list[tuple[str, np.ndarray]]) -> pa.RecordBatch:
        places = np.concatenate([x for _, x in held])
        terms = pa.array([x for x, _ in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), [len(x) for _, x in held])))
        return pa.RecordBatch.from_arrays([terms, pa.array(places[:, 0].astype("i8")), pa.array(places[:, 1].astype("i4"))], names=["term", "doc_id", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for data in got.column(0):
                held, rows = [], 0
                for term, places in _decoded(data.as_py()):
                    for start in range(0, len(places), BATCH_ROWS):
                        held.append((term, places[start : start + BATCH_ROWS]))
                        rows += len(held[-1][1])
                        if rows >= BATCH_ROWS:
                            yield batch(held)
                            held, rows = [], 0
                if held:
                    yield batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "term string, doc_id long, pos int")
