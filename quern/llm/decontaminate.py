"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows.

Items are normalised to words; every window of consecutive words becomes a path of word numbers
in the automaton, which reads each document's words once. Matched words are mapped back to code
point offsets of the original text.

The items' words are counted first. The automaton takes some 600 bytes for each in every worker, and
the items are broadcast, so a benchmark of more than ``most`` words raises an error: it needs a greater ``most`` and workers that hold it.

Defined results: null and empty texts have no words and no hits; long texts are scanned whole; null or wordless items never occur; items
with a null id mark words but are not listed; items of one id are one item in the list, and items that tie in their words are all listed; repeated
documents each get their row; other columns, whatever their names, are ignored by ``scan`` and kept by ``clean``; an empty table of documents gives no rows, one of items no hits.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import memo
from quern.plans.arrow import slices
from quern.plans.shared import prepare

#: Words of items in the automaton at most; a window of ten words takes ten nodes of some 60 bytes.
MOST_WORDS = 2_000_000
#: ASCII letters in lower case, digits, and every byte of other characters stay; the rest parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: The same words for SQL and DataFrame functions, after A-Z are lower-cased.
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


class Windows:
    """The automaton, and the numbers of the words that occur in it."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.number: dict[bytes, int] = {}
        paths: dict[tuple, set] = {}
        for item, text in items:
            got = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            for i in range(max(1, len(got) - size + 1) if got else 0):
                paths.setdefault(tuple(got[i : i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for path, ids in paths.items():
            self.automaton.add_word(path, (len(path), ids))
        if paths:
            self.automaton.make_automaton()
        self.any = bool(paths)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Runs of hit words (first, end) and the items that occur."""
        runs, items = [], set()
        if self.any and words:
            for end, (size, ids) in self.automaton.iter(tuple([self.number.get(w, 0) for w in words])):
                items |= ids
                runs.append((end - size + 1, end + 1))
        merged: list[tuple[int, int]] = []
        for first, end in sorted(runs):
            if merged and first <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((first, end))
        return merged, items


_built: dict[tuple, Windows] = {}


def _windows(items: list[tuple[str | None, str]], size: int) -> Windows:
    memo.only("decontaminate", _built.clear)
    key = (size, len(items), zlib.crc32(repr(items).encode("utf-8", "surrogatepass")))
    if key not in _built:
        _built.clear()
        _built[key] = Windows(items, size)
    return _built[key]


def _items(benchmark: DataFrame, most: int) -> list[tuple[str | None, str]]:
    """The items' ids and texts on the driver, once their words are counted."""
    texts = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("body")).where(F.length("body") > 0)
    count = int(texts.agg(F.sum(F.regexp_count("body", F.lit(WORD.pattern))).alias("n")).first().n or 0)
    if count > most:
        raise ValueError(f"the benchmark has {count} words, the automaton is bounded to {most}")
    # only words reach the driver, so the bound holds for what is broadcast
    return [(r.item, r.body) for r in texts.select("item", F.regexp_replace("body", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ").alias("body")).collect()]


def _hit(items: list, spark: SparkSession, size: int):
    """A function of a text column: whether a window of an item occurs."""
    shared = spark.sparkContext.broadcast(items)

    @F.arrow_udf("boolean")
    def hit(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        windows = _windows(shared.value, size)
        for batch in batches:
            found: list[bool] = []
            for part in slices([pa.RecordBatch.from_arrays([batch], names=["text"])], "text"):
                found += [bool(windows.scan(words_of(t))[0]) for t in part.column(0).to_pylist()]
            yield pa.array(found, pa.bool_())

    return hit


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no window of an item occurs."""
    prepare(docs.sparkSession)
    return docs.where(~_hit(_items(benchmark, most), docs.sparkSession, size)(F.col(f"`{text_col}`").cast("string")))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_WORDS) -> DataFrame:
    """``id_col, n_words, spans, items`` for each document.

    spans: runs of hit words as code point offsets of the text and their number of words, in order; items: ids
    of the items of which a window occurs, sorted as strings.
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_items(benchmark, most))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(shared.value, size)
        for batch in slices(batches, "text"):
            counts, spans, found = [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                runs, items = windows.scan(words)
                counts.append(len(words))
                at = [m.span() for m in WORD.finditer(text)] if runs else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1], "words": b - a} for a, b in runs])
                found.append(sorted(x for x in items if x is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(found, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"])

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_words long, spans array<struct<start:int,end:int,words:int>>, items array<string>")
