"""Removal of long repeated byte strings by run-compressed Burrows-Wheeler indexes.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else in the corpus goes.
Equal strings must meet in one index, so texts are cut by content first: the least hash of a
string's ``GRAM``-byte substrings is its key, and consecutive strings with one key are a segment. Keys that occur once have no
match and drop out. The segments of the other keys are gathered by key, equal ones once with a count, and for
blocks of whole keys a run-compressed BWT is built with the suffix array sampled at the ends of its
runs. Matching statistics then stream along the block: at a sampled position the match with the
neighbouring suffix is measured, from there on it shrinks by one with each step until the next sample. Matches of ``LENGTH`` or more
are marked and mapped back to all texts that hold the segment.

A key that more than ``HOT`` different segments share (a common line whose surroundings differ) is not gathered as
segments: its strings are counted by hash one by one, and only those counted twice go to an index, each
keyed by its own hash. So no key gathers an unbounded block, and no string is left out.

Texts are shuffled once, to join equal ones. Later passes read the joined table and, beside it, small files of
positions in the same order.

Defined results: a null text is empty; texts shorter than ``LENGTH`` lose nothing; long texts are matched whole; rows are matched across ids, so a
repeated row, or one that ties in its text, is a copy like any other and loses all of its strings; null ids and other columns, whatever their names, do not matter; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.arrow import slices
from quern.plans.names import fresh
from quern.plans.shared import dropped, filesystem, new_path, prepare, remove, stored

LENGTH, GRAM = 200, 32
#: Strings of one segment at most, different segments of a key before its strings are counted one by one, symbols of one index (about HOT segments).
STRINGS, HOT, BLOCK = 256, 4_000, 1_500_000
#: Bytes hashed at once: their arrays fit a core's cache.
AT_ONCE = 96 << 10
#: Hashes that can be numbered in the low bits of a hash.
PLACES = 1 << 24
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SCATTER = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)


# ---- positions and hashes -------------------------------------------------------------------


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column one after another, and where each value begins (and the last ends)."""
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _joined(h: np.ndarray, m: int, tail: np.ndarray | None = None) -> np.ndarray:
    """Hashes of substrings from those of their halves, the second one ``m`` further on."""
    more = h if tail is None else tail
    n = min(len(h), len(more) - m)
    out = h[:n] * GOLDEN + more[m : m + n]
    out ^= out >> np.uint64(29)
    return out


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each substring of ``size`` bytes."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    power, done, out = SCATTER[data], 0, None
    m = 1
    while True:
        if size & m:
            # what is hashed so far comes after the new part
            out, done = (power, m) if out is None else (_joined(power, m, out), done + m)
        if done == size:
            return out[: len(data) - size + 1]
        power, m = _joined(power, m), m * 2


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    m = 1
    while 2 * m <= width:
        h, m = np.minimum(h[:-m], h[m:]), 2 * m
    return np.minimum(h[: len(h) - (width - m)], h[width - m :]) if width > m else h


def ends_of_least(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the least value (by its high 40 bits) of each ``width`` values in a row."""
    n = max(0, len(h) - width + 1)
    first, final, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.uint64(PLACES - 1)
    step = PLACES - width
    for a in range(0, n, step):
        # places within a part fit the low bits
        part = h[a : a + step + width - 1]
        place, high = np.arange(len(part), dtype=np.uint64), part & ~low
        first[a : a + step] = (least(high | place, width) & low).astype(np.int64) + a
        final[a : a + step] = (low - (least(high | (low - place), width) & low)).astype(np.int64) + a
    return first, final


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``text, start, strings, key, inside`` of each segment of texts that lie one after another in ``data``.

    inside: whether a string may occur twice within the segment, since its key does.
    """
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    h, width = hashes(data, gram), length - gram + 1
    first, final = ends_of_least(h, width)
    value = h[first]
    ok = np.zeros(len(value), bool)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= length:
            ok[a : b - length + 1] = True
    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (value[1:] != value[:-1])
    starts = np.flatnonzero(begins)
    strings = np.bincount(np.cumsum(begins)[ok] - 1, minlength=len(starts)).astype(np.int64)
    if len(starts) and strings.max() > STRINGS:
        parts = -(-strings // STRINGS)
        n = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        strings = np.minimum(STRINGS, np.repeat(strings, parts) - n * STRINGS)
        starts = np.repeat(starts, parts) + n * STRINGS
    text = np.searchsorted(at, starts, side="right") - 1
    inside = first[starts] != final[starts + strings - 1]
    return text, starts - at[text], strings, value[starts], inside


# ---- the index ------------------------------------------------------------------------------


def packed(t: np.ndarray) -> np.ndarray:
    """Seven symbols of ``t`` (below 511) from each place on in one integer, which orders like them; past the end they are least."""
    out = np.zeros(len(t), np.int64)
    for i in range(7):
        out[: len(t) - i] |= (t[i:].astype(np.int64) + 1) << (9 * (6 - i))
    return out


def suffix_array(key: np.ndarray) -> np.ndarray:
    """Suffixes of a text, given ``packed``, in order: by doubling the length that ranks cover; only ties are sorted again."""
    n, k = len(key), 7
    sa = np.argsort(key)
    ordered = key[sa]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    places = np.flatnonzero(~(head & np.append(head[1:], True)))
    while len(places):
        # places of the suffix array whose suffix is not alone in its group
        own = sa[places]
        after = own + k
        after = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        pair = rank[own].astype(np.int64) << 32 | after
        order = np.argsort(pair)
        own, pair = own[order], pair[order]
        sa[places] = own
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[own] = np.maximum.accumulate(np.where(new, places, 0))
        # a group's places lie together: alone is who begins a group and is followed by another's beginning
        places, k = places[~(new & np.append(new[1:], True))], k * 2
    return sa


def run_index(t: np.ndarray, key: np.ndarray) -> dict[str, np.ndarray]:
    """The run-compressed BWT of ``t`` (``key``: packed): the first place of each run, and the suffix array at both ends of runs and next to them.

    Matching statistics of a text against itself need the runs' ends alone: between them they shrink by one from place to place.
    """
    sa = suffix_array(key)
    bwt = t[sa - 1]  # the first suffix's predecessor is the last symbol
    first = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
    last = np.append(first[1:], len(t)) - 1
    # what stands before the text must not join a run: its place is sampled as well
    whole = int(np.flatnonzero(sa == 0)[0])
    first = np.union1d(first, [whole, *([whole + 1] if whole + 1 < len(t) else [])])
    last = np.union1d(last, [whole, *([whole - 1] if whole else [])])
    return {"first": first, "first_sa": sa[first], "before_sa": sa[first - 1], "last_sa": sa[last], "after_sa": sa[(last + 1) % len(t)]}


def common(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b of a text, given ``packed``: seven symbols at a time."""
    n, out = len(key), np.zeros(len(a), np.int64)
    live = np.flatnonzero(a != b)
    a, b = a[live], b[live]
    while len(live):
        differ = key[a] ^ key[b]
        more = differ == 0
        ended = live[~more]
        differ = differ[~more]
        out[ended] += sum((differ < 1 << (63 - 9 * i)).astype(np.int64) for i in range(1, 7))
        live, a, b = live[more], a[more] + 7, b[more] + 7
        out[live] += 7
        # packed symbols past the end differ from any in the text, so equal ones lie within it
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
    return out


def statistics(t: np.ndarray) -> np.ndarray:
    """For each position of ``t`` the length of the longest string that starts there and also starts elsewhere in ``t``."""
    key = packed(t)
    index = run_index(t, key)
    n, out = len(t), np.zeros(len(t), np.int64)
    for own, other in (("first_sa", "before_sa"), ("last_sa", "after_sa")):
        place, match = index[own], common(key, index[own], index[other])
        if own == "first_sa":
            match[index["first"] == 0] = 0  # nothing comes before the first suffix
        else:
            match[-1] = 0
        # place 0 of the text is sampled, so every position has a sample at or before it
        at, value = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        at[place], value[place] = place, match
        at = np.maximum.accumulate(at)
        out = np.maximum(out, value[at] - (np.arange(n) - at))
    return out


def block_marks(texts: list[bytes], copies: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each text of a block which of its strings of ``length`` start more than once in the corpus.

    A text stands in the index once. If it stands for several copies, each position matches the other copies as far as the text goes.
    """
    parts, starts, size = [], [], 0
    for text in texts:
        starts.append(size)
        parts += [np.frombuffer(text, np.uint8).astype(np.int16) + 1, np.zeros(1, np.int16)]
        size += len(text) + 1
    match = statistics(np.concatenate(parts))
    for at, text, n in zip(starts, texts, copies):
        if n > 1:
            own = match[at : at + len(text)]
            np.maximum(own, np.arange(len(text), 0, -1), out=own)
    # strings end within their text, so matches of their length hold no separator
    return [match[a : a + max(0, len(x) - length + 1)] >= length for a, x in zip(starts, texts)]


# ---- passes over the corpus -------------------------------------------------------------------


def _beside(path: str, part: int, columns: list[str]) -> dict[str, np.ndarray]:
    """The files of positions that belong to a part of the joined table, ordered by id."""
    system, folder = filesystem(f"{path}/part={part}")
    names = [x.path for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".parquet")]
    tables = [pq.read_table(n, columns=columns, filesystem=system, partitioning=None) for n in names]
    if not tables:
        return {c: np.zeros(0, np.int64) for c in columns}
    got = pa.concat_tables(tables).sort_by([("id", "ascending"), (columns[1], "ascending")])
    return {c: got.column(c).to_numpy() for c in columns}


def _put_beside(df: DataFrame, name: str) -> str:
    """Write positions by part of the joined table, for ``_beside``."""
    path = new_path(df.sparkSession, name)
    df.withColumn("part", F.shiftrightunsigned("id", 33)).repartition("part").write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def _with_beside(batches: Iterator[pa.RecordBatch], path: str, columns: list[str]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, dict]]]]:
    """Slices of the joined table (id first, text last) and, for rows that have any, what lies beside them."""
    part, rows = None, {}
    for batch in slices(batches, "text"):
        ids, found = batch.column(0).to_numpy(), []
        for i, x in enumerate(ids.tolist()):
            if x >> 33 != part:
                part, rows = x >> 33, _beside(path, x >> 33, columns)
            a, b = np.searchsorted(rows["id"], (x, x + 1))
            if b > a:
                found.append((i, {c: v[a:b] for c, v in rows.items()}))
        yield batch, found


def _keys(texts: DataFrame) -> DataFrame:
    """``key, sign, id, start, strings, copies, inside`` of every segment; sign is a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", AT_ONCE):
            data, at = flat(batch.column(2))
            text, start, strings, key, inside = segments(data, at)
            whole, first = memoryview(data.tobytes()), at[text] + start
            sign = np.array([xxhash.xxh3_64_intdigest(whole[a:b]) for a, b in zip(first.tolist(), (first + strings + LENGTH - 1).tolist())], np.uint64)
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(sign.view(np.int64)), pa.array(ids[text]), pa.array(start.astype(np.int32)), pa.array(strings.astype(np.int32)), pa.array(copies[text]), pa.array(inside)],
                names=["key", "sign", "id", "start", "strings", "copies", "inside"],
            )

    return texts.select("id", "copies", "text").mapInArrow(run, "key long, sign long, id long, start int, strings int, copies int, inside boolean")


def _pieces(texts: DataFrame, path: str) -> DataFrame:
    """``key, sign, copies, piece``: bytes and number of the segments that lie beside, each once for a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _with_beside(batches, path, ["id", "start", "strings", "key", "sign"]):
            seen: dict[tuple[int, int], list] = {}
            copies, column = batch.column(1).to_pylist(), batch.column(2)
            for i, own in found:
                text = column[i].as_buffer().to_pybytes()
                for start, strings, *name in zip(*(own[c].tolist() for c in ("start", "strings", "key", "sign"))):
                    held = seen.get(name := tuple(name))
                    if held is None:
                        seen[name] = [copies[i], text[start : start + strings + LENGTH - 1]]
                    else:
                        held[0] += copies[i]
            if seen:
                keys, signs = zip(*seen)
                counts, pieces = zip(*seen.values())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(signs, pa.int64()), pa.array(counts, pa.int64()), pa.array(pieces, pa.binary())], names=["key", "sign", "copies", "piece"])

    return texts.select("id", "copies", "text").mapInArrow(run, "key long, sign long, copies long, piece binary")


def _strings(texts: DataFrame, path: str) -> DataFrame:
    """``key, sign, id, start, copies`` of every single string of the segments beside, by its own hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _with_beside(batches, path, ["id", "start", "strings"]):
            ids, copies, column = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, own in found:
                text = column[i].as_buffer()
                h, n = hashes(np.frombuffer(text, np.uint8), LENGTH), own["strings"].astype(np.int64)
                start = np.repeat(own["start"].astype(np.int64), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                whole = memoryview(text)
                sign = np.array([xxhash.xxh3_64_intdigest(whole[a : a + LENGTH]) for a in start.tolist()], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h[start].view(np.int64)), pa.array(sign.view(np.int64)), pa.array(np.full(len(start), ids[i])), pa.array(start.astype(np.int32)), pa.array(np.full(len(start), copies[i], np.int32))], names=["key", "sign", "id", "start", "copies"])

    return texts.select("id", "copies", "text").mapInArrow(run, "key long, sign long, id long, start int, copies int")


def _indexed(pieces: DataFrame) -> DataFrame:
    """``key, sign, ranges``: of each distinct piece the marked strings, as pairs of first and end."""
    distinct = pieces.groupBy("key", "sign").agg(F.sum("copies").alias("copies"), F.max("piece").alias("piece"))

    def marked(rows: list[tuple]) -> pa.RecordBatch:
        found = block_marks([r[3] for r in rows], [r[2] for r in rows])
        keys, signs, ranges = [], [], []
        for (key, sign, _, _), marks in zip(rows, found):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
            if len(edges):
                keys.append(key)
                signs.append(sign)
                ranges.append(edges.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(signs, pa.int64()), pa.array(ranges, pa.list_(pa.int32()))], names=["key", "sign", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in slices(batches, "piece"):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK and row[0] != rows[-1][0]:
                    yield marked(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3]) + 1
        if rows:
            yield marked(rows)

    return distinct.repartition("key").sortWithinPartitions("key").select("key", "sign", "copies", "piece").mapInArrow(run, "key long, sign long, ranges array<int>")


def _spans(places: DataFrame, pieces: DataFrame) -> DataFrame:
    """``id, start, end``: byte ranges that are covered, of texts that have a piece at ``places`` (key, sign, id, start)."""
    hits = places.select("key", "sign", "id", F.col("start").alias("at")).join(_indexed(pieces), ["key", "sign"])
    pairs = hits.select("id", "at", F.posexplode("ranges").alias("n", "a"), "ranges").where("n % 2 = 0")
    return pairs.select("id", (F.col("at") + F.col("a")).alias("start"), (F.col("at") + F.get("ranges", F.col("n") + 1) + LENGTH - 1).alias("end"))


def _kept(texts: DataFrame, path: str) -> DataFrame:
    """``node, n_bytes, spans, kept`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _with_beside(batches, path, ["id", "start", "end"]):
            kept, spans = batch.column(2).cast(pa.binary()).to_pylist(), [[] for _ in range(batch.num_rows)]
            sizes = [len(x) for x in kept]
            for i, own in found:
                cover = np.zeros(sizes[i] + 1, np.int32)
                np.add.at(cover, own["start"], 1)
                np.add.at(cover, own["end"], -1)
                gone = np.cumsum(cover)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2)
                spans[i] = [{"start": a, "end": b} for a, b in edges.tolist()]
                kept[i] = np.frombuffer(kept[i], np.uint8)[~gone].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())], names=["node", "n_bytes", "spans", "kept"])

    return texts.select("id", "node", "text").mapInArrow(run, "node binary, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def removed(df: DataFrame, text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """``df`` with one more column that names its text, and for each name ``n_bytes, spans, kept``, the name first.

    The column of names is ``node``, or a longer name if ``df`` has that; spans: maximal runs of removed bytes, in order; kept: the bytes that remain.
    """
    spark = df.sparkSession
    prepare(spark)
    (name,) = fresh([*df.columns, "n_bytes", "spans", "kept"], "node")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.withColumn(name, F.unhex(F.md5(text.cast("binary"))))
    joined = rows.select(F.col(name).alias("node"), text.alias("text")).groupBy("node").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = stored(joined.select(F.monotonically_increasing_id().alias("id"), "node", F.least("copies", F.lit(2)).cast("int").alias("copies"), "text"), "texts")
    keys = stored(_keys(texts), "keys")
    by_sign = keys.groupBy("key", "sign").agg(F.sum("copies").alias("n"), F.max("inside").alias("inside"))
    counted = by_sign.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("signs"), F.max("inside").alias("inside")).where("n > 1 OR inside").select("key", (F.col("signs") > hot).alias("hot"))
    again = stored(keys.select("key", "sign", "id", "start", "strings").join(counted, "key"), "again")
    dropped(keys)
    places = again.where("NOT hot")
    paths = [_put_beside(places.select("id", "start", "strings", "key", "sign"), "positions")]
    pieces = [stored(_pieces(texts, paths[0]), "pieces")]
    spans = _spans(places, pieces[0])
    common_ = again.where("hot").select("id", "start", "strings")
    if common_.take(1):
        paths.append(_put_beside(common_, "common"))
        single = stored(_strings(texts, paths[-1]), "strings")
        twice = single.groupBy("key", "sign").agg(F.sum("copies").alias("n")).where("n > 1").select("key", "sign")
        places = stored(single.join(twice, ["key", "sign"]).select("key", "sign", "id", "start", F.lit(1).alias("strings")), "places")
        paths.append(_put_beside(places.select("id", "start", "strings", "key", "sign"), "positions"))
        pieces.append(stored(_pieces(texts, paths[-1]), "pieces"))
        spans = spans.unionByName(_spans(places, pieces[-1]))
    beside = _put_beside(spans, "spans")
    dropped(again, *pieces)
    for path in paths:
        remove(spark, path)
    return rows, _kept(texts, beside).withColumnRenamed("node", name)
