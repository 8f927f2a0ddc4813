"""Token ids in flat binary files that are read by memory map.

A shard is three files: ``.bin``, the ids of its documents one after another as unsigned
integers (16 bits where the vocabulary allows, else 32, little-endian); ``.idx``, 64-bit offsets of the
documents in it (one more than documents); ``.doc``, 64-bit document ids. ``manifest.json`` lists the
shards in document order, each with its base: the number of ids before it, a prefix sum.

Each task writes shards of about ``SHARD`` bytes under names of its own and reports them; only reported shards enter the
manifest, so retried and lost tasks leave nothing that is read. Shards are written by range of
document id and hold whole documents.

Defined results: null and empty texts have the end id only; long texts are encoded whole; null document ids come first; rows with equal ids
follow each other by text, and rows that tie in both each have their ids; other columns, whatever their names, are ignored; an empty table gives a manifest
without shards. Ids are cached by run of characters between spaces, tabs and line ends: the tokenizer must drop white
space and split there, which ``check_splits`` proves from its file.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.plans import memo
from quern.plans.arrow import slices
from quern.plans.shared import filesystem, new_path, prepare

#: Bytes of ids, about, after which a task begins another shard: what it holds of a shard does not grow with the table.
SHARD = 256 << 20
#: Runs of characters that a worker keeps, some 200 bytes each; more only cost time.
CACHE_ENTRIES = 1_000_000
#: Runs of ASCII that the tokenizer splits into these pieces, as its own pattern does once they are in lower case.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACES = "\t\n\r"


def check_splits(tokenizer: str) -> bool:
    """Whether texts may be encoded by runs between white space: white space becomes a space and is dropped before merges."""
    spec = json.loads(tokenizer)
    steps = lambda x, key: x[key] if x and x["type"] == "Sequence" else [x] if x else []
    norm, pre = steps(spec["normalizer"], "normalizers"), steps(spec["pre_tokenizer"], "pretokenizers")
    known = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in norm)
    split = bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"] and pre[0]["pattern"] == {"Regex": PATTERN}
    bytewise = len(pre) == 2 and pre[1]["type"] == "ByteLevel" and not pre[1]["add_prefix_space"]
    # special tokens begin with a mark that no run without it can hold
    plain = all(a["content"].startswith("<") and not (a["lstrip"] or a["rstrip"] or a["single_word"]) and not set(a["content"]) & set(" \t\n\r") for a in spec["added_tokens"])
    return known and split and bytewise and plain and not spec["truncation"] and not spec["padding"] and not spec["post_processor"]


class Encoder(dict):
    """Ids of texts as bytes of ``dtype``; as a dict it holds those of runs of characters."""

    def __init__(self, spec: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(spec)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.by_run = check_splits(spec)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def __missing__(self, run: str) -> bytes:
        pieces = [run]
        if run.isascii():
            if "<" not in run:  # which may begin a special token
                pieces = PIECE.findall(run.lower())
        elif len(run) > 1 and run[-1] in ",." and (run[-2].isascii() and run[-2].isalpha() or "\xdf" <= run[-2] <= "\xf6" or "\xf8" <= run[-2] <= "\xff"):
            # a Latin letter and a mark of ASCII are never in one piece, nor one composed character
            pieces = [run[:-1], run[-1]]
        got = self._ids(run) if pieces == [run] else b"".join([self[x] for x in pieces])
        if len(run) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[run] = got
        return got

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_run:
            return self._ids(text)
        for c in SPACES:
            text = text.replace(c, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


_encoders: dict[int, Encoder] = {}


def encoder(spec: str) -> Encoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(spec)
        _encoders[key][""] = b""
    return _encoders[key]


def write(df: DataFrame, tokenizer: str, end_id: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of every whole text, each followed by ``end_id``; returns the folder.

    ``path`` is a URI that all executors reach; by default a new folder beside the checkpoints. What reaches
    the driver is a row for each shard.
    """
    spark = df.sparkSession
    prepare(spark)
    path = path or new_path(spark, "tokens")
    with open(tokenizer, encoding="utf-8") as f:  # on the driver; a vocabulary is a few MB
        spec = spark.sparkContext.broadcast(f.read())
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo.only("token_files", _encoders.clear)
        own, task, shards, files = encoder(spec.value), TaskContext.get(), [], None
        end = np.array([end_id], dtype=own.dtype).tobytes()
        system, folder = filesystem(path)

        def close() -> None:
            files.close()
            shard = shards[-1]
            offsets = np.concatenate([[0], np.cumsum(shard["lengths"])]).astype("<i8")
            for ext, data in (("idx", offsets), ("doc", np.array(shard["ids"], dtype="<i8"))):
                with system.open_output_stream(f"{folder}/{shard['name']}.{ext}") as f:
                    f.write(data.tobytes())
            shards[-1] = {"part": task.partitionId(), "seq": len(shards), "name": shard["name"], "docs": len(offsets) - 1, "ids": int(offsets[-1]), "nulls": shard["nulls"], "dtype": own.dtype.str}

        for batch in slices(batches, text_col):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if files is None or size > SHARD:
                    if files is not None:
                        close()
                    system.create_dir(folder, recursive=True)
                    shards.append({"name": f"shard-{task.partitionId():06d}-{task.taskAttemptId()}-{len(shards):04d}", "lengths": [], "ids": [], "nulls": 0})
                    files, size = system.open_output_stream(f"{folder}/{shards[-1]['name']}.bin"), 0
                data = own.encode(text) + end
                files.write(data)
                size += len(data)
                shards[-1]["lengths"].append(len(data) // own.dtype.itemsize)
                shards[-1]["ids"].append(doc or 0)
                shards[-1]["nulls"] += doc is None
        if files is not None:
            close()
            kinds = [("part", pa.int64()), ("seq", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64()), ("dtype", pa.string())]
            yield pa.RecordBatch.from_pylist(shards, schema=pa.schema(kinds))

    ordered = df.select(F.col(id_col).cast("long").alias(id_col), text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    shards = sorted(ordered.mapInArrow(run, "part long, seq long, name string, docs long, ids long, nulls long, dtype string").collect(), key=lambda r: (r.part, r.seq))
    listed, base = [], 0
    for r in shards:
        listed.append({"name": r.name, "base": base, "docs": r.docs, "ids": r.ids, "nulls": r.nulls, "dtype": r.dtype})
        base += r.ids
    with system.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"ids": base, "shards": listed}).encode())
    return path


def _mapped(path: str, dtype: str) -> np.ndarray:
    """The file as an array: by memory map where it lies in a mounted folder, else read."""
    system, name = filesystem(path)
    if system.get_file_info(name).size == 0:
        return np.zeros(0, dtype=dtype)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype=dtype, mode="r")
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked, ``ids`` (array), of every document in the files."""
    prepare(spark)
    system, folder = filesystem(path)
    with system.open_input_file(f"{folder}/manifest.json") as f:
        shards = json.loads(f.read())["shards"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():  # a task for each shard
                s = shards[at]
                base = f"{path}/{s['name']}"
                flat, offsets, docs = _mapped(f"{base}.bin", s["dtype"]), _mapped(f"{base}.idx", "<i8"), _mapped(f"{base}.doc", "<i8")
                if len(offsets) != s["docs"] + 1 or len(flat) != s["ids"] or offsets[-1] != s["ids"]:
                    raise OSError(f"{base} does not agree with the manifest")
                for first in range(0, s["docs"], 1000):
                    rows = []
                    for i in range(first, min(first + 1000, s["docs"])):
                        own = flat[offsets[i] : offsets[i + 1]]
                        row = [None if i < s["nulls"] else int(docs[i]), s["base"] + int(offsets[i]), len(own), zlib.crc32(own.astype("<u4").tobytes())]
                        rows.append(row + [own.astype(np.int32)] * ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids)
