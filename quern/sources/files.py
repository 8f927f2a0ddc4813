"""Documents from folders of text, HTML, PDF and DOCX files."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import text as T
from quern.plans.shared import filesystem, prepare

#: Limits for ``most_bytes``, beyond which a file of a kind gives a document without content.
MOST_BYTES = {"html": 50 << 20, "pdf": 50 << 20, "docx": 30 << 20}
#: Names of the files of a kind, in either case.
GLOBS = {"txt": "*.[tT][xX][tT]", "html": "{*.[hH][tT][mM],*.[hH][tT][mM][lL]}", "pdf": "*.[pP][dD][fF]", "docx": "*.[dD][oO][cC][xX]"}
# Stop words where a stop word file is missing.
BUILT_IN = "the a an is are was were of to in on and or for with at by it as be this that from which he she they we you i 的 了 在 是 我 有 和 就 不 人 都 一 也 很 到 说 要 去 你 会".split()
#: Shorter strings are not taken where a PDF has no text operators.
LEAST_STRING = 4
# One-letter escapes of PDF strings.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def pdf_string(data: str, at: int) -> tuple[str, int]:
    """A literal string that begins at ``(``, and the place after it."""
    out, depth, i = [], 1, at + 1
    while i < len(data):
        c = data[i]
        if c == "\\":
            octal = re.compile(r"[0-7]{1,3}").match(data, i + 1)
            if octal:
                out.append(chr(int(octal[0], 8) & 255))
                i = octal.end()
                continue
            nxt = data[i + 1 : i + 2]
            out.append(ESCAPES.get(nxt, nxt))
            i += 2
            continue
        depth += (c == "(") - (c == ")")
        if not depth:
            return "".join(out), i + 1
        out.append(" " if c in "\r\n" else c)
        i += 1
    return "".join(out), i


def _shown(block: str) -> list[str]:
    """Strings that a BT..ET block shows, in order: operands of Tj, ' and ", and of TJ arrays."""
    out, held, i, inside = [], [], 0, False
    while i < len(block):
        c = block[i]
        if c == "(":
            found, i = pdf_string(block, i)
            held.append(found)
            continue
        if c in "[]":
            inside = c == "["
        elif not inside and (word := re.compile(r"[A-Za-z'\"*]+").match(block, i)):
            if word[0] in ("Tj", "TJ", "'", '"'):
                out += held
            held = []
            i = word.end()
            continue
        i += 1
    return out


def pdf_text(data: bytes | None) -> str:
    """Text of the page streams of a PDF; without any, all longer literal strings in the file."""
    out: list[str] = []
    raw = data or b""
    for found in re.finditer(rb"stream\r?\n", raw):
        if raw[max(0, found.start() - 3) : found.start()] == b"end":
            continue
        header = raw[max(0, raw.rfind(b"obj", 0, found.start())) : found.start()]
        size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", header)
        end = found.end() + int(size[1]) if size else raw.find(b"endstream", found.end())
        body = raw[found.end() : end if end > 0 else len(raw)]
        if b"/FlateDecode" in header:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        for block in re.finditer(r"(?<![A-Za-z0-9])BT\b(.*?)\bET\b", body.decode("latin-1"), re.S):
            out += _shown(block[1])
    if not out:
        plain, i = raw.decode("latin-1"), 0
        while (i := plain.find("(", i)) >= 0:
            if i and plain[i - 1] == "\\":
                i += 1
                continue
            found_, after = pdf_string(plain, i)
            if len(found_) >= LEAST_STRING:
                out.append(found_)
                i = after
            else:
                i += 1
    return "".join(x if x.endswith((" ", "\n")) else f"{x} " for x in out)


def docx_xml(data: bytes | None, join: bool = False) -> str:
    """The main part of a DOCX, with a line break after each paragraph unless ``join``; empty if there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            name = next((n for n in z.namelist() if n.startswith("word/document.xml")), None)
            xml = z.read(name).decode("utf-8", "replace") if name else ""
    except (zipfile.BadZipFile, zlib.error, NotImplementedError, EOFError):
        return ""
    return xml if join else xml.replace("</w:p>", "</w:p><br>")


@F.pandas_udf(StringType())
def pdf_column(data: pd.Series) -> pd.Series:
    return data.map(pdf_text)


@F.pandas_udf(StringType())
def docx_column(data: pd.Series) -> pd.Series:
    return data.map(docx_xml)


@F.pandas_udf(StringType())
def joined_docx_column(data: pd.Series) -> pd.Series:
    return data.map(lambda x: docx_xml(x, join=True))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _passed_over(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``file_name, length, content`` of files whose names begin with . or _, which Spark's readers pass over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base.rstrip('/')}/{name}") as f:
                    data = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["file_name", "length", "content"])

    return spark.createDataFrame([(n,) for n in names], "file_name string").mapInArrow(run, "file_name string, length long, content binary")


def read_documents(spark: SparkSession, folder: str, docx_join: bool = False, max_bytes: int | None = None, most_bytes: dict[str, int] | None = None) -> DataFrame:
    """``doc_id, file_name, text, modified`` of the supported files of a folder, not its subfolders.

    Ids number the files by name from 0. Text is in lower case of ASCII; a text file ends at its first NUL; empty
    files give empty text, as do files larger than ``most_bytes`` has for their kind. ``max_bytes`` cuts texts, at whole characters.
    """
    prepare(spark)
    found = listed(spark, folder)
    docx = joined_docx_column if docx_join else docx_column
    plain = lambda content: F.make_valid_utf8(content.cast("string"))
    read = {"txt": lambda c: F.substring_index(plain(c), "\x00", 1), "html": lambda c: T.html_text(plain(c)), "pdf": pdf_column, "docx": lambda c: T.html_text(docx(c))}
    # each kind's files are read by themselves, so that bytes are read once and only PDF and DOCX files reach Python
    out = spark.createDataFrame([], "file_name string, text string")
    for kind in sorted({_kind(name) for name, *_ in found} & set(read)):
        files = spark.read.format("binaryFile").option("pathGlobFilter", GLOBS[kind]).load(folder).select(_name("path").alias("file_name"), "length", "content")
        if hidden := [name for name, *_ in found if name[0] in "._" and _kind(name) == kind]:
            files = files.unionByName(_passed_over(spark, folder, hidden))
        most = (most_bytes or {}).get(kind)
        content = F.col("content") if most is None else F.when(F.col("length") <= most, F.col("content"))
        out = out.unionByName(files.select("file_name", T.ascii_lower(F.coalesce(read[kind](content), F.lit(""))).alias("text")))
    if max_bytes:
        out = out.withColumn("text", T.head_bytes(F.col("text"), max_bytes))
    names = sorted(name for name, *_ in found if _kind(name) != "unknown")
    times = {name: at for name, _, at in found}
    ids = spark.createDataFrame([(i, name, times[name]) for i, name in enumerate(names)], "doc_id long, file_name string, modified timestamp")
    # readers pass over empty files: those have their row from the listing
    return ids.join(out, "file_name", "left").select("doc_id", "file_name", F.coalesce("text", F.lit("")).alias("text"), "modified")


def listed(spark: SparkSession, folder: str) -> list[tuple[str, int, datetime]]:
    """Name, size and time of the files of a folder (not of its subfolders), through Hadoop's file system; a folder that does not exist has none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.listStatus(path) if system.exists(path) else []
    return [(f.getPath().getName(), f.getLen(), datetime.fromtimestamp(f.getModificationTime() / 1000)) for f in found if f.isFile()]


def _kind(name: str) -> str:
    """``text.file_type`` of a name on the driver."""
    low = name.lower()
    return next((kind for ends, kind in ((".txt", "txt"), (".htm", "html"), (".html", "html"), (".pdf", "pdf"), (".docx", "docx")) if low.endswith(ends)), "unknown")


def stale(spark: SparkSession, folder: str, built) -> bool:
    """Whether an index of a folder must be built anew: never ``built`` (a time), no folder, no files that are not hidden, or a file newer than it."""
    found = [(name, at) for name, _, at in listed(spark, folder) if not name.startswith(".")]
    return built is None or not found or max(at for _, at in found) > built


def read_stopwords(spark: SparkSession, path: str | None, most: int | None = None) -> Sequence[str]:
    """Stop words of a file, one on a line: leading blanks go, blank lines and those that begin with # are skipped; None gives the default words, a file that does not exist the built-in ones. ``most``: the first so many different ones."""
    if path is None:
        return T.stopwords()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return BUILT_IN
    lines = spark.read.text(path).where("value != '' AND NOT startswith(value, '#')").select(F.regexp_replace("value", r"^[ \t]+|\r+$", "").alias("word")).where("word != ''")
    return sorted(r.word for r in lines.distinct().collect())[:most]
