import base64
import hashlib
from collections import defaultdict

import pytest

from quern.llm import warc


def want(rows, least):
    groups = defaultdict(list)
    for i, h in rows:
        groups[(h or "").encode()].append(i)
    out = []
    for i, h in rows:
        data = (h or "").encode()
        ids = [x for x in groups[data] if x is not None]
        revisit = len(data) >= least and ids and i != max(ids)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def got(spark, df, **args):
    path, names = warc.write(df, **args)
    rows = warc.read(spark, path, names).collect()
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str), rows


@pytest.mark.parametrize("least", [0, 3])
def test_odd_rows(spark, least):
    rows = [(1, "aa"), (2, "aa"), (3, "long " * 9000), (4, "long " * 9000), (5, None), (6, ""), (7, "é\r\n\r\nWARC/1.1\r\n"), (7, "é\r\n\r\nWARC/1.1\r\n"), (None, "n"), (None, "aa"), (8, "0\r\n\r\n")]
    df = spark.createDataFrame([(i, None if i == 1 else f"http://x/{i}\r\nX: y", h) for i, h in rows], "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS origin", "3 AS sha")
    found, full = got(spark, df, least=least, segment=1000)
    assert found == want(rows, least)
    by = {i: (h or "").encode() for i, h in rows}
    assert all(bytes(r.payload) == by[r.page_id] for r in full if r.record_type == "response" and r.page_id is not None)


def test_real_pages(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    found, _ = got(spark, df, segment=2000)
    assert found == want([(r.page_id, r.html) for r in df.collect()], 0)
    assert got(spark, df.limit(0))[0] == []


def test_missing_segment_raises(spark):
    df = spark.createDataFrame([(1, "u", "x" * 5000)], "page_id long, url string, html string")
    path, names = warc.write(df, segment=1000)
    segments = warc.read_segments(spark, path, names)
    assert segments.count() == 6
    with pytest.raises(Exception, match="whole record"):
        warc.reassembled(segments.where("number != 3")).collect()
    assert warc.reassembled(segments.where("number = 1 OR number > 1")).count() == 1


def test_chunked_framing():
    data = bytes(range(256)) * 100
    assert warc.unframed(warc.framed(data, 999)) == data
    assert warc.unframed(b"3;x=y\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unframed(b"5\r\nabc\r\n0\r\n\r\n")
