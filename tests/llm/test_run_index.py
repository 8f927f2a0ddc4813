import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quern.llm import run_index as r


def brute(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(df, **args):
    rows, nodes = r.removed(df, **args)
    out = rows.join(nodes, nodes.columns[0]).select("doc_id", "n_bytes", "spans", "kept").collect()
    return [(x.doc_id, (x.n_bytes, sum(s.end - s.start for s in x.spans), len(x.spans), hashlib.sha256(bytes(x.kept)).hexdigest())) for x in out]


@pytest.mark.parametrize("text", [b"banana", b"a", b"aaaaaaaa", b"abababab", b"mississippi\x00mississippi\x00", bytes(random.Random(1).choices(b"ab", k=3000)), bytes(range(250)) * 9])
def test_statistics(text):
    t = np.frombuffer(text, np.uint8).astype(np.int16)
    sa = r.suffix_array(r.packed(t))
    assert sa.tolist() == sorted(range(len(t)), key=lambda i: text[i:])
    if len(text) > 400:
        text, t = text[:400], t[:400]
    lcp = lambda i, j: next((k for k in range(len(text)) if i + k >= len(text) or j + k >= len(text) or text[i + k] != text[j + k]), 0)
    want = [max((lcp(i, j) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
    assert r.statistics(t).tolist() == want


def test_hashes_and_minima():
    rnd = np.random.default_rng(2)
    data = rnd.integers(0, 3, 500, dtype=np.uint8)
    for size in (1, 7, 32, 200):
        h = r.hashes(data, size)
        assert len(h) == 500 - size + 1
        by = {}
        for i in range(len(h)):
            assert by.setdefault(data[i : i + size].tobytes(), h[i]) == h[i]
        assert len(set(by.values())) == len(by)
    assert r.least(h, 169).tolist() == [h[i : i + 169].min() for i in range(len(h) - 168)]


def test_one_rule_for_keys(monkeypatch):
    """Parts of a long text give the same least hashes as the whole."""
    h = np.random.default_rng(4).integers(0, 1 << 63, 5000, dtype=np.uint64)
    h[::3] = h[0]  # with ties
    whole = r.ends_of_least(h, 169)
    monkeypatch.setattr(r, "PLACES", 1 << 9)
    parts = r.ends_of_least(h & ~np.uint64((1 << 24) - 1), 169)
    assert all((a == b).all() for a, b in zip(whole, parts))
    assert len(whole[0]) == len(h) - 168 and (whole[0] <= whole[1]).all()
    assert [x.tolist() for x in r.ends_of_least(h[:100], 169)] == [[], []]


def cases():
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choice("abcdefghij é") for _ in range(n))
    passage, line, edge = word(700), word(120), word(198)
    texts = [None, "", "short", "a" * 199, "a" * 200, "a" * 450, "ab" * 400, "b" * 201, "é" * 300, word(5000)]
    texts += [word(300) + passage + word(200), passage[50:400] + word(100), word(3) + passage[:199], passage[300:500], word(100) + passage[299:501]]
    texts += [word(250) + line + word(250) for _ in range(40)] + [edge + word(50) for _ in range(30)]
    x = word(600)
    texts += [x, x, x[:300] + "!" + x[300:], x * 3]
    return texts


@pytest.mark.parametrize("hot", [r.HOT, 5])
def test_equals_brute_force(spark, hot):
    texts = cases()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS node", "3 AS copies", "4 AS id")
    assert sorted(got(df, hot=hot)) == list(enumerate(brute(texts)))


def test_block_marks():
    texts = [t.encode() for t in cases() if t]
    for i, (marks, text) in enumerate(zip(r.block_marks(texts, [1] * len(texts)), texts)):
        assert len(marks) == max(0, len(text) - 199)
        for j in range(0, len(marks), 17):
            there = sum(t.find(text[j : j + 200]) >= 0 for t in texts) > 1 or text.find(text[j : j + 200], text.find(text[j : j + 200]) + 1) >= 0
            assert bool(marks[j]) == there, (i, j)
    # a piece that counts twice matches itself
    assert all(m.all() for m in r.block_marks(texts, [2] * len(texts)))


def test_real_documents(spark, real_docs):
    rows = real_docs.collect()
    want = sorted(zip([x.doc_id for x in rows], brute([x.text for x in rows])))
    assert any(w[1][1] for w in want)
    assert sorted(got(real_docs)) == want


def test_odd_rows(odd_docs):
    rows = odd_docs.collect()
    assert sorted(got(odd_docs), key=str) == sorted(zip([x.doc_id for x in rows], brute([x.text for x in rows])), key=str)
    assert got(odd_docs.limit(0)) == []


def test_clashing_columns_come_back(spark):
    names = ["__node", "node", "NODE_", "n_bytes_", "id", "copies", "part"]
    rows = [(i, t, *(f"{n}{i}" for n in names)) for i, t in enumerate(["x" * 300, None, "x" * 300, "y"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out, nodes = r.removed(df)
    assert out.columns[:-1] == df.columns and nodes.columns == [out.columns[-1], "n_bytes", "spans", "kept"]
    assert sorted(map(tuple, out.select(*df.columns).collect())) == rows
    assert sorted(got(df))[1:] == [(1, brute([None])[0]), (2, (300, 300, 1, hashlib.sha256().hexdigest())), (3, brute(["y"])[0])]
