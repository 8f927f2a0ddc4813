import re

import pytest

from quern.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = WORD.findall(lower(t or ""))
        for a in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(i)
    sizes = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[a : a + n]))) is not None:
                    hit |= set(range(a, a + n))
                    found |= ids
        out.append((d if d is not None else -1, len(w), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out)


def shaped(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, sum(s["words"] for s in r.spans), tuple(r["items"])) for r in df.collect())


def test_real_tables(spark, real_docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in real_docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert shaped(decontaminate.scan(real_docs, items)) == want
    assert any(x[2] for x in want)
    with pytest.raises(ValueError, match="bounded to 100"):
        decontaminate.scan(real_docs, items, most=100)


def test_odd_rows_and_offsets(spark, odd_docs):
    items = [(1, "AB, ab ab"), (2, "a"), (3, None), (4, "!?"), (None, "null id"), (2, "émile"), (5, " ".join(["ab"] * 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.scan(odd_docs, bench)
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert shaped(got) == brute(docs, items, 10)
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in odd_docs.collect() if not brute([(0, r.text)], items, 10)[0][2])
    texts = dict(docs)
    for r in got.collect():
        for s in r.spans:
            if r.doc_id is not None:
                assert len(WORD.findall(lower(texts[r.doc_id][s["start"] : s["end"]]))) == s["words"]


def test_empty_tables(spark, odd_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.spans for r in decontaminate.scan(odd_docs, none).collect())
    assert decontaminate.scan(odd_docs.limit(0), none).count() == 0
    assert decontaminate.clean(odd_docs, none).count() == odd_docs.count()


def test_long_texts_ties_and_clashing_columns(spark):
    passage = " ".join(f"k{i}" for i in range(12))
    rows = [(1, "w " * 300_000 + passage, 7, "x"), (1, passage.upper(), 8, "y"), (2, "k1 k2", 9, None), (2, None, 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item long, `hit.s` string").selectExpr("*", "1 AS spans", "2 AS items", "3 AS n_words")
    bench = spark.createDataFrame([(5, passage), (6, passage), (6, f"other {passage}")], "item_id long, text string")
    assert sorted((r.doc_id, r.items, [s["words"] for s in r.spans]) for r in decontaminate.scan(docs, bench).collect()) == [(1, ["5", "6"], [12]), (1, ["5", "6"], [12]), (2, [], []), (2, [], [])]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == ["", "k1 k2"]
