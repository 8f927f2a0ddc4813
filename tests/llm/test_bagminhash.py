import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import bagminhash as b


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4) if w else 0))


def brute(rows):
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = sum((bags[i] & bags[j]).values())
            if both and both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return sorted(((d, least(groups[find(i)]), len(groups[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted(((r.doc_id, r.class_id, r.n_class) for r in b.classes(df).collect()), key=str)


def test_signature_is_unbiased():
    rnd = np.random.default_rng(3)
    diffs = []
    for i in range(60):
        n = int(rnd.integers(3, 200))
        x = {int(e): int(c) for e, c in zip(rnd.integers(1, 2**62, n), rnd.integers(1, 40 if i % 2 else 2, n))}
        y = {e: (c if rnd.random() < 0.7 else int(rnd.integers(1, 40))) for e, c in x.items() if rnd.random() < 0.9} or {1: 1}
        sets = [(np.array(list(s), np.uint64), np.array(list(s.values()))) for s in (x, y)]
        both = sum(min(c, y.get(e, 0)) for e, c in x.items())
        true = both / (sum(x.values()) + sum(y.values()) - both)
        s = b.signatures(sets, 1024)
        diffs.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(diffs)) < 0.006 and np.std(diffs) < 0.02


def test_overlap_counts_copies():
    x, y = (b.shingles(words("a b c d e " * n)) for n in (10, 5))
    assert b.overlap(x, y) == pytest.approx(21 / 46)


def test_classes_of_real_documents(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    want = brute(rows)
    assert any(n > 1 for *_, n in want)
    assert got(real_docs) == want


def test_odd_rows(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    full = {d: (c, n) for d, c, n in brute(rows)}
    by, found = dict(rows), got(odd_docs)
    assert len(found) == len(rows)
    for d, c, n in found:
        if d is not None:
            assert (c, n) == (full[d] if words(by[d]) else (d, 1))


def test_blocks_find_links_that_join():
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(rnd.randrange(0, 6)):
            t[rnd.randrange(len(t))] = f"x{rnd.random()}"
        texts.append(" ".join(t * rnd.choice([1, 1, 2])))
    roots = [i // 2 for i in range(60)]
    for block in ([0] * 60, [i % 2 for i in range(60)]):
        got_ = b.linked(pa.table({"id": list(range(60)), "root": roots, "block": block, "text": texts}), 0.8)
        one, two = list(range(30)), list(range(30))

        def merge(group, i, j):
            x, y = group[roots[i]], group[roots[j]]
            return [y if g == x else g for g in group]

        for i, j in got_:
            one = merge(one, i, j)
        bags = [bag(t) for t in texts]
        for i in range(60):
            for j in range(i):
                both = sum((bags[i] & bags[j]).values())
                if both >= 0.8 * (sum(bags[i].values()) + sum(bags[j].values()) - both) and (block[i] != block[j] or len(set(block)) == 1):
                    two = merge(two, i, j)
        sets = lambda g: {frozenset(i for i, x in enumerate(g) if x == y) for y in g}
        assert sets(one) == sets(two)
        assert len(got_) == 30 - len(set(one))


def test_chains_and_buckets(spark, monkeypatch):
    """A chain in which only neighbours are alike is one class, whatever the buckets' first members are."""
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    text = [rnd.choice(vocab) for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i * 7 % 40, " ".join(text)))
        at = rnd.randrange(0, 280)
        text = [*text[:at], *(rnd.choice(vocab) for _ in range(20)), *text[at + 20 :]]
    rows += [(100 + i, rows[3][1].upper()) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS node", "1 AS key", "2 AS root")
    assert got(df) == brute(rows)
    monkeypatch.setattr(b, "SMALL", 2)
    monkeypatch.setattr(b, "BLOCK", 3)
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_deduplicated_keeps_clashing_columns_and_repeated_ids(spark, monkeypatch):
    """Columns named like any that the operator makes come back as they were; an id may name several texts."""
    names = ["__node", "__doc", "__none", "__copy", "node", "doc", "none", "copy", "DOC", "node_", "id", "many", "root", "text_"]
    names = [n for i, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:i]]]
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, "a b c d e f g"), (1, "other words are here in this one"), (2, "A b c d e f g"), (None, "null id has these words here"), (None, "null id has these words here!"), (None, None), (3, ""), (3, None), (4, "other words are here in this one"), (5, "Null id has these words here"), (6, long), (7, long + " end"), (0, "zero id is another text than null"), (None, "a null id that has its own text")]
    df = spark.createDataFrame([(*r, *(f"{n}{i}" for n in names)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _ in range(2):
        out = b.deduplicated(df)
        assert out.columns == df.columns
        found = {tuple(r) for r in out.collect()}
        assert found <= {tuple(r) for r in df.collect()}
        assert sorted(((r[0], r[1]) for r in found), key=str) == sorted([(1, rows[0][1]), (1, rows[1][1]), (None, None), (3, ""), (3, None), (5, rows[9][1]), (6, long), (0, rows[12][1]), (None, rows[13][1])], key=str)
        assert len(b.classes(df).collect()) == len(rows)
        monkeypatch.setattr(b, "FAN", 1)
    assert b.deduplicated(df.limit(0)).collect() == []
