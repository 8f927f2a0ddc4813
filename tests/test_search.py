import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from quern import registry
from quern.operators import batch, cache, index, present, search, session

DOCS = [
    "the search engine finds text in a search index", "a data structure for the index, and text search", "Search the engine! engine search engine", "text text text", "", "the of and", "unrelated words here", "engine text search engine index",
]


@pytest.fixture(scope="module")
def own(spark):
    return index.build(spark.createDataFrame([(i, t, f"f{i}.txt") for i, t in enumerate(DOCS)], "doc_id long, text string, file_name string"))


def plain(query, k=10):
    """Score by score."""
    from test_text import plain_tokens

    docs = {i: plain_tokens(t) for i, t in enumerate(DOCS)}
    n = max(i for i, t in docs.items() if t) + 1
    words = query.split()
    out = []
    for i, t in docs.items():
        score = sum(Counter(t)[w] * (math.log((n + 1) / (sum(w in x for x in docs.values()) + 1)) + 1) for w in words)
        if len(words) > 1 and any(t[p : p + len(words)] == words for p in range(len(t))):
            score += 5
        if score > 0:
            out.append((-round(score, 6), i))
    return [(r, i, round(-s, 4)) for r, (s, i) in enumerate(sorted(out)[:k], 1)]


@pytest.mark.parametrize("query", ["search", "search engine", "search the engine", "engine search engine", "text text", "index", "nothing", "data structure index", "engine text search"])
def test_scores(own, query):
    assert [tuple(r) for r in search.search(own, query).collect()] == plain(query)


def test_batch_equals_single(spark, own):
    queries = ["search engine", "text text", "search the engine", "none of these", "!"]
    got = search.batch_search(own.postings, spark.createDataFrame(list(enumerate(queries)), "qid int, query string"), own.size, k=3).collect()
    for i, q in enumerate(queries):
        assert sorted((r.rank, r.doc_id, r.score) for r in got if r.qid == i) == plain(q, 3)


def test_saved_index(spark, own, tmp_path):
    own.save(str(tmp_path / "index"))
    again = index.load(spark, str(tmp_path / "index"))
    assert again.size == own.size
    assert [tuple(r) for r in search.search(again, "search engine").collect()] == plain("search engine")
    plan = again.postings.where("term IN ('search')")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "search" in plan


def test_binary_layout(spark, own, tmp_path):
    data = index.encode_binary(own)
    want = sorted((r.term, r.doc_id, r.pos) for r in own.postings.collect())
    assert sorted(index.decode_binary(data)) == want
    order = list(dict.fromkeys(t for t, *_ in index.decode_binary(data)))
    first = list(dict.fromkeys(r.term for r in own.postings.orderBy("doc_id", "pos").collect()))
    assert order == first
    (tmp_path / "index.dat").write_bytes(data)
    assert sorted((r.term, r.doc_id, r.pos) for r in index.read_binary(spark, str(tmp_path / "index.dat")).collect()) == want
    with pytest.raises(ValueError):
        list(index.decode_binary(b"\0" * 12))


@pytest.mark.parametrize("files", [None, 1, 7])
def test_binary_files(spark, own, tmp_path, files):
    """Files together hold all postings; one file is the layout's single piece; an index without a term has no file."""
    path = f"file://{tmp_path}/binary"
    written = index.save_binary(own, path, files).collect()
    assert sorted(r.file for r in written) == sorted(x.name for x in (tmp_path / "binary").glob("*.dat"))
    want = sorted((r.term, r.doc_id, r.pos) for r in own.postings.collect())
    assert sorted((r.term, r.doc_id, r.pos) for r in index.read_binary(spark, path).collect()) == want
    if files == 1:
        assert [x.read_bytes() for x in (tmp_path / "binary").glob("*.dat")] == [index.encode_binary(own)]
    none = index.build(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))
    assert index.save_binary(none, path, files).count() == 0
    assert index.encode_binary(none) == index.struct.pack("<III", index.MAGIC, index.BINARY_VERSION, 0)


def test_a_term_over_several_files_and_batches(spark, tmp_path, monkeypatch):
    own = index.build(spark.range(300).selectExpr("id AS doc_id", "repeat('granite ', 40) || id AS text"))
    assert index.save_binary(own, f"file://{tmp_path}/binary", 5).count() == 5
    got = index.read_binary(spark, f"file://{tmp_path}/binary")
    assert got.where("term = 'granite'").count() == 12000 and got.exceptAll(own.postings.select("term", "doc_id", "pos")).isEmpty()
    monkeypatch.setattr(index, "BATCH_ROWS", 100)
    batches = [pa.RecordBatch.from_pydict({"term": ["a", "b"], "doc_id": [1, 1], "pos": [0, 1]}), pa.RecordBatch.from_pydict({"term": ["b", "c"], "doc_id": [2, 2], "pos": [0, 1]})]
    body = b"".join(index._entries(batches))
    assert list(index.decode_binary(index.struct.pack("<III", index.MAGIC, 1, 3) + body)) == [("a", 1, 0), ("b", 1, 1), ("b", 2, 0), ("c", 2, 1)]


def test_suggestions(own):
    terms = [r.term for r in search.suggest(own.terms, "s").orderBy("n").collect()]
    assert terms == ["search", "structure"]
    assert search.suggest(own.terms, "S").count() == search.suggest(own.terms, "").count() == 0
    assert search.suggest(own.terms, "e", 1).count() == 1


def test_results(own):
    rows = present.result_rows(search.search(own, "data structure"), own.docs)
    assert [(r.rank, r.file_name) for r in rows.collect()] == [(1, "f1.txt")]
    assert '"score":"' in present.result_json(rows).first().json
    assert "<mark>data</mark> <mark>structure</mark>" in present.highlighted(rows, "data structure").first().html


def test_result_cache():
    c = cache.ResultCache(2)
    assert c.get("a") is None
    c.put("a\n", [1, 2, 3])
    c.put("b", [])
    assert c.get("a", 2) == [1, 2] and c.get("b") == [] and c.get("B") is None
    c.put("c", [4])
    assert c.get("a") is None and c.count == 2 and (c.hits, c.misses) == (2, 3)
    c.free()
    assert c.count == 0 and c.hits == 2 and cache.ResultCache(0).capacity == 100


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_log_hits(spark, capacity):
    rnd = random.Random(capacity)
    log = [(i * 2, int(rnd.expovariate(0.2))) for i in range(800)]
    got = cache.lru_hits(spark.createDataFrame(log, "t long, user long").repartition(5), capacity, "t", "user").collect()
    c, want = cache.ResultCache(capacity), {}
    for t, user in log:
        want[t] = c.get(str(user)) is not None
        c.put(str(user), [])
    assert {r.n: r.hit for r in got} == want


def test_log_hits_over_ranges(spark, monkeypatch):
    """A log of many ranges, and one without a row."""
    monkeypatch.setattr(cache, "RANGE_ROWS", 90)
    rnd, c = random.Random(5), cache.ResultCache(4)
    log = [(i, int(rnd.expovariate(0.2))) for i in range(800)]
    want = {}
    for t, user in log:
        want[t] = c.get(str(user)) is not None
        c.put(str(user), [])
    df = spark.createDataFrame(log, "t long, user long")
    assert {r.n: r.hit for r in cache.lru_hits(df, 4, "t", "user").collect()} == want
    assert cache.lru_hits(df.where("t < 0"), 4, "t", "user").count() == 0


def test_every_query_has_a_name_and_sql():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert set(registry.QUERIES) - set(registry.ORACLE_SQL) == {"bench"}


# Texts whose term frequencies for the keywords below give the golden scores: 13 documents, keyword counts by document.
GOLDEN = {
    "one": "text text search engine engine index search",
    "two": "search engine text x search index x data structure x keyword x index",
    "three": "text search x engine search x index x search engine x keyword index x",
    "four": "text x index data x structure",
}


def test_golden_scores(spark):
    """Scores of a corpus of 13 documents, worked out by hand from tf * (ln(14 / (df + 1)) + 1) and five points for a phrase."""
    texts = list(GOLDEN.values()) + [f"filler{i}" for i in range(8)] + ["pride"]
    own = index.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    w = lambda df: math.log(14 / (df + 1)) + 1
    assert own.size == 13
    assert [(r.doc_id, r.score) for r in search.search(own, "pride").collect()] == [(12, 2.9459)]
    assert {r.doc_id: r.score for r in search.search(own, "text").collect()} == {0: round(2 * w(4), 4), 1: 2.0296 + 0, 2: 2.0296, 3: 2.0296}
    phrase = {r.doc_id: r.score for r in search.search(own, "data structure").collect()}
    assert phrase == {1: round(2 * w(2) + 5, 4), 3: round(2 * w(2), 4)} == {1: 10.0809, 3: 5.0809}
    assert round(w(4), 4) == 2.0296 and round(w(5), 4) == 1.8473 and round(w(3), 4) == 2.2528 and round(w(2), 4) == 2.5404 and round(w(1), 4) == 2.9459
    # a stop word in the query counts as a keyword that nothing holds: no phrase
    assert max(r.score for r in search.search(own, "search the engine").collect()) < max(r.score for r in search.search(own, "search engine").collect())


def test_session_answers_from_cache(spark, caplog):
    docs = spark.createDataFrame([(0, "a.txt", "alpha beta"), (1, "b.txt", "alpha alpha")], "doc_id long, file_name string, text string")
    now = iter(range(100))
    own = session.Session(index.build(docs), clock=lambda: next(now) / 1000)
    with caplog.at_level("INFO", "quern.search"):
        first = own.answer("alpha")
    assert [(d["rank"], d["fileName"], d["abstract"]) for d in first["docList"]] == [(1, "b.txt", "alpha alpha..."), (2, "a.txt", "alpha beta...")]
    assert first["queryTimeMs"] == 1.0 and [t["stage"] for t in first["timestamps"]] == ["cache lookup", "scoring", "scored", "shown"]
    assert re.match(r"\[\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3}\] cache lookup: 1\.000 ms", caplog.messages[0])
    again = own.answer("alpha\n", bench="b")
    assert again["docList"] == first["docList"] and again["queryTimeMs"] == 0 and again["benchText"] == "b"
    assert (own.cache.hits, own.cache.misses) == (1, 1)
    assert len(own.answer("alpha", k=1)["docList"]) == 1 and own.answer("nothing")["docList"] == []
    assert session.log_time(session.datetime(2024, 1, 2, 3, 4, 5, 678_900)) == "2024-01-02 03:04:05.678"


def test_batch_search_with_many_keywords(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} common") for i in range(40)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "w1 common"), (1, "w1 w1"), (2, "none")], "qid int, query string")
    own = index.build(docs)
    few = sorted(map(tuple, search.batch_search(own.postings, asked, own.size).collect()))
    assert {r[0] for r in few} == {0, 1}
    monkeypatch.setattr(search, "FEW_TERMS", 1)
    assert sorted(map(tuple, search.batch_search(own.postings, asked, own.size).collect())) == few


@pytest.fixture
def small_partitions(spark):
    """Partitions that are merged by bytes, as those of a larger table are."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def large(spark, tmp_path):
    """A saved index of 3,000 documents of a common and of many rare words."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat_ws(' ', 'granite', sha1(string(id)), id, 7 * id) AS text")
    index.build(docs).save(f"file://{tmp_path}/index")
    return index.load(spark, f"file://{tmp_path}/index")


def test_term_order_over_many_partitions(spark, small_partitions, tmp_path):
    own = large(spark, tmp_path)
    first = dict.fromkeys(r.term for r in own.postings.orderBy("doc_id", "pos").collect())
    got = index.term_order(own.terms).collect()
    assert sorted((r.term_ord, r.term) for r in got) == list(enumerate(first))


def test_binary_files_of_many_partitions(spark, small_partitions, tmp_path):
    own, path = large(spark, tmp_path), f"file://{tmp_path}/binary"
    index.save_binary(own, path)
    got, want = index.read_binary(spark, path), own.postings.select("term", "doc_id", "pos")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_binary_files_of_mixed_places(monkeypatch):
    """Documents out of order in several blocks, positions beyond 16 bits, a file's end within a term: each file by first place, the whole complete."""
    rnd = random.Random(5)
    rows = [(f"w{rnd.randrange(5)}", rnd.choice([3, 20_000, 50_000, 2**32 - 1]), rnd.choice([rnd.randrange(90), rnd.randrange(2**20)])) for _ in range(3000)] + [("é", 0, 2**31 - 1)]
    batches = [pa.RecordBatch.from_pydict({"term": pa.array(t), "doc_id": pa.array(d, pa.int64()), "pos": pa.array(p, pa.int32())}) for t, d, p in (zip(*rows[i : i + 700]) for i in range(0, len(rows), 700))]
    monkeypatch.setattr(index, "PIECE_ROWS", 1000)
    for most in (1 << 24, 500):
        monkeypatch.setattr(index, "FILE_BYTES", most)
        pieces = pa.Table.from_batches(list(index._pieces(batches))).sort_by([("term", "ascending"), ("block", "ascending")])
        files = [list(index.decode_binary(index.struct.pack("<III", index.MAGIC, 1, len(x)) + b"".join(x))) for x in index._files(pieces.to_batches(max_chunksize=7))]
        assert sorted(sum(files, [])) == sorted(rows) and (len(files) > 5) == (most == 500)
        for rows_ in files:
            first = {t: min(r[1:] for r in rows_ if r[0] == t) for t in {r[0] for r in rows_}}
            assert rows_ == sorted(rows_, key=lambda r: (first[r[0]], r))
    for doc in (None, -1, 1 << 32):
        with pytest.raises(ValueError):
            list(index._pieces([pa.RecordBatch.from_pydict({"term": pa.array(["a", "a"]), "doc_id": pa.array([1, doc], pa.int64()), "pos": pa.array([0, 1], pa.int32())})]))


def shuffled(df):
    """The most rows that one exchange of the plan has written, after the plan has run."""
    rows, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if (found := node.metrics().get("shuffleRecordsWritten")).isDefined():
                rows.append(found.get().value())
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return max(rows)


def stages(spark):
    """Number and rows sent of the session's stages."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return [{"id": found.apply(i).stageId(), "sent": found.apply(i).shuffleWriteRecords()} for i in range(found.size())]


def test_binary_files_send_no_postings(spark, tmp_path):
    """400 documents of 100 words, 10 of them different: 40,000 postings."""
    own = index.build(spark.range(400).selectExpr("id AS doc_id", "repeat('wa wb wc wd we wf wg wh wi wj ', 10) AS text"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {x["id"] for x in stages(spark)}
    index.save_binary(own, f"file://{tmp_path}/binary")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(x["sent"] for x in stages(spark) if x["id"] not in before) < 4000
    assert index.read_binary(spark, f"file://{tmp_path}/binary").exceptAll(own.postings.select("term", "doc_id", "pos")).isEmpty()


def test_batch_search_writes_no_table_of_pairs(spark):
    """400 documents and 300 queries of a word that all hold: 120,000 pairs."""
    own = index.build(spark.range(400).selectExpr("id AS doc_id", "concat('common w', id % 7) AS text"))
    got = search.batch_search(own.postings, spark.range(300).selectExpr("id AS qid", "concat('common w', id % 9) AS query"), own.size)
    assert len(got.collect()) == 3000
    assert shuffled(got) <= 300 * 10


def test_batch_search_over_blocks(spark, monkeypatch):
    """Against scores pair by pair: null ids, queries in several rows, repeated and unknown words, phrases, ties, several blocks and files."""
    monkeypatch.setattr(batch, "BLOCK_PAIRS", 60)
    monkeypatch.setattr(batch, "FILE_WORDS", 20)
    rnd = random.Random(3)
    word = lambda: f"w{int(rnd.expovariate(0.5))}"
    docs = [(i * 3, " ".join(word() for _ in range(rnd.randrange(12)))) for i in range(120)] + [(None, "w1 w2 w0 w0")]
    asked = [(j, " ".join(word() for _ in range(rnd.randrange(1, 5)))) for j in range(60)] + [(3, "w1"), (None, "w1 w2"), (99, "w0 nothing"), (98, "nothing"), (97, "")]
    own = index.build(spark.createDataFrame(docs, "doc_id long, text string"))
    got = search.batch_search(own.postings, spark.createDataFrame(asked, "qid long, query string"), own.size, k=7).collect()
    held = {i: t.split() for i, t in docs}
    df, want = Counter(w for t in held.values() for w in set(t)), []
    for qid in dict.fromkeys(q for q, _ in asked):
        texts = [t.split() for q, t in asked if q == qid]
        words, places = sum(texts, []), []
        for i, t in held.items():
            if hits := [w for w in words if w in t]:
                score = sum(t.count(w) * (math.log((own.size + 1) / (df[w] + 1)) + 1) for w in hits)
                if len(texts) == 1 and len(words) > 1 and None not in (qid, i) and any(t[p : p + len(words)] == words for p in range(len(t))):
                    score += 5
                places.append((-round(score, 6), i is None, i, score))
        want += [(qid, rank, i, round(score, 4)) for rank, (_, _, i, score) in enumerate(sorted(places)[:7], 1)]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
