"""The search engine's queries and their DuckDB forms, by name."""

from __future__ import annotations

import io
import time
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import oracle as O
from quern.functions import text as T
from quern.operators import cache, index, present, search, session
from quern.plans.shared import dropped, filesystem, new_path, stored
from quern.sources import files
from quern.streaming import indexing

QUERY, PHRASE, REPEATED, STOPPED = "eriner thanea ing", "attion thanedble anea", "ing thth ing", "attion the thanedble"
# The queries that are timed.
BENCH = ["text", "search index", "keyword document", "engine", "data structure", "pride", "love story"]
CAPACITY = 25
CJK = ["搜索引擎", "测试HTML文档", "没有", "café É", "ひらがな", "ＡＢＣ", "\U00020000\U00020001", "The Quick_Fox's", "don’t x—y", "q" * 200, "é" * 100, ""]
ENTITIES = ["&amp;lt; &copy; &lt;b&gt;", "&#65;&#x41;&#x0e9;&#233;", "a &quot;b&quot; &apos; &nbsp;&nbsp;", "&#0; &#256; &#38;lt; &", "", "&#x;&#;&amp"]
HTML = ["a<br>b", "a<br/>b", "a<b>b</b>", "x</pre>y", "x<pre>y", "2 < 3 > 1", "<!-- a > b -->", "&amp;lt; &copy;", "<SCRIPT >x</script>y", "v<script>unterminated", "a\r\n\tb <p>\nc", "<a <p>x"]
NAMES = ["a.txt", "B.HTM", "c.html", "d.PDF", "e.docx", "f.doc", "txt", ".txt", "g.tar.gz", ""]


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, conversations, events = map(_table, ("documents", "pages", "conversations", "events"))


def _values(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "n int, x string")


def _sql_values(values: list[str]) -> str:
    rows = ", ".join(f"({i}, {O._lit(v)})" for i, v in enumerate(values))
    return f"(SELECT CAST(n AS INTEGER) AS n, x FROM (VALUES {rows}) v(n, x))"


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


@query(f"SELECT doc_id, {O.lower('text')} AS text FROM documents")
def ascii_lower(spark, d):
    return documents(spark, d).select("doc_id", T.ascii_lower(F.col("text")).alias("text"))


@query(f"SELECT doc_id, regexp_replace({O.lower('text')}, '[^a-z0-9]', ' ', 'g') AS text FROM documents")
def clean_ascii(spark, d):
    return documents(spark, d).select("doc_id", T.clean_ascii(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, regexp_replace(text, '^[\\t-\\r ]+|[\\t-\\r ]+$', '', 'g') AS text FROM conversations")
def trim_ascii(spark, d):
    return conversations(spark, d).select("conv_id", "turn", T.trimmed(F.col("text")).alias("text"))


@query(O.TOKENS)
def doc_tokens(spark, d):
    return index.tokens(documents(spark, d))


# The rows that the contract expects, written out by hand.
CJK_TOKENS = ["搜 索 引 擎 搜索 索引 引擎", "测 试 测试 html 文 档 文档", "没", "café É", "ひらがな", "", "\U00020000 \U00020001", "quick fox s", "don t x y", "q" * 127, "é" * 63, ""]
HTML_TEXTS = ["a\nb", "ab", "ab", "x\ny", "xy", "2  1", " b --", "&lt; &copy;", "y", "v"]


def _expected(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(O._lit(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


@query(f"SELECT CAST(n AS INTEGER) AS n, CAST(pos AS INTEGER) AS pos, term FROM (VALUES {_expected([(n, pos, term) for n, line in enumerate(CJK_TOKENS) for pos, term in enumerate(line.split())])}) v(n, pos, term)")
def cjk_tokens(spark, d):
    return index.tokens(_values(spark, CJK), id_col="n", text_col="x").withColumnRenamed("doc_id", "n")


def _query_tokens(strict: bool):
    def f(spark, d):
        users = conversations(spark, d).where("role = 'user'")
        return users.select("conv_id", "turn", F.posexplode(T.query_terms(F.col("text"), strict)).alias("pos", "term"))

    return f


USERS = "(SELECT * FROM conversations WHERE role = 'user')"
QUERIES["query_tokens"], ORACLE_SQL["query_tokens"] = _query_tokens(False), O.exploded("conv_id, turn", O.query_terms("text"), USERS)
QUERIES["query_tokens_strict"], ORACLE_SQL["query_tokens_strict"] = _query_tokens(True), O.exploded("conv_id, turn", O.query_terms("text", True), USERS)


@query(f"SELECT page_id, {O.html_text('html')} AS text FROM pages")
def html_text(spark, d):
    return pages(spark, d).select("page_id", T.html_text(F.col("html")).alias("text"))


@query(f"SELECT CAST(n AS INTEGER) AS n, text FROM (VALUES {_expected(list(enumerate(HTML_TEXTS)))}) v(n, text) UNION ALL SELECT n, {O.html_text('x')} AS text FROM {_sql_values(HTML)} WHERE n >= {len(HTML_TEXTS)}")
def html_cases(spark, d):
    return _values(spark, HTML).select("n", T.html_text(F.col("x")).alias("text"))


@query(O.exploded("page_id", O.doc_tokens("text"), f"(SELECT page_id, {O.html_text('html')} AS text FROM pages)"))
def page_tokens(spark, d):
    return index.tokens(html_text(spark, d), id_col="page_id").withColumnRenamed("doc_id", "page_id")


@query(f"SELECT n, {O.decode_entities('x')} AS text FROM {_sql_values(ENTITIES)}")
def entity_decode(spark, d):
    return _values(spark, ENTITIES).select("n", T.decode_entities(F.col("x")).alias("text"))


FILE_TYPE = f"CASE WHEN ends_with({O.lower('x')}, '.txt') THEN 'txt' WHEN ends_with({O.lower('x')}, '.htm') OR ends_with({O.lower('x')}, '.html') THEN 'html' WHEN ends_with({O.lower('x')}, '.pdf') THEN 'pdf' WHEN ends_with({O.lower('x')}, '.docx') THEN 'docx' ELSE 'unknown' END"


@query(f"SELECT x AS name, {FILE_TYPE} AS kind FROM (SELECT url AS x FROM pages UNION ALL SELECT x FROM {_sql_values(NAMES)})")
def file_type(spark, d):
    names = pages(spark, d).select(F.col("url").alias("x")).unionByName(_values(spark, NAMES).select("x"))
    return names.select(F.col("x").alias("name"), T.file_type(F.col("x")).alias("kind"))


@query(f"SELECT doc_id, CAST(len({O.doc_tokens('text')}) AS INTEGER) AS n_tokens FROM documents")
def doc_token_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(T.doc_tokens(F.col("text"))).alias("n_tokens"))


POSTINGS = "SELECT term, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc, CAST(max(pos) AS INTEGER) AS max_pos FROM t GROUP BY term"


def _postings(t: DataFrame) -> DataFrame:
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.max("pos").alias("max_pos"))


@query(f"WITH t AS ({O.TOKENS}) {POSTINGS}")
def postings(spark, d):
    return _postings(doc_tokens(spark, d))


@query(f"WITH t AS ({O.TOKENS}), f AS (SELECT term, min({{'d': doc_id, 'p': pos}}) AS f FROM t GROUP BY term) SELECT term, f.d AS first_doc, f.p AS first_pos, row_number() OVER (ORDER BY f) - 1 AS term_ord FROM f")
def vocab_order(spark, d):
    return index.term_order(index.vocabulary(doc_tokens(spark, d)))


@query(f"WITH t AS ({O.TOKENS}) SELECT count(DISTINCT term) AS n_terms, count(*) AS n_postings, max(doc_id) + 1 AS n_docs FROM t")
def index_header(spark, d):
    by_term = doc_tokens(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    return by_term.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_postings"), (F.max("last") + 1).alias("n_docs"))


def _saved(spark, d) -> index.Index:
    path = new_path(spark, "index")
    index.build(documents(spark, d)).save(path)
    return index.load(spark, path)


@query(f"WITH t AS ({O.TOKENS}) {POSTINGS}")
def index_roundtrip(spark, d):
    return _postings(_saved(spark, d).postings)


@query(f"WITH t AS ({O.TOKENS}) {POSTINGS}")
def binary_roundtrip(spark, d):
    path = new_path(spark, "binary")
    own = index.build(documents(spark, d))
    index.save_binary(own, path)
    dropped(own.postings)
    return _postings(index.read_binary(spark, path))


@query(f"WITH t AS ({O.TOKENS}) SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL")
def term_freq(spark, d):
    return index.term_frequencies(doc_tokens(spark, d))


@query(f"WITH t AS ({O.TOKENS}) SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL")
def doc_freq(spark, d):
    return index.document_frequencies(doc_tokens(spark, d))


@query(f"WITH t AS ({O.TOKENS}) SELECT term, round({O.idf('count(DISTINCT doc_id)')}, 6) AS idf FROM t GROUP BY term")
def idf(spark, d):
    t = stored(doc_tokens(spark, d), "tokens")
    return search.idfs(t, index.corpus_size(t))


def _search(name: str, text: str, k: int = search.TOP):
    def f(spark, d):
        return search.search(index.build(documents(spark, d)), text, k)

    QUERIES[name], ORACLE_SQL[name] = f, O.one_query(text, k)


for _name, _text in (("tfidf_top10", "ing"), ("phrase_match", PHRASE), ("search_top10", QUERY), ("search_dup_keyword", REPEATED), ("search_stopword_query", STOPPED), ("search_empty", "!!! "), ("search_unknown", "zzzzqq")):
    _search(_name, _text)


@query(O.one_query(QUERY))
def stream_search_top10(spark, d):
    """The documents as a stream of files, indexed batch by batch, then searched."""
    folder, path = new_path(spark, "arrived"), new_path(spark, "streamed")
    docs = documents(spark, d)
    docs.repartition(4, "doc_id").write.parquet(folder)
    indexing.index_stream(indexing.read_stream(spark, folder, docs.schema, files_each=2), path, new_path(spark, "progress")).awaitTermination()
    return search.search(indexing.load_stream(spark, path), QUERY)


@query(O.ranked(O.exploded("qid", O.query_terms("text"), "(SELECT conv_id * 1000 + turn AS qid, text FROM conversations WHERE role = 'user')", "qpos")))
def batch_search_top10(spark, d):
    asked = conversations(spark, d).where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("query"))
    t = stored(doc_tokens(spark, d), "tokens")
    return search.batch_search(t, asked, index.corpus_size(t))


@query(O.ranked(O.exploded("qid", O.query_terms("text"), "(SELECT item_id AS qid, text FROM benchmark)", "qpos")))
def benchmark_search(spark, d):
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    t = stored(doc_tokens(spark, d), "tokens")
    return search.batch_search(t, asked, index.corpus_size(t))


PREFIX = "th"
SUGGEST = f"WITH t AS ({O.TOKENS}), f AS (SELECT term, min({{'d': doc_id, 'p': pos}}) AS f FROM t WHERE starts_with(term, '{{}}') AND '{{}}' <> '' GROUP BY term) SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS INTEGER) AS n, term FROM f ORDER BY f LIMIT {search.SUGGESTIONS}"


def _suggest(name: str, prefix: str):
    QUERIES[name] = lambda spark, d: search.suggest(index.vocabulary(doc_tokens(spark, d)), prefix)
    ORACLE_SQL[name] = SUGGEST.replace("{}", prefix)


_suggest("suggest", PREFIX)
_suggest("suggest_case", "Th")
_suggest("suggest_empty", "")


@query(f"SELECT page_id, {O.html_escape('html')} AS html FROM pages")
def html_escape(spark, d):
    return pages(spark, d).select("page_id", T.html_escape(F.col("html")).alias("html"))


SNIPPET = f"substring({O.lower('text')}, 1, {T.SNIPPET}) || '...'"


@query(f"SELECT doc_id, {SNIPPET} AS snippet FROM documents")
def snippet(spark, d):
    return documents(spark, d).select("doc_id", T.snippet(T.ascii_lower(F.col("text"))).alias("snippet"))


MARKED = f"regexp_replace({O.html_escape(SNIPPET)}, {O._lit(T.highlight_pattern(QUERY))}, '<mark>\\1</mark>', 'g')"


@query(f"SELECT doc_id, {MARKED} AS html FROM documents")
def highlight(spark, d):
    return documents(spark, d).select("doc_id", T.highlight(T.snippet(T.ascii_lower(F.col("text"))), QUERY).alias("html"))


ROWS = f"SELECT rank, doc_id, source AS file_name, score, {SNIPPET} AS snippet FROM ({O.one_query(QUERY)}) JOIN documents USING (doc_id)"


@query(ROWS)
def result_rows(spark, d):
    own = index.build(documents(spark, d))
    return present.result_rows(search.search(own, QUERY), own.docs, name_col="source")


@query(f"SELECT rank, '{{\"rank\":' || rank || ',\"fileName\":' || CAST(to_json(file_name) AS VARCHAR) || ',\"score\":\"' || printf('%.4f', score) || '\",\"abstract\":' || CAST(to_json(snippet) AS VARCHAR) || '}}' AS json FROM ({ROWS})")
def result_json(spark, d):
    return present.result_json(result_rows(spark, d))


@query(f"""
WITH a AS (SELECT event_id, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
c AS (SELECT a.event_id, count(DISTINCT b.user_id) AS between_ FROM a JOIN a b ON b.event_id > a.before AND b.event_id < a.event_id GROUP BY a.event_id)
SELECT a.event_id AS n, a.user_id AS key, a.before IS NOT NULL AND coalesce(c.between_, 0) < {CAPACITY} AS hit FROM a LEFT JOIN c USING (event_id)""")
def lru_hits(spark, d):
    return cache.lru_hits(events(spark, d), CAPACITY, "event_id", "user_id")


@query(f"SELECT count(*) AS accesses, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits, CAST(sum(CAST(NOT hit AS INTEGER)) AS BIGINT) AS misses, least(count(DISTINCT key), {CAPACITY}) AS held FROM ({ORACLE_SQL['lru_hits']})")
def lru_stats(spark, d):
    return cache.lru_stats(lru_hits(spark, d), CAPACITY)


@query(f"SELECT DISTINCT unnest({O.STOP}) AS word")
def stopword_load(spark, d):
    path = new_path(spark, "stopwords")
    lines = ["# comment", "", "  \t"] + [f" {w}\r" for w in T.stopwords()]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    return spark.createDataFrame([(w,) for w in files.read_stopwords(spark, path)], "word string")


def sample_pdf(text: str, packed: bool) -> bytes:
    """A PDF of one page that shows a text."""
    body = f"BT /F1 12 Tf ({text}) Tj T* [(and ) -20 (more)] TJ ET\n".encode("latin-1")
    body = zlib.compress(body) if packed else body
    return b"%%PDF-1.4\n4 0 obj\n<< /Length %d%b >>\nstream\n%b\nendstream\nendobj\n%%%%EOF" % (len(body), b" /Filter /FlateDecode" * packed, body)


def sample_docx(text: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in text.split("\n")))
    return out.getvalue()


SAMPLES = {"b.txt": b"Plain Text", "a.html": b"<p>Some <b>HTML</b></p>", "c.pdf": sample_pdf("Hello World", False), "d.pdf": sample_pdf("Packed (page)", True), "e.docx": sample_docx("First line\nSecond line"), "f.bin": b"skipped", "g.txt": b""}


def sample_folder(spark: SparkSession) -> str:
    path = new_path(spark, "samples")
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    for name, data in SAMPLES.items():
        with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(data)
    return path


@query("SELECT * FROM (VALUES (0::BIGINT, 'a.html', chr(10) || 'some html' || chr(10)), (1, 'b.txt', 'plain text'), (2, 'c.pdf', 'hello world and more '), (3, 'd.pdf', 'packed (page) and more '), (4, 'e.docx', 'first line' || chr(10) || 'second line' || chr(10)), (5, 'g.txt', '')) v(doc_id, file_name, text)")
def file_documents(spark, d):
    return files.read_documents(spark, sample_folder(spark)).select("doc_id", "file_name", "text")


@query("SELECT * FROM (VALUES ('c.pdf', 'hello world and more '), ('d.pdf', 'packed (page) and more ')) v(file_name, text)")
def pdf_text(spark, d):
    return file_documents(spark, d).where("file_name LIKE '%.pdf'").select("file_name", "text")


@query("SELECT 'e.docx' AS file_name, 'first line' || chr(10) || 'second line' || chr(10) AS text")
def docx_text(spark, d):
    return file_documents(spark, d).where("file_name LIKE '%.docx'").select("file_name", "text")


@query("SELECT true AS never_built, true AS no_folder, true AS older, false AS newer")
def stale_check(spark, d):
    from datetime import datetime

    path = sample_folder(spark)
    row = (files.stale(spark, path, None), files.stale(spark, f"{path}/none", datetime(2100, 1, 1)), files.stale(spark, path, datetime(2000, 1, 1)), files.stale(spark, path, datetime(2100, 1, 1)))
    return spark.createDataFrame([row], "never_built boolean, no_folder boolean, older boolean, newer boolean")


# The SQL of the following is written out by hand: expected rows, or a formula that shares nothing with the engine's.
@query("SELECT * FROM (VALUES (0::INTEGER, 0::INTEGER, 'search'), (0, 1, 'the'), (0, 2, 'engine'), (1, 0, 'search'), (1, 1, '引'), (1, 2, '擎'), (2, 0, 'caf'), (3, 0, 'text'), (3, 1, 'text')) v(n, pos, term)")
def query_cases(spark, d):
    asked = _values(spark, ["Search, the ENGINE!", "search 引擎", "café", "text text", "!!! \u3000"])
    return asked.select("n", F.posexplode(T.query_terms(F.col("x"))).alias("pos", "term"))


@query("SELECT doc_id, CAST(list_reduce(list_prepend(5381::BIGINT, list_transform(range(1, length(source) + 1), lambda i: CAST(ascii(substring(source, i, 1)) AS BIGINT))), lambda a, c: (a * 33 + c) % 4294967296) % 256 AS BIGINT) AS bucket FROM documents WHERE source IS NOT NULL")
def hash_bucket(spark, d):
    return documents(spark, d).where("source IS NOT NULL").select("doc_id", T.djb2(F.col("source")).cast("long").alias("bucket"))


@query("SELECT * FROM (VALUES (0::BIGINT, '.hidden.txt', 'h'), (1, 'dirty.txt', 'ab' || chr(65533) || 'c'), (2, 'plain.pdf', 'only strings (here) '), (3, 'zero.txt', 'before')) v(doc_id, file_name, text)")
def file_cases(spark, d):
    """A hidden file, bytes that are no UTF-8, a PDF without text operators, and text after a NUL."""
    path = new_path(spark, "cases")
    system, folder = filesystem(path)
    system.create_dir(folder, recursive=True)
    for name, data in {".hidden.txt": b"H", "dirty.txt": b"ab\xffC", "plain.pdf": b"%PDF-1.4 (only strings \\(here\\)) (x)", "zero.txt": b"Before\x00After"}.items():
        with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
            f.write(data)
    return files.read_documents(spark, path).select("doc_id", "file_name", "text")


@query(f"SELECT n, rank, doc_id, score, n > 0 AS cached FROM ({O.one_query(QUERY)}), (VALUES (0::INTEGER), (1)) v(n)")
def session_results(spark, d):
    """A query twice: the second answer comes from the cache."""
    own = session.Session(index.build(documents(spark, d)), name_col="source")
    rows = []
    for n in (0, 1):
        hits = own.cache.hits
        rows += [(n, *r, own.cache.hits > hits) for r in own.ranked(QUERY)]
    return spark.createDataFrame(rows, "n int, rank int, doc_id long, score double, cached boolean")


@query()
def bench(spark, d):
    """Stage and query times in ms over the documents: build, reload, then the fixed queries."""
    rows, last = [], time.perf_counter()

    def lap(stage: str, n: int) -> None:
        nonlocal last
        now = time.perf_counter()
        rows.append((stage, (now - last) * 1000, n))
        last = now

    path = new_path(spark, "index")
    own = index.build(documents(spark, d))
    own.save(path)
    lap("build", own.size)
    own = index.load(spark, path)
    lap("reload", own.size)
    for text in BENCH:
        lap(f"query {text}", len(search.search(own, text).collect()))
    return spark.createDataFrame(rows, "stage string, ms double, n_rows long")
