import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern import oracle
from quern.functions import text as T

STOP = set(T.stopwords())
CJK = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)]
MARKS = [(0x2000, 0x206F), (0x3000, 0x303F), (0xFF00, 0xFFEF)]


def within(c, ranges):
    return any(a <= ord(c) <= b for a, b in ranges)


def plain_tokens(text):
    """Character by character."""
    out, word, cjk = [], "", ""

    def flush():
        nonlocal word, cjk
        if word:
            data = word.encode()[:127].decode("utf-8", "ignore")
            out.append(data)
        out.extend(cjk)
        out.extend(a + b for a, b in zip(cjk, cjk[1:]) if len((a + b).encode()) < 8)
        word = cjk = ""

    for c in text:
        c = c.lower() if c.isascii() else c
        if within(c, CJK):
            if word:
                flush()
            cjk += c
        elif c.isascii() and not c.isalnum() or within(c, MARKS):
            flush()
        else:
            if cjk:
                flush()
            word += c
    flush()
    return [t for t in out if t not in STOP]


def tokens(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", T.doc_tokens(F.col("x")).alias("t")).collect()
    return [r.t for r in sorted(rows)]


CASES = {
    "The Quick_Fox's": ["quick", "fox", "s"], "don’t x—y": ["don", "t", "x", "y"], "搜索引擎": ["搜", "索", "引", "擎", "搜索", "索引", "引擎"],
    "测试HTML文档": ["测", "试", "测试", "html", "文", "档", "文档"], "没有": ["没"], "café É": ["café", "É"], "ひらがな": ["ひらがな"], "ＡＢＣ": [],
    "\U00020000\U00020001": ["\U00020000", "\U00020001"], "q" * 200: ["q" * 127], "é" * 100: ["é" * 63], "": [],
}


def test_document_cases(spark):
    assert tokens(spark, list(CASES)) == list(CASES.values())
    assert tokens(spark, [None]) == [[]]


def test_equals_state_machine(spark):
    seen = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.text(st.one_of(st.characters(codec="utf-8", exclude_characters="\x00"), st.sampled_from("aZ09 _-搜索引、　ｅé’\U00020000ひ한😀的"))))
    def gather(text):
        seen.append(text)

    gather()
    assert tokens(spark, seen) == [plain_tokens(x) for x in seen]


def test_sql_form_agrees():
    con = duckdb.connect()
    for x, want in CASES.items():
        assert con.execute(f"SELECT {oracle.doc_tokens('$1::VARCHAR')}", [x]).fetchone()[0] == want


@pytest.mark.parametrize(("text", "want", "strict"), [
    ("Search, the ENGINE!", ["search", "the", "engine"], ["search", "the", "engine"]), ("search 引擎", ["search", "引", "擎"], ["search"]), ("café", ["caf"], ["caf"]),
    ("text text", ["text", "text"], ["text", "text"]), ("  ", [], []), ("!!!", [], []), ("\U00020000a", ["a"], ["a"]),
])
def test_queries(spark, text, want, strict):
    got = spark.range(1).select(T.query_terms(F.lit(text)).alias("a"), T.query_terms(F.lit(text), True).alias("b")).first()
    assert (got.a, got.b) == (want, strict)


HTML = {
    "a<br>b": "a\nb", "a<br/>b": "ab", "a<b>b</b>": "ab", "x</pre>y": "x\ny", "x<pre>y": "xy", "2 < 3 > 1": "2  1", "<!-- a > b -->": " b --", "&amp;lt; &copy;": "&lt; &copy;",
    "<SCRIPT >x</script>y": "y", "v<script>unterminated": "v", "a\r\n\tb": "a b", "a<p>\nb": "a\nb", "\n a": "  a", "<a <p>x": "\nx", "a&nbsp;\nb": "a b", "<style>p</STYLE>z": "z", "&#65;&#x42;&#300;": "AB&#300;", "&#38;lt;": "&lt;", "x</thead>y</link>z</br>": "x\ny\nz",
}


def test_html(spark):
    rows = spark.createDataFrame(list(enumerate(HTML)), "n int, x string").select("n", T.html_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == list(HTML.values())


def test_small_functions(spark):
    row = spark.range(1).select(
        T.file_type(F.lit("A.HTM")).alias("a"), T.html_escape(F.lit("<a> & b")).alias("b"), T.highlight(F.lit("Big & small"), "big a.b").alias("c"), T.highlight(F.lit("x <y>"), " ").alias("d"),
        T.trimmed(F.lit(" \t a b\r\n")).alias("e"), T.clean_ascii(F.lit("É-A.1")).alias("f"), T.snippet(F.lit("é" * 200)).alias("g"), T.djb2(F.lit("abc")).alias("h"), T.head_bytes(F.lit("aéé"), 4).alias("i"), T.ascii_lower(F.lit("ÀB")).alias("j"),
    ).first()
    h = 5381
    for c in b"abc":
        h = (h * 33 + c) % 2**32
    assert tuple(row) == ("html", "&lt;a&gt; &amp; b", "<mark>Big</mark> &amp; small", "x &lt;y&gt;", "a b", "  a 1", "é" * 120 + "...", h % 256, "aé", "Àb")


def test_stopwords():
    words = T.stopwords()
    assert len(words) == len(set(words)) == 204
    assert sum(bool(re.fullmatch("[a-z]+", w)) for w in words) == 97


def test_query_keeps_all_keywords(spark):
    text = " ".join(f"w{i}" for i in range(400))
    df = spark.createDataFrame([(text,)], "text string")
    whole, strict, first = df.select(T.query_terms(F.col("text")), T.query_terms(F.col("text"), True), T.query_terms(F.col("text"), max_terms=256)).first()
    assert whole == strict == text.split() and first == whole[:256]
