from datetime import datetime

from quern.functions import text as T
from quern.operators import index, search
from quern.registry import sample_docx, sample_pdf
from quern.sources import files
from quern.streaming import indexing


def test_pdf_forms():
    assert files.pdf_text(sample_pdf("Hello", False)) == "Hello and more "
    assert files.pdf_text(sample_pdf(r"a \(b\) \101\n(c)", True)) == "a (b) A\n(c) and more "
    assert files.pdf_text(b"x (long string) (abc) \\(no) (second \r one)") == "long string second   one "
    assert files.pdf_text(b"") == files.pdf_text(None) == ""
    assert files.pdf_text(b"obj << /Filter /FlateDecode >> stream\nnot zlib\nendstream") == ""
    assert files.pdf_text(b"obj << >> stream\nBT (a) Tj (b) ' 1 2 (c) \" (skipped) Td ET BT [(d) 3 (e)] TJ ET\nendstream") == "a b c d e "


def test_docx_forms(spark):
    assert files.docx_xml(sample_docx("a\nb"), join=True).count("<br>") == 0
    assert files.docx_xml(b"not a zip") == files.docx_xml(None) == ""


def test_folder(spark, tmp_path):
    data = {"B.TXT": b"Text \xff here\x00hidden", "a.htm": b"<p>One</p>", "c.pdf": sample_pdf("Hello", True), "d.docx": sample_docx("x\ny"), "e.png": b"", "f.txt": b"", "sub": None}
    for name, content in data.items():
        (tmp_path / name).mkdir() if content is None else (tmp_path / name).write_bytes(content)
    (tmp_path / "sub" / "z.txt").write_bytes(b"not read")
    rows = files.read_documents(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.file_name) for r in rows] == [(0, "B.TXT"), (1, "a.htm"), (2, "c.pdf"), (3, "d.docx"), (4, "f.txt")] and rows[4].text == ""
    assert rows[0].text == "text � here" and rows[1].text == "\none\n" and rows[2].text == "hello and more " and rows[3].text.split() == ["x", "y"]
    joined = files.read_documents(spark, str(tmp_path), docx_join=True, max_bytes=4).orderBy("doc_id").collect()
    assert joined[3].text == "xy" and joined[0].text == "text"
    assert not files.stale(spark, str(tmp_path), datetime(2100, 1, 1)) and files.stale(spark, str(tmp_path), datetime(2000, 1, 1)) and files.stale(spark, str(tmp_path), None)


def test_stopword_file(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# c\n\n \t\n  alpha \nbeta\r\n#x\n\t#gamma\nbeta\n", encoding="utf-8")
    assert set(files.read_stopwords(spark, str(tmp_path / "s.txt"))) == {"alpha ", "beta", "#gamma"}
    assert files.read_stopwords(spark, None) == T.stopwords()


def test_stream(spark, tmp_path):
    """An index built batch by batch, also after a restart, equals one built at once."""
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "doc_id long, text string"
    # the last one has no terms
    parts = [[(i, f"some words {i} number ten") for i in range(5)], [(10 + i, f"other words search engine {i}") for i in range(5)], [(20, None), (21, "")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        query = indexing.index_stream(indexing.read_stream(spark, folder, schema, 1), out, check)
        assert query.awaitTermination(120) and query.exception() is None
        got = indexing.load_stream(spark, out)
        want = index.build(spark.createDataFrame([x for p in parts[: parts.index(part) + 1] for x in p], schema))
        assert got.size == want.size
        for one, two in ((got.postings, want.postings), (got.terms, want.terms)):
            assert sorted(map(tuple, one.select(two.columns).collect())) == sorted(map(tuple, two.collect()))
        assert search.search(got, "search engine").collect() == search.search(want, "search engine").collect()
    assert sorted(map(tuple, got.docs.collect()), key=str) == sorted((x for p in parts for x in p), key=str)


def test_limits_are_off(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOST_BYTES", {"html": 5})
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.html").write_text("<p>longer than five</p>")
    (tmp_path / "s.txt").write_text("\n".join(f"word{i}" for i in range(3000)))
    folder, words = str(tmp_path / "docs"), str(tmp_path / "s.txt")
    assert "longer than five" in files.read_documents(spark, folder).first().text
    assert files.read_documents(spark, folder, most_bytes=files.MOST_BYTES).first().text == ""
    assert len(files.read_stopwords(spark, words)) == 3000 and len(files.read_stopwords(spark, words, most=5)) == 5


def test_missing_stop_word_file_gives_the_built_in_words(spark, tmp_path):
    got = files.read_stopwords(spark, f"file://{tmp_path}/none.txt")
    assert len(got) == 50 == len(set(got)) and {"the", "i", "的"} <= set(got)


def test_names_in_either_case_and_hidden_files(spark, tmp_path):
    for name in ("A.TXT", "b.HtM", "c.html", ".hidden.txt", "d.Txt", "e.bin", "_e.txt"):
        (tmp_path / name).write_text("<p>x" if "h" in name.lower() else "Plain")
    got = {r.file_name: r.text for r in files.read_documents(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"A.TXT", "b.HtM", "c.html", ".hidden.txt", "d.Txt", "_e.txt"}
    assert got[".hidden.txt"] == "<p>x" and got["_e.txt"] == "plain"
    assert got["A.TXT"] == got["d.Txt"] == "plain" and got["b.HtM"] == "\nx"
