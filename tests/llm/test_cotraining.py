import numpy as np
from pyspark.sql import functions as F

from quern.llm import cotraining as c


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels", "pages"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(8)) == 0
    rows, names, model = c.trained(docs, labels.where(~held), pages, [])
    alone = c.train(rows.toDF("doc_id", "content", "meta", "key"), labels.where(~held), rounds=0)
    scored = [c._scored(rows, names, m, "p").select(F.col(names[0]).alias("doc_id"), "p.*").join(labels.where(held), "doc_id").toPandas() for m in (model, alone)]
    # the exchange takes nothing away
    right = [((g.p_low >= 0.5) == (g.quality == 0)).sum() + ((g.p_toxic >= 0.5) == (g.toxic == 1)).sum() for g in scored]
    assert len(model.exchanged) == c.ROUNDS and right[0] >= right[1]
    got = scored[0]
    # some 3,000 labels, of which 300 are toxic, find fewer words than the 16,000 that a larger table gives
    for p, y, recall in ((got.p_low, got.quality == 0, 0.9), (got.p_toxic, got.toxic == 1, 0.85)):
        said = p >= 0.5
        assert (said & y).sum() >= recall * y.sum()
        assert (said & ~y).sum() <= 0.01 * (~y).sum()
        assert abs(p.mean() - y.mean()) < 0.03  # calibrated on the whole


def test_views_exchange_labels(spark):
    """The content view has few labels of its own; what the metadata view is sure of teaches it."""
    rnd = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 3 == 0
        word = f"bad{rnd.integers(12)}" if bad else f"good{rnd.integers(12)}"
        rows.append((i, " ".join([word, *(f"w{x}" for x in rnd.integers(0, 200, 12))]), "en", "spam" if bad else "fine", 60))
        if i % 10 == 1 or i % 30 == 0:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = c.classified(docs, known).toPandas()
    assert ((got.p_low >= 0.5) == (got.doc_id % 3 == 0)).mean() > 0.99
    assert (got.p_toxic == 0).all()  # one class only: no classifier
    assert (got.keep == ((got.p_low < 0.5) & (got.p_toxic < 0.5))).all()
    *_, model = c.trained(docs, known, None, [])
    assert all(r["low", "content", y] > 50 for r in model.exchanged for y in (0, 1))


def test_page_metadata_is_a_view(spark):
    """The page that shows a document tells what its text does not; of several pages the least id counts."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 11}", "en", "s", 9) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    pages = [(i, f"http://{'spam' if i % 3 == 0 else 'fine'}.example.com/en/{i}{'.html' if i % 2 else '/?q'}", "<p>x</p>") for i in range(900)]
    pages += [(2000 + i, f"http://other.org/{i % 900}", None) for i in range(1800)] + [(None, None, None), (9999, "no url", "<p>")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)], "doc_id long, quality int, toxic int")
    got = c.classified(docs, labels, spark.createDataFrame(pages, "page_id long, url string, html string")).toPandas()
    assert len(got) == 900 and ((got.p_low >= 0.5) == (got.doc_id % 3 == 0)).mean() > 0.99
    without = c.classified(docs, labels).toPandas()
    assert ((without.p_low >= 0.5) == (without.doc_id % 3 == 0)).mean() < 0.8


def test_clashing_columns_come_back(spark):
    names = ["p", "__p", "content", "META", "key", "shown", "page", "doc_id__", "low", "toxic", "h", "fold", "url"]
    rows = [(i, f"{'bad' if i % 2 else 'good'} w{i % 7}", "en", "s", 50, *(f"{n}{i}" for n in names)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    pages = spark.createDataFrame([(1, "http://h.org/1", "x")], "page_id long, url string, html string")
    out = c.kept(docs, spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(300)], "doc_id long, quality int, toxic int"), pages)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [r for r in rows if r[0] % 2 == 0]


def test_ties_and_long_texts(spark):
    """Equal rows get equal scores, and a long text counts to its end."""
    rows = [(i, "bad" if i % 2 else "good", "en", "s", 4) for i in range(200)] + [(1000, "good " + " ".join(f"x{i % 50}" for i in range(200_000)) + " bad", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = c.classified(docs, spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")).toPandas()
    assert got[got.doc_id < 200].groupby(got.doc_id % 2).p_low.nunique().max() == 1
    assert len(got) == 201 and c._features["bad"] in c.content(rows[-1][1])


def test_odd_rows(spark, odd_docs):
    schema = "doc_id long, quality int, toxic int"
    labels = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(31)] + [(3, None, None), (None, 0, 1), (4, 0, 0), (4, 1, 1)], schema)
    assert c.classified(odd_docs, labels).count() == odd_docs.count()
    none = spark.createDataFrame([], schema)
    assert c.classified(odd_docs, none).where("keep").count() == odd_docs.count()
    kept = c.kept(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert c.classified(odd_docs.limit(0), labels).count() == 0


def test_calibration():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=20_000)
    y = (rnd.random(20_000) < c.sigmoid(0.7 * x - 1.5)).astype(float)
    scale, shift = c.calibration(3 * x + 2, y)
    assert abs(3 * scale - 0.7) < 0.06 and abs(2 * scale + shift + 1.5) < 0.06


def test_capitals_of_the_whole_text(odd_docs):
    def tenth(text):
        return c._features[f" upper {10 * sum(map(str.isupper, text)) // len(text)}"]

    odd = [r.text for r in odd_docs.select("text").collect() if r.text]
    for text in ["This.", "Thtion.", "Abcdef " * 50, "aBCDEFG" * 50, "\u00c9\u00c9\u00c9\u00e9A", "\u216f\u24b6\u01c5a", "x\ud800A", *odd]:
        assert tenth(text) in c.content(text)
        assert c.capitals(text) == sum(map(str.isupper, text))
    assert c._features[" upper 10"] not in c.content("Abcdef " * 50)


def test_repeated_and_absent_documents_take_no_label_away(spark, monkeypatch):
    """The fit sees each labelled document that exists once, however many rows share an id and however many labels have no document."""
    rows = [(i, f"word{i} text", "en", f"s{i}", 50) for i in range(40)] + [(0, f"copy{i % 3}", "en", "s", 9) for i in range(300)]
    labels = [(i, i % 2, 0) for i in range(40)] + [(i, 0, 0) for i in range(1000, 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    monkeypatch.setattr(c, "_train", lambda model, known, pseudo, final=False: seen.append(known))
    c.trained(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), None, [], labelled=40, pseudo=10)
    c.trained(docs.orderBy(F.desc("text")), spark.createDataFrame(labels[::-1], "doc_id long, quality int, toxic int"), None, [], labelled=40, pseudo=10)
    assert len(seen[0]) == 40 and (seen[0].low == 1).sum() == 20
    assert [list(x) for x in seen[0].content] == [list(x) for x in seen[1].content]


def test_repeated_documents_are_pseudo_labelled_once(spark, monkeypatch):
    rows = [(i, f"{'bad' if i % 2 else 'good'} w{i % 7}", "en", "spam" if i % 2 else "fine", 50) for i in range(1000)]
    rows += [(2001, "bad w1", "en", "spam", 50)] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen, own = [], c._train

    def train(model, known, pseudo, final=False):
        seen.append({k: len(v) for k, v in pseudo.items()})
        own(model, known, pseudo, final)

    monkeypatch.setattr(c, "_train", train)
    *_, model = c.trained(docs, spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(800)], "doc_id long, quality int, toxic int"), None, [], pseudo=1000)
    # each view hands over both classes in each round
    assert model.exchanged == [{("low", v, y): 100 + y for v in ("content", "meta") for y in (0, 1)}] * c.ROUNDS
    assert seen[-1] == {("low", "content"): 201, ("low", "meta"): 201}
