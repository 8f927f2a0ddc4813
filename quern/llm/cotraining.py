"""Quality classifier by co-training of two views.

The content view sees which words and marks a text holds. The metadata view sees the document's language, source and length
and, of the page that shows it, the host, the shape of the url, the size of the html and its number of tags. Each
view has a logistic classifier for each of two targets, low quality and toxicity. In each round both are
trained, calibrated on held-out labels, and score every unlabelled document; predictions of which a view is confident
become labels for the other. Confidence is measured against the prior: a view is confident of a class
if its calibrated error is at most the prior's error divided by ``LIFT``, so a view that knows
no more than the prior hands over nothing; the most confident go first. At the end the calibrated views
are combined as independent evidence (log-odds added, prior taken off once) and calibrated again, by cross-fitting over four folds;
the last classifiers are fitted on all labels. All documents are scored from stored features.

A page shows the document whose id is the number at the end of its url's path, as in operator 2; of several pages the
one with the least id counts. A document without a page has that as a value.

Fitting is bounded: at most ``LABELLED`` labelled rows and, in each round, ``PSEUDO`` pseudo-labelled rows
for each view and target, reach the driver: labelled ones by hash of the document id among the ids that the documents hold, pseudo-labelled ones by confidence, then hash. Rows
that repeat an id count once there, by the row whose features have the least hash. Everything else covers all documents.

Defined results: null and empty texts have no words; long texts count whole; null metadata is a value of its own; a document with several
labels counts as its worst; labels without a document id, or with only nulls, are ignored; without labels of both classes of a target
nothing is rejected for it; repeated rows, and rows that tie in all features, get equal scores; a probability of exactly one half rejects; other columns, whatever
their names, are ignored by ``classified`` and kept as they are by ``kept``; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.url_reputation import host_of, path_of, shown_document
from quern.plans import memo
from quern.plans.arrow import slices
from quern.plans.names import fresh
from quern.plans.shared import dropped, prepare, stored

LABELLED, PSEUDO, ROUNDS, FOLDS = 16_000, 2_000, 2, 4
#: How many times less than the prior a confident prediction of either class errs, by its calibrated probability.
LIFT = 2.0
TARGETS = ("low", "toxic")
CONTENT_BITS, META_BITS = 18, 12
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")
MARKS = "#$%&*+<=>@\\^_`{|}~!"
ASCII, CAPITALS = bytes(range(128)), bytes(range(65, 91))
CACHE_ENTRIES = 300_000
#: A feature enters a content classifier if its shares in both classes differ by so many standard errors, and it occurs so often.
SCREEN, LEAST = 4.0, 4


class _Features(dict):
    """Feature number of a word or mark."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        got = zlib.crc32(token.encode("utf-8", "surrogatepass")) & (1 << CONTENT_BITS) - 1
        if len(token) <= 64:
            self[token] = got
        return got


_features = _Features()


def capitals(text: str) -> int:
    """How many characters of a text are capitals: bytes for ASCII, characters only beyond it."""
    data = text.encode("utf-8", "surrogatepass")
    beyond = data.translate(None, ASCII).decode("utf-8", "surrogatepass") if len(data) > len(text) else ""
    return len(data) - len(data.translate(None, CAPITALS)) + sum(map(str.isupper, beyond))


def content(text: str | None) -> np.ndarray:
    """Distinct feature numbers of a text's words and marks."""
    if not text:
        return np.zeros(0, np.int32)
    all_ = TOKEN.findall(text.lower())
    tokens = set(all_)
    marks = sum(map(text.count, MARKS))
    size = len(all_).bit_length()
    # shape: how few distinct words, how many marks for each word, how many capitals
    tokens |= {f" distinct {size} {10 * len(tokens) // max(1, len(all_))}", f" marks {min(20, 20 * marks // max(1, len(all_)))}", f" upper {10 * capitals(text) // len(text)}"}
    return np.unique(np.fromiter(map(_features.__getitem__, tokens), np.int32, len(tokens)))


def page_views(pages: DataFrame) -> DataFrame:
    """``shown, page``: for each document that a page shows, what its page's url and html look like."""
    path, html = path_of("url"), F.coalesce("html", F.lit(""))
    bits = lambda n: F.ceil(F.log2(n + 1)).cast("string")
    shape = F.concat_ws(" ", F.size(F.split(path, "/")).cast("string"), F.regexp_extract(path, "^/([^/0-9]{0,16})/", 1), F.regexp_extract(path, r"([.][A-Za-z0-9]{1,16}|/)$", 1), F.col("url").contains("?").cast("string"), F.col("url").contains("#").cast("string"))
    tags = F.length(html) - F.length(F.replace(html, F.lit("<"), F.lit("")))
    seen = pages.select("page_id", shown_document("url").alias("shown"), F.array(F.concat(F.lit("host="), host_of("url")), F.concat(F.lit("url="), shape), F.concat(F.lit("html="), bits(F.length(html))), F.concat(F.lit("tags="), bits(tags))).alias("page"))
    return seen.where("shown IS NOT NULL").groupBy("shown").agg(F.min(F.struct("page_id", "page")).alias("p")).select("shown", "p.page")


def meta(lang: Column, source: Column, n_chars: Column, page: Column) -> Column:
    """Distinct feature numbers of a document's metadata."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    size = F.when(n_chars.isNull(), "null").when(n_chars < 0, "-1").otherwise(F.length(F.bin(n_chars)).cast("string"))
    own = F.array(F.concat(F.lit("lang="), text(lang)), F.concat(F.lit("source="), text(source)), F.concat(F.lit("size="), size), F.concat(F.lit("lang="), text(lang), F.lit(",size="), size))
    parts = F.concat(own, F.coalesce(page, F.array(F.lit("no page"))))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda x: F.pmod(F.crc32(x), F.lit(1 << META_BITS)).cast("int"))))


@dataclass
class Logistic:
    """Weights by feature, a constant, and the scale and shift that calibrate its log-odds."""

    weights: np.ndarray
    constant: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), sizes)
        return np.bincount(owner, self.weights[np.concatenate(rows)], len(rows)) + self.constant

    def odds(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.scale * self.raw(rows) + self.shift

    def odds_of(self, column: pa.ListArray) -> np.ndarray:
        """``odds`` of rows in an Arrow column without nulls."""
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        owner = np.repeat(np.arange(len(column)), np.diff(ends))
        return self.scale * (np.bincount(owner, self.weights[flat[ends[0] : ends[-1]]], len(column)) + self.constant) + self.shift


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, screen: bool, steps: int = 200, ridge: float = 1e-4) -> Logistic:
    """Logistic regression with a ridge penalty, by Adam over all rows at each step; ``screen``: only on features that tell the classes apart."""
    model = Logistic(np.zeros(1 << bits))
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    n1 = labels.sum()
    df, df1 = np.bincount(flat, minlength=1 << bits), np.bincount(flat[np.repeat(labels > 0, sizes)], minlength=1 << bits)
    share, n0 = df / len(rows), len(rows) - n1
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    chosen = (np.abs(df1 / n1 - (df - df1) / n0) >= SCREEN * error) & (df >= LEAST) if screen else df > 0
    held = chosen[flat]
    flat, owner = flat[held], np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[held]
    used, flat = np.unique(flat, return_inverse=True)
    w, b = np.zeros(len(used)), float(np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    m = v = np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        p = sigmoid(np.bincount(owner, w[flat], len(rows)) + b)
        error = (p - labels) / len(labels)
        grad = np.append(np.bincount(flat, error[owner], len(used)) + ridge * w, error.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model.weights[used] = w
    model.weights, model.constant = model.weights.astype(np.float32), float(b)
    return model


def calibration(odds: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift (Platt) by Newton steps, with targets drawn in by one row of each class."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    goal = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    x = np.stack([odds, np.ones_like(odds)])
    loss = lambda z: float(np.sum(np.logaddexp(0, z) - goal * z))
    for _ in range(50):
        p = sigmoid(ab @ x)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (goal - p))
        rate = 1.0
        while rate > 1e-4 and loss((ab + rate * step) @ x) > loss(ab @ x):
            rate /= 2
        ab = ab + rate * step
        if np.abs(step).max() < 1e-7:
            break
    return max(float(ab[0]), 0.0), float(ab[1])


@dataclass
class Model:
    """For each target, the classifiers of both views and how they combine; a target that could not be fitted is absent.

    exchanged: how many pseudo-labels each round had, by target, taker and class.
    """

    views: dict = field(default_factory=dict)
    prior: dict = field(default_factory=dict)
    last: dict = field(default_factory=dict)
    exchanged: list = field(default_factory=list)

    def probability(self, target: str, content: pa.ListArray, meta: pa.ListArray) -> np.ndarray:
        if target not in self.views:
            return np.zeros(len(content))
        one, other = self.views[target]
        scale, shift = self.last[target]
        return sigmoid(scale * (one.odds_of(content) + other.odds_of(meta) - self.prior[target]) + shift)

    def edges(self, target: str) -> tuple[float, float]:
        """Log-odds up to which class 0, and from which class 1 is held with confidence."""
        share = float(sigmoid(self.prior[target]))
        odds = lambda p: float(np.log(p / (1 - p)))
        return odds(share / LIFT), odds(1 - (1 - share) / LIFT)


def _words():
    """The column of content features of a column of texts."""

    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo.only("cotraining", _features.clear)
        for batch in batches:
            out = [pa.array([], pa.list_(pa.int32()))]
            for part in slices([pa.RecordBatch.from_arrays([batch], names=["text"])], "text"):
                rows = [content(x) for x in part.column(0).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows), pa.int32())))
            yield pa.concat_arrays(out)

    return found


def featured(docs: DataFrame, pages: DataFrame | None, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """The ``columns`` of ``docs`` and four more, stored: document id, features of both views, and their hash; and the four names."""
    names = fresh(docs.columns, "doc_id__", "content", "meta", "key", "lang__", "source__", "size__", "shown", "page")
    own, words, meta_, key, lang, source, size, shown, page = names
    n_chars = F.coalesce(F.col("n_chars").cast("long"), F.length("text").cast("long"))
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), lang: F.col("lang"), source: F.col("source"), size: n_chars, words: _words()(F.col("text").cast("string"))})
    rows = rows.select(*columns, own, lang, source, size, words)
    if pages is None:
        rows = rows.withColumn(page, F.lit(None).cast("array<string>"))
    else:
        seen = page_views(pages).toDF(shown, page)
        # rows without an id have no page, and must not meet in one task; the others are streamed past the pages
        found = rows.where(F.col(own).isNotNull()).join(seen.hint("shuffle_hash"), F.col(own) == F.col(shown), "left").drop(shown)
        rows = found.unionByName(rows.where(F.col(own).isNull()).withColumn(page, F.lit(None).cast("array<string>")))
    out = rows.withColumn(meta_, meta(F.col(lang), F.col(source), F.col(size), F.col(page)))
    return stored(out.select(*columns, own, words, meta_, F.xxhash64(words, meta_).alias(key)), "features"), names[:4]


def _once(df: DataFrame, *by: str) -> DataFrame:
    """One row for each ``by``: the one whose features have the least hash."""
    rest = [c for c in ("key", "content", "meta", *df.columns) if c in df.columns and c not in by]
    return df.groupBy(*by).agg(F.min(F.struct(*dict.fromkeys(rest))).alias("r")).select(*by, "r.*")


def _rows(df: DataFrame) -> pd.DataFrame:
    """A bounded table with both views on the driver, by document id."""
    got = df.toArrow()
    out = {name: got.column(name).to_numpy() for name in got.column_names if name not in ("content", "meta")}
    for name in ("content", "meta"):
        col = got.column(name).combine_chunks()
        flat, ends = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        out[name] = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
    return pd.DataFrame(out).sort_values("doc_id", kind="stable", ignore_index=True)


VIEWS = (("content", CONTENT_BITS), ("meta", META_BITS))


def _fitted(known: pd.DataFrame, labels: np.ndarray, pseudo: dict, target: str, name: str, bits: int) -> Logistic:
    """A view's classifier from labelled rows and the pseudo-labelled ones that the other view gave it."""
    rows = list(known[name])
    if (more := pseudo.get((target, name))) is not None:
        rows, labels = rows + list(more[name]), np.concatenate([labels, more["y"].to_numpy(dtype=float)])
    return fit(rows, labels, bits, screen=name == "content")


def _train(model: Model, known: pd.DataFrame, pseudo: dict, final: bool = False) -> None:
    """Fit and calibrate both views of each target on all but the first fold of the labelled rows, which calibrates them.

    ``final``: every fold calibrates, with classifiers that have not seen it, and the views are then fitted on all labelled rows.
    """
    fold = known["fold"].to_numpy()
    for target in TARGETS:
        y = known[target].to_numpy(dtype=float)
        ok = ~np.isnan(y)
        test, raws, views = [], [], []
        for out in range(FOLDS if final else 1):
            train, held = ok & (fold != out), ok & (fold == out)
            if len(set(y[train])) < 2 or not held.any():
                continue
            views = [_fitted(known[train], y[train], pseudo, target, name, bits) for name, bits in VIEWS]
            test.append(y[held])
            raws.append([view.raw(list(known[held][name])) for view, (name, _) in zip(views, VIEWS)])
        if not test or len(set(np.concatenate(test))) < 2:
            continue
        b = np.concatenate(test)
        if final:
            views = [_fitted(known[ok], y[ok], pseudo, target, name, bits) for name, bits in VIEWS]
        share = (b.sum() + 1) / (len(b) + 2)
        joint = np.full(len(b), -float(np.log(share / (1 - share))))
        for i, view in enumerate(views):
            raw = np.concatenate([r[i] for r in raws])
            view.scale, view.shift = calibration(raw, b)
            joint += view.scale * raw + view.shift
        model.views[target], model.prior[target], model.last[target] = tuple(views), float(np.log(share / (1 - share))), calibration(joint, b)


def _confident(features: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``key`` and, for each target and view, the log-odds if the view is confident, else null."""
    own = features.sparkSession.sparkContext.broadcast(model)
    names = [f"{t}_{v}" for t in TARGETS for v, _ in VIEWS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = own.value
        for batch in batches:
            out = [batch.column(0), batch.column(3)]
            for t in TARGETS:
                for view, i in zip(model.views.get(t, (None, None)), (1, 2)):
                    odds = view.odds_of(batch.column(i)) if view else np.zeros(batch.num_rows)
                    low, high = model.edges(t) if view else (-1, 1)
                    out.append(pa.array(odds, pa.float64(), mask=(odds > low) & (odds < high)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "key", *names])

    return features.mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{n} double" for n in names))


def _worst(labels: DataFrame) -> DataFrame:
    """``doc_id, low, toxic``: a labelled document's worst labels."""
    known = labels.where("doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((1 - F.min("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))


def train(features: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> Model:
    """Co-train on ``features`` (doc_id, content, meta, key) and ``labels`` (doc_id, quality, toxic)."""
    model = Model()
    worst = _worst(labels).join(features.select("doc_id").distinct(), "doc_id", "left_semi")
    worst = stored(worst.withColumn("h", F.xxhash64("doc_id")), "labels")
    sample = worst.orderBy("h", "doc_id").limit(labelled)
    known = features.join(F.broadcast(sample), "doc_id").select("doc_id", "key", "content", "meta", "low", "toxic", F.pmod(F.shiftright("h", 8), F.lit(FOLDS)).alias("fold"))
    known = _rows(_once(known, "doc_id"))
    if not len(known):
        dropped(worst)
        return model
    found: dict = {}
    _train(model, known, found, final=not rounds)
    for i in range(rounds if model.views else 0):
        sure = _once(_confident(features.where("doc_id IS NOT NULL"), model), "doc_id")
        sure = stored(sure.join(worst.select("doc_id"), "doc_id", "left_anti"), "confident")
        parts = []
        for t in model.views:
            for giver, taker in (("content", "meta"), ("meta", "content")):
                odds = F.col(f"{t}_{giver}")
                low, high = model.edges(t)
                for y, ok, order in ((0, odds <= low, odds.asc()), (1, odds >= high, odds.desc())):
                    share = float(sigmoid(model.prior[t]))
                    most = max(1, round(pseudo * (share if y else 1 - share)))
                    parts.append(sure.where(ok).orderBy(order, F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "key", F.lit(t).alias("target"), F.lit(taker).alias("taker"), F.lit(y).alias("y")))
        chosen = parts[0]
        for p in parts[1:]:
            chosen = chosen.unionByName(p)
        new = features.join(F.broadcast(chosen), ["doc_id", "key"]).select("doc_id", "content", "meta", "target", "taker", "y")
        new = _rows(_once(new, "doc_id", "target", "taker", "y"))
        dropped(sure)
        found = {}
        for (t, taker), rows in new.groupby(["target", "taker"]) if len(new) else ():
            found[t, taker] = rows
        model.exchanged.append({(t, taker, y): int((rows["y"] == y).sum()) for (t, taker), rows in found.items() for y in (0, 1)})
        _train(model, known, found, final=i == rounds - 1)
    dropped(worst)
    return model


def _scored(rows: DataFrame, names: list[str], model: Model, out: str) -> DataFrame:
    """``rows`` with a column ``out``: struct of p_low and p_toxic."""
    own = rows.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("p_low double, p_toxic double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        memo.only("cotraining", _features.clear)
        for one, other in batches:
            yield pa.StructArray.from_arrays([pa.array(own.value.probability(t, one, other), pa.float64()) for t in TARGETS], names=["p_low", "p_toxic"])

    return rows.withColumn(out, score(F.col(names[1]), F.col(names[2])))


def _keep(p: str) -> Column:
    return (F.col(f"`{p}`.p_low") < 0.5) & (F.col(f"`{p}`.p_toxic") < 0.5)


def trained(docs: DataFrame, labels: DataFrame, pages: DataFrame | None, columns: list[str], **args) -> tuple[DataFrame, list[str], Model]:
    """The stored features beside ``columns`` of ``docs``, their names, and the model."""
    prepare(docs.sparkSession)
    rows, names = featured(docs, pages, columns)
    return rows, names, train(rows.select(*(F.col(n).alias(x) for n, x in zip(names, ("doc_id", "content", "meta", "key")))), labels, **args)


def classified(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **args) -> DataFrame:
    """``doc_id, p_low, p_toxic, keep`` of every document."""
    rows, names, model = trained(docs, labels, pages, [], **args)
    return _scored(rows, names, model, "p").select(F.col(names[0]).alias("doc_id"), "p.p_low", "p.p_toxic", _keep("p").alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, pages: DataFrame | None = None, **args) -> DataFrame:
    """The documents, with all their columns, that are not rejected."""
    rows, names, model = trained(docs, labels, pages, docs.columns, **args)
    (p,) = fresh([*docs.columns, *names], "p")
    return _scored(rows, names, model, p).where(_keep(p)).select(*docs.columns)
