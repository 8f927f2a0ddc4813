"""Secret scan with multipart credential linking, in DataFrame operations only.

Base kinds are reported wherever they match: assignments, access identifiers and long hex runs.
Weak candidates (short or unnamed secrets, account names, endpoints) are common words and addresses by
themselves. They are reported only where complementary parts lie in their scope: the same document, with at most
``SCOPE`` code points between the end of the earlier part and the start of the later one. Parts are joined
by interval: in order of their starts the greatest end of each kind so far, and in the opposite
order the least start of each kind, tell whether one lies in scope.

* weak_secret: an access identifier in scope, or both a weak_id and an endpoint;
* weak_id: an assignment in scope, or both a weak_secret and an endpoint;
* endpoint: an identifier (access or weak_id) and a secret (assign or weak_secret) in scope.

Reported spans that follow each other within ``SCOPE`` are one credential: each span has its number in the document.

Matches are leftmost and do not overlap within a kind. Their places come from the lengths of the pieces
between them, summed along the document, so a text with many matches costs no more than sorting them.

Defined results: a null or empty text has no spans; long texts are searched whole; spans are in code points, end exclusive; spans of
different kinds may overlap, those that tie in their start go by kind; rows are
independent, so repeated documents each get their row; other columns, whatever their names, are
ignored by ``scan`` and kept by ``redacted``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.plans.names import fresh
from quern.plans.shared import stored

SCOPE = 256


def any_case(word: str) -> str:
    """A pattern for the letters of ``word`` in either case, equal in all regex dialects."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _named(names: list[str]) -> str:
    return "(?:" + "|".join(any_case(n) for n in names) + r")[\"']?\x20*[:=]\x20*[\"']?"


#: kind: pattern, and the pattern of the part whose length counts with the least length; in the order of the list.
ASSIGN = _named(["password", "passwd", "secret", "token", "api_?key"])
VALUE = "[A-Za-z0-9+/_.=-]+"
KINDS = {
    "assign": ASSIGN + VALUE,
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",  # a run is matched whole, so shorter runs are those that fail
    "weak_secret": _named(["pwd", "pass", "auth", "private_?key", "credential"]) + r"[^\x00-\x20\"'<>,;]{4,}|[A-Za-z0-9+/]{40}",
    "weak_id": _named(["user", "username", "login", "account", "client_?id", "access_?key_?id"]) + r"[A-Za-z0-9_.@-]{3,}",
    # lengths are bounded where a long run could be tried from each of its characters
    "endpoint": r"[a-z][a-z0-9+.-]{1,15}://[^\x00-\x20\"'<>]+|[A-Za-z0-9-]{1,63}(?:[.][A-Za-z0-9-]{1,63}){0,6}[.]amazonaws[.]com",
}
BASE = ("assign", "access", "hex")
#: Kinds whose matches may still fail: the least length, and the pattern of what comes before the part that counts.
LEAST = {"assign": (12, ASSIGN), "access": (18, "")}


ROW = "struct<kind:int,gap:int,size:int,ok:boolean>"
#: Kinds of parts that may be complementary to others.
PARTS = [kind for kind in KINDS if kind != "hex"]


def _possible(kind: str, text: Column) -> Column:
    """Whether a text can hold a match, by what every match of the kind holds; most texts hold none and are not split."""
    named = F.contains(text, F.lit(":")) | F.contains(text, F.lit("="))
    return {
        "assign": named,
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{16}"),
        "weak_secret": named | text.rlike("[A-Za-z0-9+/]{40}"),
        "weak_id": named,
        "endpoint": F.contains(text, F.lit("://")) | F.contains(text, F.lit(".amazonaws.com")),
    }[kind]


def _counts(kind: str, match: Column) -> Column:
    """Whether a match has enough characters in the part that counts."""
    if kind not in LEAST:
        return F.lit(True)
    least, before = LEAST[kind]
    return F.length(F.regexp_replace(match, F.lit(f"^{before}"), F.lit("")) if before else match) >= least


def candidates(docs: DataFrame, text_col: str, found: str) -> DataFrame:
    """The columns of ``docs`` and ``found``: of all kinds each match's kind, the length of text since the match before it, its own length, and whether it counts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    names = dict(zip(KINDS, fresh([*docs.columns, found], *KINDS)))
    none = F.array().cast("array<string>")
    some = docs.select("*", *(F.when(_possible(kind, text), F.regexp_extract_all(text, F.lit(KINDS[kind]), F.lit(0))).otherwise(none).alias(name) for kind, name in names.items()))
    parts = []
    for number, (kind, name) in enumerate(names.items()):
        pieces = F.split(text, KINDS[kind], -1)
        # the last piece has no match after it: it becomes a row that does not count
        joined = F.zip_with(F.col(name), pieces, lambda m, p: F.struct(F.lit(number).alias("kind"), F.length(p).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("size"), (m.isNotNull() & F.coalesce(_counts(kind, m), F.lit(False))).alias("ok")))  # noqa: B023
        parts.append(F.when(F.size(name) > 0, joined).otherwise(F.array().cast(f"array<{ROW}>")))
    return some.select(*(F.col(f"`{c}`") for c in docs.columns), F.concat(*parts).alias(found))


def linked(rows: DataFrame) -> DataFrame:
    """``row, kind, start, end, credential``: a row for each span that is reported, from ``row`` (which names a document) and ``found``.

    A document without spans gets a row of nulls, and one for each match that is not reported.
    """
    rows = rows.select("row", F.posexplode_outer("found").alias("pos", "m")).select("row", "pos", "m.kind", "m.gap", "m.size", "m.ok")
    rows = rows.repartition("row")  # one exchange for all that follows
    along = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int")).withColumn("start", F.col("end") - F.col("size")).where("kind IS NULL OR ok")
    is_ = {kind: F.col("kind") == number for number, kind in enumerate(KINDS)}
    # parts that begin no later than this one and do not end too far before it; parts that begin no earlier and not too far after it
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = placed.withColumns({f"end_{k}": F.max(F.when(is_[k], F.col("end"))).over(before) for k in PARTS}).withColumns({f"start_{k}": F.min(F.when(is_[k], F.col("start"))).over(after) for k in PARTS})
    has = {k: F.coalesce(F.col(f"end_{k}") >= F.col("start") - SCOPE, F.lit(False)) | F.coalesce(F.col(f"start_{k}") <= F.col("end") + SCOPE, F.lit(False)) for k in PARTS}
    keep = (
        (F.col("kind") < len(BASE))
        | (is_["weak_secret"] & (has["access"] | (has["weak_id"] & has["endpoint"])))
        | (is_["weak_id"] & (has["assign"] | (has["weak_secret"] & has["endpoint"])))
        | (is_["endpoint"] & (has["access"] | has["weak_id"]) & (has["assign"] | has["weak_secret"]))
    )
    spans = near.withColumn("keep", F.coalesce(keep, F.lit(False))).select("row", *(F.when(F.col("keep"), F.col(c)).alias(c) for c in ("kind", "start", "end")))
    order = Window.partitionBy("row").orderBy(F.asc_nulls_last("start"), "kind")
    apart = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) + SCOPE
    return spans.withColumn("apart", apart.cast("int")).withColumn("credential", F.when(F.col("kind").isNotNull(), F.coalesce(F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)).cast("int"))).drop("apart")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans``: array of (start, kind, end, name, credential), by start, then kind; one row for each document."""
    own = docs.select(F.struct(F.monotonically_increasing_id().alias("n"), F.col(f"`{id_col}`").alias("id")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # a failing match leaves a document nothing: the first row of nulls keeps the document
    found = candidates(own, "text", "found").select("row", F.concat(F.array(F.lit(None).cast(ROW)), "found").alias("found"))
    names = F.array(*map(F.lit, KINDS))
    whole = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", F.get(names, F.col("kind")).alias("name"), "credential"))
    return linked(found).groupBy("row").agg(F.array_sort(F.collect_list(whole)).alias("spans")).select(F.col("row.id").alias(id_col), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each run of overlapping spans replaced by ``mark``; documents without spans as they are."""
    found, row, cuts = fresh(docs.columns, "found", "row", "cuts")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    all_ = candidates(docs, text_col, found)
    clean = all_.where(F.size(found) == 0).select(*columns)
    some = stored(all_.where(F.size(found) > 0).withColumn(row, F.monotonically_increasing_id()), "secrets")
    spans = linked(some.select(F.col(row).alias("row"), F.col(found).alias("found"))).where("kind IS NOT NULL")
    before = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("past", F.coalesce(F.max("end").over(before), F.lit(0)))
    by_row = cut.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "past"))).alias(cuts)).withColumnRenamed("row", row)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # text since the last span, and a mark where a new run of spans begins
    parts = F.transform(cuts, lambda c: F.when((c["start"] >= c["past"]) & ((c["start"] > c["past"]) | (c["past"] == 0)), F.concat(F.substr(text, c["past"] + 1, c["start"] - c["past"]), F.lit(mark))).otherwise(F.lit("")))
    last = F.array_max(F.transform(cuts, lambda c: c["end"]))
    new = F.concat(F.array_join(parts, ""), F.substr(text, last + 1, F.length(text)))
    fixed = some.join(by_row, row, "left").withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(f"`{text_col}`")).otherwise(new))
    return clean.unionByName(fixed.select(*columns))
