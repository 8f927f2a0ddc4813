"""DuckDB forms of the search engine's queries, from the patterns that its expressions use."""

from __future__ import annotations

from quern.functions import text as T
from quern.operators import search as S


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def lower(x: str) -> str:
    return f"translate({x}, '{T.UPPER}', '{T.LOWER}')"


STOP = "[" + ", ".join(_lit(w) for w in T.stopwords()) + "]"


def doc_tokens(x: str) -> str:
    pairs = f"list_filter(list_transform(range(1, length(r)), lambda i: substring(r, i, 2)), lambda b: strlen(b) < {T.PAIR_BYTES})"
    cut = f"CASE WHEN strlen(r) <= {T.TOKEN_BYTES} THEN r ELSE left(r, list_max(list_filter(range(0, {T.TOKEN_BYTES + 1}), lambda n: strlen(left(r, n)) <= {T.TOKEN_BYTES}))) END"
    runs = f"regexp_extract_all({lower(f"coalesce({x}, '')")}, {_lit(T.RUN)})"
    return f"list_filter(flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[{T.CJK}]') THEN list_concat(regexp_extract_all(r, '(?s).'), {pairs}) ELSE [{cut}] END)), lambda t: NOT list_contains({STOP}, t))"


def query_terms(x: str, strict: bool = False) -> str:
    return f"list_transform(regexp_extract_all({lower(x)}, {_lit(T.STRICT_QUERY if strict else T.QUERY)}), lambda t: substring(t, 1, {T.TOKEN_BYTES}))"


def exploded(keys: str, array: str, source: str, pos: str = "pos", value: str = "term") -> str:
    return f"SELECT {keys}, CAST({pos} - 1 AS INTEGER) AS {pos}, {value} FROM (SELECT {keys}, unnest(a) AS {value}, generate_subscripts(a, 1) AS {pos} FROM (SELECT {keys}, {array} AS a FROM {source}))"


def decode_entities(x: str) -> str:
    n = f"CASE WHEN regexp_extract(p, {_lit(T.NUMERIC)}, 1) <> '' THEN CAST('0x' || regexp_extract(p, {_lit(T.NUMERIC)}, 1) AS INTEGER) WHEN regexp_extract(p, {_lit(T.NUMERIC)}, 2) <> '' THEN CAST(regexp_extract(p, {_lit(T.NUMERIC)}, 2) AS INTEGER) ELSE 0 END"
    out = f"CASE WHEN {n} BETWEEN 1 AND 255 THEN chr({n}) || regexp_replace(p, {_lit(T.NUMERIC)}, '') ELSE '&' || p END"
    named = " ".join(f"WHEN starts_with(p, {_lit(k)}) THEN {_lit(v)} || substring(p, {len(k) + 1})" for k, v in T.ENTITIES.items())
    return f"list_aggregate(list_transform(string_split({x}, '&'), lambda p, i: CASE WHEN i = 1 THEN p {named} ELSE {out} END), 'string_agg', '')"


def html_text(x: str) -> str:
    for pattern, new in T.HTML_STEPS:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(new)}, 'g')"
    x = decode_entities(x)
    for pattern, new in T.SQUEEZE:
        x = f"regexp_replace({x}, {_lit(pattern)}, {_lit(new.replace('$1', chr(92) + '1'))}, 'g')"
    return x


def html_escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


TOKENS = exploded("doc_id", doc_tokens("text"), "documents")
SIZE = "(SELECT max(doc_id) + 1 FROM t)"


def idf(df: str) -> str:
    return f"(ln(({SIZE} + 1.0) / ({df} + 1.0)) + 1)"


def ranked(words: str, k: int = S.TOP) -> str:
    """CTEs t, w and ranked results by query for ``words``: a query that gives qid, qpos, term."""
    return f"""
WITH t AS MATERIALIZED ({TOKENS}),
w AS ({words}),
tf AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT w.qid, tf.doc_id, sum(tf.tf * {idf('d.df')}) AS score FROM w JOIN tf USING (term) JOIN d USING (term) GROUP BY ALL),
n AS (SELECT qid, count(*) AS words FROM w GROUP BY ALL),
p AS (SELECT DISTINCT qid, doc_id FROM (
  SELECT w.qid, t.doc_id, t.pos - w.qpos AS at, count(DISTINCT w.qpos) AS c FROM w JOIN t USING (term) GROUP BY ALL) JOIN n USING (qid) WHERE c = words AND words > 1),
r AS (SELECT s.qid, s.doc_id, s.score + CASE WHEN p.doc_id IS NULL THEN 0 ELSE {S.BONUS} END AS score FROM s LEFT JOIN p ON p.qid = s.qid AND p.doc_id = s.doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT qid, rank, doc_id, round(score, 4) AS score FROM k WHERE rank <= {k}"""


def one_query(query: str, k: int = S.TOP) -> str:
    words = exploded("qid", query_terms(_lit(query)), "(SELECT 0 AS qid)", "qpos")
    return f"SELECT rank, doc_id, score FROM ({ranked(words, k)})"
