"""Registered queries: each applies one operator to its whole table; SQL_<query> is its DuckDB form."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bagminhash, byte_bpe, cotraining, decontaminate, exact_topk, run_index, secrets, token_files, url_reputation, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classified(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), _read(spark, sf_dir, "pages"))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = url_reputation.filter_urls(_read(spark, sf_dir, "pages"), _read(spark, sf_dir, "labels"), RULES)
    return got.drop("bound")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.scan(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), size=10)
    hit = F.aggregate(F.transform("spans", lambda s: s["words"].cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = byte_bpe.round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.scan(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["name"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["name"].isin(*secrets.BASE))
    return got.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["credential"].cast("string")), ",").alias("credentials"))


def op6_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, nodes = run_index.removed(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate(F.transform("spans", lambda s: (s["end"] - s["start"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    found = nodes.select("node", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    return rows.select("doc_id", "node").join(found, "node").drop("node")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path, ids=False)


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(_read(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, names = warc.write(_read(spark, sf_dir, "pages"), least=0)
    return warc.read(spark, path, names).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(_read(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


SQL_op10_exact_topk = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '{decontaminate.WORD_SQL}')"


def _reputation_sql() -> str:
    """Rules and host reputation, from the same expressions as the operator's."""
    u = url_reputation
    lower = f"translate(coalesce(regexp_extract(url, '{u.URL}', 1), ''), '{u.UPPER}', '{u.LOWER}')"
    rules, actions = "NULL", "NULL"
    for action, rule in sorted(RULES, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rules, actions = f"CASE WHEN {fits} THEN '{rule}' ELSE {rules} END", f"CASE WHEN {fits} THEN '{action}' ELSE {actions} END"

    def level(name: str, members: str) -> str:
        spread = "(sum(n * pow(bad / n - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)"
        return f"{name} AS (SELECT 1 / least(greatest(coalesce({spread}, 0), 1e-4), 0.5) - 1 AS k FROM {members} WHERE n > 0 AND m > 0 AND m < 1)"

    shrunk = "(bad + k * m) / (n + k)"
    return f"""
WITH l AS (SELECT doc_id AS shown, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad FROM labels
  WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
p AS (SELECT page_id, {lower} AS host, coalesce(regexp_extract(url, '{u.URL}', 2), '') AS path FROM pages),
s AS (SELECT host, try_cast(nullif(regexp_extract(path, '{u.NUMBER}', 1), '') AS BIGINT) AS shown FROM p),
h AS (SELECT host, {u.domain_sql('host')} AS domain, {u.suffix_sql('host')} AS suffix, count(is_bad) AS n, CAST(coalesce(sum(is_bad), 0) AS BIGINT) AS bad FROM s LEFT JOIN l USING (shown) GROUP BY 1),
g AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5) / (sum(n) + 1) ELSE 0.0 END AS m FROM h),
s1 AS (SELECT suffix, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, any_value(m) AS m FROM h, g GROUP BY 1), {level('k1', 's1')},
s2 AS (SELECT suffix, {shrunk} AS m FROM s1, k1),
d1 AS (SELECT suffix, domain, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS bad, any_value(m) AS m FROM h JOIN s2 USING (suffix) GROUP BY 1, 2), {level('k2', 'd1')},
d2 AS (SELECT domain, {shrunk} AS m FROM d1, k2),
h1 AS (SELECT h.host, CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad, m FROM h JOIN d2 USING (domain)), {level('k3', 'h1')},
h2 AS (SELECT host, bad + k * m + 1e-6 AS a, n - bad + k * (1 - m) + 1e-6 AS b FROM h1, k3),
h3 AS (SELECT host, {u.lower_bound_sql('a', 'b')} AS bound FROM h2)
SELECT page_id, host, path, {rules} AS rule, coalesce({actions}, CASE WHEN bound > {u.LIFT} * CASE WHEN (SELECT sum(n) FROM h) > 0 THEN (SELECT m FROM g) ELSE 1 END THEN 'block' ELSE 'allow' END) AS verdict, n AS host_labelled, bad AS host_bad
FROM p JOIN h USING (host) JOIN h3 USING (host)"""


SQL_op2_url_reputation = _reputation_sql()

SQL_op3_decontaminate = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
s AS (SELECT DISTINCT n FROM g),
o AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s WHERE len(w) >= n)),
x AS (SELECT doc_id, i, n, item_id FROM o JOIN g USING (n, gram)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM x) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM x) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN y USING (doc_id)"""


def _secrets_sql() -> str:
    s = secrets
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    found = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(text, {quoted(p)}) AS m, string_split_regex(text, {quoted(p)}) AS p FROM documents WHERE regexp_matches(text, {quoted(p)})" for i, p in enumerate(s.KINDS.values()))
    number = {k: i for i, k in enumerate(s.KINDS)}
    ok = " AND ".join(f"(kind <> {number[k]} OR length({f'regexp_replace(m, {quoted("^" + before)}, {quoted("")})' if before else 'm'}) >= {least})" for k, (least, before) in s.LEAST.items())
    before = ", ".join(f"max(CASE WHEN kind = {number[k]} THEN ends END) OVER b AS end_{k}, min(CASE WHEN kind = {number[k]} THEN start END) OVER a AS start_{k}" for k in s.PARTS)
    has = {k: f"(coalesce(end_{k} >= start - {s.SCOPE}, false) OR coalesce(start_{k} <= ends + {s.SCOPE}, false))" for k in s.PARTS}
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for k, i in number.items()) + " END"
    joined = lambda test: f"coalesce(string_agg({name} || ':' || start || ':' || ends, ',' ORDER BY start, kind) FILTER ({test}), '')"
    counts = ", ".join(f"count(*) FILTER (kind = {number[k]}) AS n_{k}" for k in s.BASE)
    return f"""
WITH f AS ({found}),
e AS (SELECT doc_id, kind, unnest(m) AS m, unnest(p[1:len(m)]) AS p, generate_subscripts(m, 1) AS i FROM f),
a AS (SELECT *, CAST(sum(length(p) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS ends FROM e),
c AS (SELECT doc_id, kind, ends - length(m) AS start, ends FROM a WHERE {ok}),
n AS (SELECT *, {before} FROM c WINDOW b AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY doc_id ORDER BY start RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q AS (SELECT doc_id, kind, start, ends FROM n WHERE kind < {len(s.BASE)}
  OR kind = {number['weak_secret']} AND ({has['access']} OR {has['weak_id']} AND {has['endpoint']})
  OR kind = {number['weak_id']} AND ({has['assign']} OR {has['weak_secret']} AND {has['endpoint']})
  OR kind = {number['endpoint']} AND ({has['access']} OR {has['weak_id']}) AND ({has['assign']} OR {has['weak_secret']})),
g AS (SELECT *, CAST(coalesce(start > max(ends) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {s.SCOPE}, false) AS INTEGER) AS apart FROM q),
k AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY start, kind ROWS UNBOUNDED PRECEDING) AS credential FROM g)
SELECT doc_id, {counts}, sha256({joined(f'kind < {len(s.BASE)}')}) AS base_sha256, {joined('kind IS NOT NULL')} AS spans, coalesce(string_agg(CAST(credential AS VARCHAR), ',' ORDER BY start, kind) FILTER (kind IS NOT NULL), '') AS credentials
FROM documents LEFT JOIN k USING (doc_id) GROUP BY doc_id"""


SQL_op5_secrets = _secrets_sql()

SQL_op8_bagminhash = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS gram, count(*) AS n FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0) GROUP BY ALL),
z AS (SELECT doc_id, sum(n) AS size FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS met FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE met >= 0.8 * (p.size + q.size - met)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a AS doc_id, min(b) AS class_id, count(*) AS n_class FROM r GROUP BY 1)
SELECT doc_id, class_id, n_class FROM c"""

_BITS = "list_aggregate(list_transform(string_split(sha1(encode(coalesce(html, ''))), ''), lambda c: right('000' || bin(instr('0123456789abcdef', c) - 1), 4)), 'string_agg', '')"
_FIVE = "list_sum(list_transform(range(5), lambda j: CAST(substring(bits, 5 * i + j + 1, 1) AS INTEGER) * (16 >> j)))"
SQL_op9_warc = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BITS} AS bits FROM pages),
q AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST({_FIVE} AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS largest FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to FROM m"""
