import hashlib

import __spark_entry__
import corpus_pipeline as cp
from quern.llm import bagminhash

from test_bagminhash import brute, words
from test_decontaminate import brute as hits
from test_secrets import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_near_dedup_keeps_one_of_each(spark, real_docs, odd_docs, sf):
    rows = [(r.doc_id, r.text) for r in real_docs.collect()]
    kept = cp.near_dedup(spark, real_docs, sf)
    assert kept.columns == COLUMNS
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c, _ in brute(rows)})
    odd = bagminhash.deduplicated(odd_docs)
    assert odd.columns == odd_docs.columns
    texts = [r.text for r in odd.collect()]
    seen = [" ".join(words(t)) for t in texts if words(t)]
    assert len(seen) == len(set(seen))
    assert sum(not words(t) for t in texts) == sum(not words(r.text) for r in odd_docs.collect())


def test_decontamination_drops_hit_documents(spark, real_docs, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = [d for d, _, n, _ in hits([(r.doc_id, r.text) for r in real_docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10) if not n]
    kept = cp.decontamination(spark, real_docs, sf)
    assert kept.columns == COLUMNS and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_secret_scan_masks(spark, real_docs, sf):
    before = {r.doc_id: r.text for r in real_docs.collect()}
    after = cp.secret_scan(spark, real_docs, sf)
    assert after.columns == COLUMNS
    got = {r.doc_id: r.text for r in after.collect()}
    assert set(got) == set(before) and any(base(t) for t in before.values())
    for d, t in before.items():
        assert not base(got[d])
        if not base(t):
            assert got[d] == t or "[SECRET]" in got[d]


def test_run_and_registry(spark, sf):
    assert 4 <= len(cp.STAGES) <= 5
    out = __spark_entry__.queries()["pipeline"](spark, sf)
    rows = out.collect()
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 0 < len(rows) < spark.read.parquet(f"{sf}/documents.parquet").count()
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_empty_table(spark, real_docs, sf):
    docs = real_docs.limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_other_stages_on_odd_rows(spark, odd_docs, sf):
    """Nulls, empty and long texts, repeated rows and clashing columns pass the stages that the tests above give real rows only."""
    clash = odd_docs.selectExpr("*", "1 AS content", "2 AS p", "3 AS item", "4 AS row")
    before = sorted(map(str, clash.collect()))
    kept = cp.quality_classifier(spark, clash, sf)
    assert kept.columns == clash.columns and set(map(str, kept.collect())) <= set(before)
    clean = cp.decontamination(spark, clash, sf)
    assert clean.columns == clash.columns and sorted(map(str, clean.collect())) == before
    ids = cp.byte_bpe_ids(spark, clash, sf).collect()
    assert len(ids) == len(before)
    texts = sorted((r.doc_id if r.doc_id is not None else -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in clash.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.decoded_sha256) for r in ids) == texts
