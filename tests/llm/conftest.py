import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key int, kind string"


@pytest.fixture(scope="session")
def odd_docs(spark, sf):
    """Documents with nulls, empty and long texts, repeated rows, many scripts and columns whose names clash."""
    rnd = random.Random(5)
    texts = [None, "", " ", "a", "\x00\x01\r\n\t", "émile ÉMILE ﬁ ſK \u2028x", "日本語 テキスト", "a" * 3000, "ab " * 4000, "it's they're 12,345", "x\ud7ff\U0001f600 y\u0301"]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x1F300, 0x1F700), 32, 10])) for _ in range(200)) for _ in range(20)]
    rows = [(i, t, None if i % 3 else "en", f"s{i % 4}", None if t is None else len(t), "x", i, None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
