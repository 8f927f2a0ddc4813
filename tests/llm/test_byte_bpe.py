import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from quern.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_plain_merges(odd_docs, real_docs, plain):
    for docs in (odd_docs, real_docs):
        rows = byte_bpe.round_trip(docs, PATH, P.PATTERN).collect()
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = sorted((d if d is not None else -1, np.array(plain.encode_ordinary(t), "<u4").tobytes(), t.encode()) for d, t in texts)
        assert sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids), bytes(r.decoded)) for r in rows) == want


def test_encode_then_decode(odd_docs):
    got = byte_bpe.decode(byte_bpe.encode(odd_docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in got) == sorted((r.text or "").encode() for r in odd_docs.collect())


def test_empty_table(odd_docs):
    assert byte_bpe.round_trip(odd_docs.limit(0), PATH, P.PATTERN).count() == 0


def test_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        byte_bpe.serialise({b"a": 0})
