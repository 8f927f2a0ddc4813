import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from quern.llm import token_files

PATH = P.path("word_bpe_49k.json")


def test_round_trip(spark, odd_docs, real_docs):
    plain = Tokenizer.from_file(PATH)
    for docs in (odd_docs, real_docs):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        want, start = [], 0
        for d, t in rows:
            ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
            start += len(ids)
        path = token_files.write(docs, PATH, end_id=1)
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_files.read(spark, path).collect()), key=lambda r: r[1])
        assert got == want


def test_runs_between_spaces_are_enough():
    with open(PATH, encoding="utf-8") as f:
        spec = f.read()
    own = token_files.Encoder(spec)
    assert own.by_run
    for text in ("a \u0301b", "A\u00a0B\x1cC\x85D", "x<|endoftext|>y <|startoftext|>", "ΑΣ ΑΣ.", "'s 'T it's \r\n", "\u2028 z", "e\u0301 \u1100\u1161 \u11a8", "Word, WORD. don't DON'T, x&&&. a\x1cb \x0cq été, ÉTÉ. İ, ÷, ß. <|ENDOFTEXT|> =\u0338 a,\u0338 12.5, \x00 , . '"):
        assert own.encode(text) == own._ids(text), text


def test_empty_table(spark, odd_docs):
    path = token_files.write(odd_docs.limit(0), PATH, end_id=1)
    assert token_files.read(spark, path).count() == 0


def test_shards_roll_over_by_size(spark, real_docs, odd_docs, monkeypatch):
    whole = sorted(map(tuple, token_files.read(spark, token_files.write(real_docs, PATH, end_id=1), ids=False).collect()))
    monkeypatch.setattr(token_files, "SHARD", 5000)
    path = token_files.write(real_docs, PATH, end_id=1)
    system, folder = token_files.filesystem(path)
    with system.open_input_file(f"{folder}/manifest.json") as f:
        shards = token_files.json.loads(f.read())["shards"]
    assert len(shards) > 20 and sum(s["docs"] for s in shards) == len(whole)
    assert sorted(map(tuple, token_files.read(spark, path, ids=False).collect())) == whole
    odd = token_files.read(spark, token_files.write(odd_docs, PATH, end_id=1), ids=False)
    assert odd.count() == odd_docs.count()


def test_special_tokens_must_be_marked():
    with open(PATH, encoding="utf-8") as f:
        spec = token_files.json.load(f)
    spec["added_tokens"].append(dict(spec["added_tokens"][0], id=60_000, content="end"))
    assert not token_files.check_splits(token_files.json.dumps(spec))
