import hashlib

import numpy as np
import pytest

from terralith.llm import bpe

from .cases import SCHEMA, rows, table, texts

tokenizers = pytest.importorskip("tokenizers")


def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


@pytest.mark.parametrize("mean", [2, 8, 512])
def test_ids_and_decoded_text_are_the_librarys(spark, mean):
    tok = library()
    got = bpe.encode(table(spark), chunk_bytes=mean).collect()
    want = {r[0]: r[1] for r in rows()}
    assert len(got) == len(rows())
    for row in got:
        ids = tok.encode(want[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == tok.decode(ids, skip_special_tokens=False)


def test_digests(spark):
    tok = library()
    want = {r[0]: r[1] for r in rows()}
    for row in bpe.digests(table(spark)).collect():
        ids = tok.encode(want[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_memory_bounds_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP_WORDS", 5)
    monkeypatch.setattr(bpe, "KEEP_CHUNK_BYTES", 100)
    tok, own = library(), bpe.Codec(bpe.vocabulary_path(), 16)
    for t in texts():
        raw = (t or "").encode()
        at = [0, *bpe.cuts(np.frombuffer(raw, np.uint8), 16).tolist(), len(raw)]
        chunks = [raw[a:b] for a, b in zip(at, at[1:])]
        own.prepare([c for c in chunks if c])
        ids = own.encode(chunks)
        assert own.decode([b"", ids, ids]) == [b"", *[tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()] * 2]
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_empty_table(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_vocabularies_go_by_the_library(spark):
    from tokenizers import Tokenizer

    assert bpe.Codec(bpe.vocabulary_path()).whole is False
    name = "byte_bpe_50k.json"
    tok = Tokenizer.from_file(bpe.vocabulary_path(name))
    assert bpe.Codec(bpe.vocabulary_path(name)).whole is True
    data = rows()
    got = bpe.encode(table(spark), name).collect()
    want = sorted((str(r[0]), tok.encode(r[1] or "", add_special_tokens=False).ids) for r in data)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want
    text = {str(r[0]): r[1] or "" for r in data}
    assert all(r.decoded == tok.decode(r.ids, skip_special_tokens=False) for r in got) and text
