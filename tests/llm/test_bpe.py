import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_files

from .conftest import sha

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe._coder(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_ids_equal_the_library(batch):
    library, own = Tokenizer.from_file(PATH), bpe._coder(PATH)
    assert [x.tolist() for x in own.encode_batch(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_repeats_specials_and_odd_spaces(own, library):
    batch = ["aaaa" * 30, "abab" * 50, "  \n\n\t x", "<|endoftext|><|endoftext|> a<|endoftext|>", "\x1c\x1d\x85\xa0", "²³½ª", "I'll we've 'S", ""]
    assert [x.tolist() for x in own.encode_batch(batch)] == [library.encode(t, add_special_tokens=False).ids for t in batch]


def test_query_against_the_library(spark, small, odd, library):
    for docs in (small, odd):
        got = bpe.encode(docs, PATH, with_text=True).collect()
        want = []
        for r in docs.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            text = library.decode(ids, skip_special_tokens=False)
            want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()), ids, text))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_decode_round_trip(spark, odd):
    ids = bpe.encode(odd.filter("doc_id is not null"), PATH)
    back = {(r.doc_id, r.text) for r in bpe.decode(ids, PATH).collect()}
    assert back == {(r.doc_id, r.text or "") for r in odd.filter("doc_id is not null").collect()}


def test_empty_table(empty):
    assert bpe.encode(empty, PATH).collect() == []


def test_token_files(spark, small, odd, empty, library, tmp_path):
    import zlib

    for name, docs in (("small", small), ("odd", odd), ("empty", empty)):
        path = str(tmp_path / name)
        token_files.write(docs, path, PATH)
        rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, (r.text or "").encode()))
        start, want = 0, []
        for r in rows:
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted(map(repr, map(tuple, token_files.layout(spark, path).collect()))) == sorted(map(repr, want))
    found = token_files.find(spark, str(tmp_path / "small"), [3]).collect()
    assert len(found) == 1 and found[0].doc_id == 3 and found[0].ids[-1] == 0


def test_files_have_indexes_and_bloom_filters(spark, small, tmp_path):
    path = str(tmp_path / "orc")
    token_files.write(small, path, PATH)
    plan = token_files.find(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "EqualTo(doc_id" in plan
    import glob

    assert any(b"doc_id" in open(f, "rb").read() for f in glob.glob(f"{path}/*.orc"))
