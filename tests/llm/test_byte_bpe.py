"""Operator 6 against the tiktoken library, and the round trip."""

import base64
import hashlib
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import byte_bpe
from tests.llm.helpers import ODD_TEXTS, documents

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def ids_of(text):
    ids, back = byte_bpe.encode_block([text], PATH, public_tokenizers.PATTERN)[0]
    assert back == text.encode()
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_odd_texts_match_the_library():
    for t in ODD_TEXTS:
        assert ids_of(t or "") == LIBRARY.encode_ordinary(t or ""), t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aab '\n\t.1é ñ　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_matches_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_replay_of_many_words_at_once():
    words = [b"aaaaaaa", b"banana bandana", "ünïcödé".encode() * 7, b"mississippi" * 20, b"", b"\xff\xfe", b"the"]
    replay = byte_bpe.MergeReplay(PATH)
    assert replay.encode(words) == [LIBRARY._core_bpe.encode_single_piece(w) if w else [] for w in words]


def test_query_rows(spark):
    docs = documents(spark)
    got = byte_bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    lists = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()
    assert sorted(len(r.ids) for r in lists) == sorted(w[1] for w in want)
    assert byte_bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert all(got[r.doc_id] == LIBRARY.encode_ordinary(r.text) for r in docs.collect())
