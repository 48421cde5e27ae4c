import hashlib

import numpy as np
import public_tokenizers as tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from gridmere.llm import bpe, queries

PATH = tokenizers.path(queries.VOCABULARY)
REFERENCE = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_of_any_text(text):
    assert bpe.ids_of(text, PATH, tokenizers.PATTERN) == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdetionsh \n\t'", max_size=300))
def test_ids_of_words(text):
    assert bpe.ids_of(text, PATH, tokenizers.PATTERN) == REFERENCE.encode_ordinary(text)


def test_long_pretoken_and_overlapping_pairs():
    merge = bpe.RankQueue({bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 290, b"aaaa": 301}).merge
    assert merge(b"aaa") == [290]
    assert merge(b"aaaaa") == [290, 300]  # aa aa a: the merged pair aa+a has the lower rank, leftmost first
    text = "ab" * 30_000
    assert bpe.ids_of(text, PATH, tokenizers.PATTERN) == REFERENCE.encode_ordinary(text)


def test_round_trip_of_odd_rows(odd_docs, no_docs):
    rows = bpe.digests(bpe.decode_ids(bpe.encode_texts(odd_docs, PATH, tokenizers.PATTERN), PATH, tokenizers.PATTERN)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, bpe.digests(bpe.round_trip(odd_docs, PATH, tokenizers.PATTERN)).collect()), key=repr)
    want = []
    for r in odd_docs.collect():
        data = (r["text"] or "").encode()
        ids = np.array(REFERENCE.encode_ordinary(r["text"] or ""), "<u4")
        want.append((r["doc_id"], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(no_docs, PATH, tokenizers.PATTERN).count() == 0


def test_memory_holds_no_long_pretokens():
    own = bpe.Codec(bpe.load_ranks(PATH), tokenizers.PATTERN)
    rng = np.random.default_rng(6)
    for _ in range(40):
        own.encode("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 20_000)) + " some words")
    assert sum(map(len, own.seen)) + sum(map(len, own.older)) < 100
