import base64
import tracemalloc
from hashlib import sha256

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, token_count
from tessera.llm.common import table

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
counter = token_count.Counter(open(JSON, encoding="utf-8").read())
codec = bpe.Codec.of(open(RANKS, "rb").read(), public_tokenizers.PATTERN)
library = Tokenizer.from_file(JSON)
ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

texts = st.one_of(
    st.text(max_size=60),
    st.text("abcdeht inrós'\n\t .,!19éß日", max_size=200),
    st.lists(st.sampled_from(codec.vocabulary.bytes), max_size=20).map(lambda b: b"".join(b).decode("utf-8", "ignore")),
    st.text(st.sampled_from("a ՘౜\U000323b0\U00010940x1"), max_size=30),
)


def ids(text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(texts)
def test_counts_equal_the_library(text):
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(texts)
def test_ids_equal_the_library(text):
    assert ids(text) == encoding.encode_ordinary(text)
    assert codec.decode(codec.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50_000).filter(lambda i: i in range(codec.vocabulary.size)), min_size=2, max_size=2))
def test_neighbours_fit_exactly_if_merging_leaves_them(pair):
    left, right = (codec.vocabulary.bytes[i] for i in pair)
    merged = codec.vocabulary._merged(left + right, codec.vocabulary.size)
    assert codec.vocabulary.fits(*pair) == (merged == pair)


def test_long_pieces_and_memos(monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", 2)
    monkeypatch.setattr(bpe, "MEMO", 2)
    monkeypatch.setattr(bpe, "PAIRS", 2)
    for text in ["ab" * 20_000, " " * 5000, "aaaa bbbb cccc dddd aaaa", "\n" * 999 + "x"]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert ids(text) == encoding.encode_ordinary(text)


def test_token_counts(odd, none, rows):
    found = token_count.token_counts(odd, JSON, limit=512)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(str, map(tuple, found.collect())))
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(str((i, len((t or "").encode()), n(t), n(t) > 512)) for i, t, *_ in rows)
    assert token_count.token_counts(none, JSON).count() == 0


def test_round_trip(odd, none, rows):
    got = sorted(map(str, map(tuple, bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect())))

    def expected(i, t):
        own = encoding.encode_ordinary(t or "")
        raw = np.array(own, "<u4").tobytes()
        return i, len(own), sha256(raw).hexdigest(), sha256((t or "").encode()).hexdigest()

    assert got == sorted(str(expected(i, t)) for i, t, *_ in rows)
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0


def test_encode_then_decode(odd, rows):
    coded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(coded, RANKS, ["doc_id"])
    assert sorted(map(str, map(tuple, back.collect()))) == sorted(str((i, t or "")) for i, t, *_ in rows)


def test_documents(spark, data):
    docs = table(spark, data, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in token_count.token_counts(docs, JSON).collect():
        assert r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids)
    for r in bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert r.ids_sha256 == sha256(np.array(encoding.encode_ordinary(text[r.doc_id]), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(text[r.doc_id].encode()).hexdigest()


def test_memory_of_one_unbroken_piece():
    """A word of 200,000 letters: under 120 bytes a byte of it."""
    text = "".join(np.random.default_rng(0).choice(list("etaoinshrd"), 200_000))
    for count in (counter.count, lambda t: len(codec.encode(t)) // 4):
        tracemalloc.start()
        assert 40_000 < count(text) < 160_000
        assert tracemalloc.get_traced_memory()[1] < 120 * len(text)
        tracemalloc.stop()
