import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from footgrid.llm import bpe
from tests.llm.helpers import awkward, empty

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OWN = bpe.Bpe(RANKS, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
runs = st.lists(st.sampled_from(["a", "ab", "th", "ing", "é", "日本", "0", "12", "!", " ", "\n", "'s", "x" * 70]), max_size=120).map("".join)


def ids(text):
    return np.frombuffer(OWN.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), runs))
def test_equals_library_and_round_trips(text):
    text = text.encode("utf-8", "replace").decode()
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)).decode() == text


@pytest.mark.parametrize("piece", ["a" * 5000, "ab" * 3000, "thering" * 800, "é" * 1001, "aaab" * 777])
def test_long_pieces(piece):
    assert ids(piece) == LIBRARY.encode_ordinary(piece)


@settings(max_examples=200, deadline=None)
@given(runs, runs)
def test_join_is_the_product(a, b):
    data, more = a.encode(), b.encode()
    assert OWN.join(OWN.merge_by_heap(data), OWN.merge_by_heap(more)) == OWN.merge_by_heap(data + more)


def test_every_match_of_documents_comes_from_joins(tiny):
    """A match of several bytes is a product of single bytes: one join for it and for each half, once if it is remembered."""
    import pyarrow.parquet as pq

    class Counted(bpe.Bpe):
        joins = 0

        def join(self, a, b):
            self.joins += 1
            return super().join(a, b)

    own, texts = Counted(RANKS, P.PATTERN), pq.read_table(f"{tiny}/documents.parquet").column("text").to_pylist()
    for text in texts:
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == LIBRARY.encode_ordinary(text or "")
    longer = {m for t in texts for m in own.find(t or "") if len(m.encode()) > 1}
    assert own.joins >= len(longer) + sum(len(h) > 1 for h in own.halves) and len(longer) > 1000


def test_product():
    for n in (0, 1, bpe.FAN, bpe.FAN + 1, bpe.FAN**2 + 1):
        assert bpe.product([b"%d " % i for i in range(n)]) == b"".join(b"%d " % i for i in range(n))


def test_every_token_encodes_to_itself():
    assert all(OWN.merge(k) == [v] for k, v in RANKS.items())


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, P.PATTERN).collect()))
    want = []
    for r in docs.collect():
        tokens = LIBRARY.encode_ordinary(r.text or "")
        want.append((r.doc_id or 0, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(empty(spark), PATH, P.PATTERN).count() == 0
    assert bpe.encode(docs, PATH, P.PATTERN).where("decoded IS NULL").count() == 0
