import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from footgrid.llm import token_records as T
from tests.llm.helpers import awkward, empty

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = T.ChunkEncoder(open(PATH, "rb").read())
parts = st.lists(st.sampled_from(["a", "B", "é", "É", "\u0301", " ", "\n", "\u00a0", "Σ", "ς", "'s", "'LL", "<|endoftext|>", "1", "½", "İ", "ß", "!", "日", "don't", "\x1c", "\x85", "µ", "_", "the ", "#."]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), parts))
def test_equals_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert np.frombuffer(OWN.encode([text], 1)[0], "<u2").tolist() == [*LIBRARY.encode(text, add_special_tokens=False).ids, 1]


def test_frames_and_damage():
    data = b"".join(map(T.frame, (b"", b"abc", b"x" * 1000)))
    file = io.BytesIO(data)
    assert [T.read_frame(file) for _ in range(4)] == [b"", b"abc", b"x" * 1000, None]
    for place in (3, 14, len(data) - 5):
        broken = bytearray(data)
        broken[place] ^= 1
        file = io.BytesIO(bytes(broken))
        with pytest.raises(ValueError):
            while T.read_frame(file) is not None:
                pass
    with pytest.raises(ValueError):
        T.read_frame(io.BytesIO(data[16:30]))


def test_equal_rows_are_split_over_shards(spark):
    docs = spark.range(4000).selectExpr("7L AS doc_id", "'the same words in every row' AS text").repartition(8)
    found = T.round_trip(docs, T.TokenRecords(PATH, shard_chars=10_000)).orderBy("start").collect()
    n = found[0].n_tokens
    assert [r.start for r in found] == [n * i for i in range(4000)]


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = [tuple(r) for r in T.round_trip(docs, T.TokenRecords(PATH)).select("doc_id", "start", "n_tokens", "ids_crc32").orderBy("start").collect()]
    want = [(r.doc_id, [*LIBRARY.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in docs.collect()]
    assert sorted((d or 0, n, c) for d, _, n, c in got) == sorted((d or 0, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want)
    assert [d for d, *_ in got] == [None, 1, 2, 3, 4, 4, 5, 5, 6]
    assert [s for _, s, _, _ in got] == np.cumsum([0] + [n for _, _, n, _ in got])[:-1].tolist()
    assert T.round_trip(empty(spark), T.TokenRecords(PATH)).count() == 0
