"""Byte-level BPE by monoid tree reduction.

The encodings of a text's parts form a monoid: the empty encoding is its unit
and ``join`` its product. A text is cut by the pattern, whose matches never
share a token, so joining them is concatenation. A match is halved down to
single bytes, the halves are encoded recursively and joined; what is
remembered of halves and matches only saves doing a join again.

``join(a, b)`` re-encodes a window of tokens around the seam. Byte-level BPE
whose tokens all encode to themselves has one encoding for a string, and a
token sequence is it exactly if each two neighbours are what their own
concatenation encodes to. So the tokens outside the window stand once the
window's first token (or the pair across its left edge) and its last token (or
the pair across its right edge) stand; until then the window doubles, at most
to the whole. The tests hold this against a library's encoder.

Both the ids of a text's matches and, decoding, the bytes of its tokens are
concatenated up a tree of nodes of ``FAN`` children.

Null texts are empty, and an empty text has no tokens. A very long text, or a
very long match, is a deeper tree. Rows are kept as they come, repeated ones
included; an empty table gives an empty result; other columns are ignored. The
rank file is read by the driver and sent to the executors.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from footgrid.llm.common import slices
from footgrid.shipping import map_arrow

#: Matches, halves and token pairs whose ids a worker remembers at most, each; beyond, it starts anew.
REMEMBERED = 200_000
#: Children of a node where joining is concatenation.
FAN = 32
#: Bytes of a window from which candidates for merging wait in a heap; both ways give the same ids.
HEAP = 64


def product(parts: list[bytes]) -> bytes:
    """The concatenation of all parts, up a tree."""
    while len(parts) > 1:
        parts = [b"".join(parts[i : i + FAN]) for i in range(0, len(parts), FAN)]
    return parts[0] if parts else b""


class Bpe:
    """Encoder and decoder for one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.known: dict[str, bytes] = {}
        self.halves: dict[bytes, list[int]] = {}
        #: By two tokens as one number: what they encode to together, None for themselves.
        self.pairs: dict[int, list[int] | None] = {}

    def window(self, piece: bytes) -> list[int]:
        """Encode the few tokens' bytes around a seam."""
        return self.merge(piece) if len(piece) < HEAP else self.merge_by_heap(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Merge the neighbours of least rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        least = [ranks.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(least):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del least[at]
            if at:
                least[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(least):
                least[at] = ranks.get(parts[at] + parts[at + 1])

    def merge_by_heap(self, piece: bytes) -> list[int]:
        """The same for long windows: candidates wait in a heap by (rank, place), parts in a linked list."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or ranks.get(parts[i] + parts[j]) != rank:
                continue  # an end has been merged away since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(parts[i] + parts[after[i]])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heappush(heap, (r, h))
        return [ranks[p] for p in parts if p is not None]

    def pair(self, a: int, b: int) -> list[int] | None:
        """What the two tokens' bytes together encode to; None if to just these two tokens."""
        key = a << 32 | b
        found = self.pairs.get(key, 0)
        if found == 0:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            found = self.window(self.bytes_of[a] + self.bytes_of[b])
            found = self.pairs[key] = None if len(found) == 2 and found[0] == a else found
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the concatenation, from the encodings of its two parts."""
        if not a or not b:
            return a + b
        middle, width = self.pair(a[-1], b[0]), 1
        if middle is None:
            return a + b
        while True:
            rest, tail = a[:-width], b[width:]
            if (not rest or self.pair(rest[-1], middle[0]) is None) and (not tail or self.pair(middle[-1], tail[0]) is None):
                return rest + middle + tail
            width *= 2
            middle = self.window(b"".join(map(self.bytes_of.__getitem__, a[-width:] + b[:width])))

    def tree(self, piece: bytes) -> list[int]:
        """Encode halves recursively and join them."""
        if len(piece) < 2:
            return [self.ranks[piece]] if piece else []
        middle = len(piece) // 2
        return self.join(self.half(piece[:middle]), self.half(piece[middle:]))

    def half(self, piece: bytes) -> list[int]:
        """A half's encoding; short ones, which come again in other matches, are remembered."""
        if len(piece) > 12:
            return self.tree(piece)
        found = self.halves.get(piece)
        if found is None:
            if len(self.halves) >= REMEMBERED:
                self.halves.clear()
            found = self.halves[piece] = self.tree(piece)
        return found

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for match in self.find(text):
            ids = known.get(match)
            if ids is None:
                ids = np.array(self.tree(match.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(match) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[match] = ids
            out.append(ids)
        return product(out)

    def forget(self) -> None:
        """Free what is remembered: workers live on after a task, and other operators need their memory."""
        self.known.clear()
        self.halves.clear()
        self.pairs.clear()

    def decode(self, ids: bytes) -> bytes:
        return product(list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank a line."""
    with open(path, "rb") as lines:
        return ranks_of(lines.read())


def ranks_of(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


_loaded: dict[tuple[bytes, str], Bpe] = {}


def loaded(data: bytes, pattern: str) -> Bpe:
    """A worker's encoder; workers are reused, so the ranks are parsed once."""
    key = (hashlib.sha256(data).digest(), pattern)
    if key not in _loaded:
        _loaded[key] = Bpe(ranks_of(data), pattern)
    return _loaded[key]


def _shared(documents: DataFrame, path: str):
    """The rank file's bytes (about a megabyte, whatever the input) for the executors."""
    with open(path, "rb") as file:
        return documents.sparkSession.sparkContext.broadcast(file.read())


def encode(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary, text_bytes binary): ids as little-endian unsigned 32-bit integers, bytes as decoded from them."""

    shared = _shared(documents, path)

    def run(batches):
        bpe = loaded(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )
        bpe.forget()

    rows = documents.select("doc_id", "text")
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: ids and decoded bytes stay in the worker."""

    shared = _shared(documents, path)

    def run(batches):
        bpe = loaded(shared.value, pattern)
        for batch in batches:
            for part in slices(batch):
                n, a, b = [], [], []
                for text in part.column(1).to_pylist():
                    ids = bpe.encode(text or "")
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        bpe.forget()

    rows = documents.select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_arrow(rows, run, schema)


