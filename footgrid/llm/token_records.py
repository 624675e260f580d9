"""Token ids as length-delimited binary records with an offset index.

Each shard is a file of records in ascending doc_id order; a record is

    length      unsigned 64-bit, little-endian: bytes of the payload
    length_crc  unsigned 32-bit: masked crc32 of those eight bytes
    payload     the document's ids, unsigned 16-bit (unsigned 32-bit where the vocabulary needs it)
    payload_crc unsigned 32-bit: masked crc32 of the payload

with the mask ``((crc >> 15) | (crc << 17)) + 0xA282EAD8`` mod 2**32. Beside
each shard its index holds, per record, byte offset, payload length and the
number of ids before it in the shard (three unsigned 64-bit integers), so a
reader can seek to any record in any order. Ids of documents (and their order)
are in a Parquet manifest of one row a document.

Files are written below the folder in ``spark.checkpoint.dir`` with pyarrow's
file systems, first under a name of the attempt's own and then renamed, so a
task that runs again replaces equal bytes with equal bytes.

Null texts are empty and get only the end id. Rows that repeat a doc_id are
documents of their own, in the order of their texts' hashes; a null doc_id sorts first.
An empty table writes no shard and gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footgrid.llm.common import new_folder, slices, stored
from footgrid.shipping import map_arrow

MASK_DELTA = 0xA282EAD8
#: Parts of texts whose ids a worker remembers at most.
REMEMBERED = 600_000


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def read_frame(file) -> bytes | None:
    """The next record's payload, or None at the file's end; raises ValueError on a damaged record."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack("<I", head[8:])[0] != masked_crc(head[:8]):
        raise ValueError("damaged record length")
    (n,) = struct.unpack("<Q", head[:8])
    payload, check = file.read(n), file.read(4)
    if len(payload) < n or len(check) < 4 or struct.unpack("<I", check)[0] != masked_crc(payload):
        raise ValueError("damaged record payload")
    return payload


class ChunkEncoder:
    """Encodes texts by a tokenizer whose tokens never span white space, remembering the ids of each part of a text.

    The tokenizer's pipeline must be: canonical composition, white space to
    blanks, lower case character by character, cutting by a pattern of which no
    match holds white space, then BPE of each match alone. A text of printable
    ASCII and Latin-1 letters is composed already and Python lowers it alike, so
    it is cut here by the tokenizer's own pattern, its classes narrowed to those
    letters and digits; any other text, and one that
    could hold a special token, is cut at ASCII white space only, which no
    composition crosses. Either way the library encodes each distinct part.
    """

    PLAIN = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ]*").fullmatch

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_buffer(data)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.find = re.compile(self.pattern().replace(r"\p{L}", "a-zß-öø-ÿ").replace(r"\p{N}", "0-9")).findall
        self.known: dict[str, bytes] = _Known(self.tokenizer, self.dtype)

    def pattern(self) -> str:
        import json

        steps = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in steps["normalizer"]["normalizers"]]
        cut = steps["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or cut["type"] != "Split" or not cut["invert"] or cut["behavior"] != "Removed":
            raise ValueError("a tokenizer of another pipeline")
        return cut["pattern"]["Regex"]

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        end, known, out = np.array([end_id], self.dtype).tobytes(), self.known, []
        for text in texts:
            text = text or ""
            if "<|" not in text and self.PLAIN(text):
                parts = self.find(text.lower())
            else:
                parts = [c.decode() for c in text.encode().split()]
            out.append(b"".join(map(known.__getitem__, parts)) + end)
            if len(known) > REMEMBERED:
                known.clear()
        return out


class _Known(dict):
    """Ids of parts; a new one is encoded by the library."""

    #: What byte-level tokenizers write for the bytes that Latin-1 doesn't print: the code points from 256, in order.
    PRINTED = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
    LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch

    def __init__(self, tokenizer, dtype: str):
        self.whole, self.word, self.dtype = tokenizer.encode, tokenizer.model.tokenize, dtype

    def __missing__(self, part: str) -> bytes:
        if self.LETTERS(part):  # nothing to normalise or cut
            ids = [token.id for token in self.word(part if part.isascii() else part.encode().decode("latin-1").translate(self.PRINTED))]
        else:
            ids = self.whole(part, add_special_tokens=False).ids
        self[part] = found = np.array(ids, self.dtype).tobytes()
        return found


_loaded: dict[bytes, ChunkEncoder] = {}


def loaded(data: bytes) -> ChunkEncoder:
    """A worker's encoder; workers are reused, so a tokenizer is built once."""
    key = hashlib.sha256(data).digest()
    if key not in _loaded:
        _loaded[key] = ChunkEncoder(data)
    return _loaded[key]


@dataclass(frozen=True)
class TokenRecords:
    tokenizer: str
    end_id: int = 1
    #: Texts' characters a shard is meant to hold.
    shard_chars: int = 16 << 20


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write(documents: DataFrame, folder: str, config: TokenRecords) -> DataFrame:
    """Write shards, indexes and manifest below ``folder``; returns the table of shards (shard, rows, ids)."""
    spark = documents.sparkSession
    # Rows equal in id and text differ by their number, so no group of them must lie in one shard.
    rows = documents.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    with open(config.tokenizer, "rb") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())  # a few megabytes, whatever the input
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, spark.sparkContext.defaultParallelism, -(-chars // config.shard_chars))
    store, root = _open(folder)
    store.create_dir(f"{root}/shards", recursive=True)

    def run(batches):
        from pyspark import TaskContext

        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        encoder = loaded(tokenizer.value)
        width = np.dtype(encoder.dtype).itemsize
        store, root = _open(folder)
        name = f"{root}/shards/part-{shard:06d}"
        index, n_rows, n_ids, offset, data = [], 0, 0, 0, None
        for batch in batches:
            for part in slices(batch, 8 << 20):
                if data is None:
                    data = store.open_output_stream(f"{name}.{attempt}.tmp")
                for ids in encoder.encode(part.column(1).to_pylist(), config.end_id):
                    index.append((offset, len(ids), n_ids))
                    data.write(framed := frame(ids))
                    offset, n_ids, n_rows = offset + len(framed), n_ids + len(ids) // width, n_rows + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([shard] * part.num_rows, pa.int32()), pa.array(range(n_rows - part.num_rows, n_rows), pa.int64()), pa.array([x[2] for x in index[-part.num_rows :]], pa.int64()), pa.array([width] * part.num_rows, pa.int32())],
                    ["doc_id", "shard", "record", "before", "width"],
                )
        if data is not None:
            data.close()
            with store.open_output_stream(f"{name}.idx.{attempt}.tmp") as out:
                out.write(np.array(index, "<u8").tobytes())
            store.move(f"{name}.{attempt}.tmp", f"{name}.rec")
            store.move(f"{name}.idx.{attempt}.tmp", f"{name}.idx")

    kind = rows.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("row")]
    ordered = rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    map_arrow(ordered, run, f"doc_id {kind}, shard int, record long, before long, width int").write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def shards_of(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(shard, width, start) of each shard; start: the ids of all shards before it, summed from the ends of their indexes."""
    shards = manifest.groupBy("shard").agg(F.first("width").alias("width"), F.count("*").alias("rows"))

    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            found = []
            for shard, width, rows in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(f"{root}/shards/part-{shard:06d}.idx") as file:
                    if file.size() != 24 * rows:
                        raise ValueError(f"index of shard {shard} has another length than its manifest")
                    file.seek(24 * (rows - 1))
                    _, length, before = struct.unpack("<QQQ", file.read(24))
                found.append(before + length // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["shard", "width", "ids"])

    # Running sums in blocks of shards, then over the blocks: no task orders more than a thousandth of the shards, or the blocks.
    sums = stored(map_arrow(shards, run, "shard int, width int, ids long").withColumn("block", F.floor(F.col("shard") / 1024)), "token-records-shards")
    blocks = sums.groupBy("block").agg(F.sum("ids").alias("all_ids"))
    blocks = blocks.select("block", (F.sum("all_ids").over(Window.orderBy("block")) - F.col("all_ids")).alias("earlier"))
    inside = F.sum("ids").over(Window.partitionBy("block").orderBy("shard")) - F.col("ids")
    return sums.withColumn("inside", inside).join(blocks, "block").select("shard", "width", (F.col("earlier") + F.col("inside")).alias("start"))


def read(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """(shard, record, start, n_tokens, ids_crc32) of every record, read from the files in whole and checked.

    A task reads one shard after the other; it seeks to each record by the
    index, as a shuffled reader would, and checks both checksums. start: the ids
    of all records before it, in earlier shards too.
    """

    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            for shard, width, first in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = f"{root}/shards/part-{shard:06d}"
                with store.open_input_stream(f"{name}.idx") as file:
                    index = np.frombuffer(file.read(), "<u8").reshape(-1, 3)
                with store.open_input_file(f"{name}.rec") as file:
                    for at in range(0, len(index), 4096):
                        begin, n, crc = [], [], []
                        for offset, length, before in index[at : at + 4096].tolist():
                            if file.tell() != offset:
                                file.seek(offset)
                            payload = read_frame(file)
                            if payload is None or len(payload) != length:
                                raise ValueError(f"index and records of shard {shard} differ")
                            ids = np.frombuffer(payload, f"<u{width}")
                            begin.append(first + before)
                            n.append(len(ids))
                            crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard] * len(n), pa.int32()), pa.array(range(at, at + len(n)), pa.int64()), pa.array(begin, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                            ["shard", "record", "start", "n_tokens", "ids_crc32"],
                        )

    # About one shard a task, each of a bounded number of characters; a number given is kept, however small the rows are.
    return map_arrow(shards.repartition(max(1, shards.count()), "shard"), run, "shard int, record long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, config: TokenRecords) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written files."""
    spark = documents.sparkSession
    folder = new_folder(spark, "token-records")
    manifest = write(documents, folder, config)
    found = read(spark, folder, shards_of(spark, folder, manifest))
    # Spark would guess the records' size from that of the shards' table and broadcast them.
    return manifest.join(found.hint("merge"), ["shard", "record"]).select("doc_id", "start", "n_tokens", "ids_crc32")
