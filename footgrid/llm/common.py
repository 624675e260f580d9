"""What the operators share: word splitting, bounded samples, slices of batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footgrid.storage import delete_folder, new_folder, stored

#: The white space of the word contracts: \x20 and \x09-\x0D, which is what ``bytes.split()`` splits on.
SPACES = " \t\n\x0b\x0c\r"
__all__ = ["LOWER", "SPACES", "Scratch", "UPPER", "ascii_lower", "bounded_ids", "crc_of_id", "new_folder", "slices", "stored"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Tables of one operator in the shared folder that its result doesn't need; ``clear`` deletes them once that is written."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.count = spark, new_folder(spark, what), 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        delete_folder(self.spark, self.folder)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def bounded_ids(labels: DataFrame, bound: int, key: str = "doc_id") -> DataFrame:
    """At most ``bound`` distinct ids, those of least hash: the same rows at every run and partitioning."""
    ids = labels.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(key), key).limit(bound)


def crc_of_id(c: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(c.cast("string").cast("binary"))


def slices(batch, max_bytes: int = 32 << 20) -> Iterator:
    """Cut an Arrow batch into slices whose buffers stay near ``max_bytes``."""
    rows = batch.num_rows
    step = max(1, min(rows, int(rows * max_bytes / max(1, batch.nbytes))))
    for start in range(0, rows, step):
        yield batch.slice(start, step)
