"""Getting this package to the Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to Spark once per application, so that no executor needs it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="footgrid-ship-")) / "footgrid_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(here.rglob("*.py")):
            out.write(file, f"{here.name}/{file.relative_to(here)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def release() -> None:
    """Give back what a task's batches held: workers live on between tasks, beside the JVM in one executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow`` by a function of this package."""
    ship(df.sparkSession)

    def tidy(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(tidy, schema)
