"""Intermediate tables of the operators in this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from periodlens.session import materialise

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Fixed value: the characters that separate words.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]+"


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives lost executors. Shuffle files that only served the write are removed as
    soon as it ends, so an operator never holds more than one step's shuffle and its tables.
    """
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        return materialise(df, label)
    finally:
        conf.set(CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Remove a table made by ``saved`` that nothing reads any more.

    A failure to remove it is left to whoever clears the shared folder.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def word_count(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") / F.lit(float(2**53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def then_freed(batches: Iterator, free: Callable[[], object]) -> Iterator:
    """``batches``; when they end, a worker that is used again gives back what the task held."""
    try:
        yield from batches
    finally:
        free()
        pa.default_memory_pool().release_unused()
