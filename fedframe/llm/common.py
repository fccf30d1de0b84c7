"""Helpers shared by the operators: scratch tables, words, lambda lets."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir

#: The characters that separate words everywhere in this subpackage.
WHITESPACE = " \t\n\x0b\x0c\r"
#: Java and RE2 pattern of a run of them.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Bytes of a batch that a Python worker is handed, unless one row has more.
BATCH_BYTES = 8 << 20
#: Rows that a Parquet scan decodes at once, where short_reads() asks for it.
READ_ROWS = 256


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/fedframe/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again.

    This cuts the lineage, so a lost executor costs only the tasks it ran, and
    what is used more than once is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialise() made, once nothing that is still to run reads them."""
    for df in tables:
        drop_path(df.sparkSession, df.scratch_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches for Python cut at BATCH_BYTES from now on: texts can be long, and rows alone bound nothing."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def short_reads(df: DataFrame) -> DataFrame:
    """df, with Parquet decoded READ_ROWS rows at once from now on: by Spark's 4096, a column of long texts is one array of many MB, which grows the heap."""
    df.sparkSession.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    return df


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose last batch the worker gives freed memory back: it stays alive, idle beside the tasks that follow."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return wrapped


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITESPACE))


def split_words(text: Column) -> Column:
    """The words of a text (null: none); a text without words gives one empty word."""
    return F.split(trimmed(text), SPACE_RUN)


def count_words(text: Column) -> Column:
    """Number of words, 0 for null, empty and blank texts."""
    bare = trimmed(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE_RUN))).cast("long")
