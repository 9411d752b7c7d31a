"""What the training-data operators share: tables, word patterns, the shared folder, lineage cuts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a longest run of characters other than space and the five ASCII controls from tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function of batches, after which its worker gives memory back: workers live on from task to task, and what one
    task's caches and tables took would else stay theirs beside the executor's heap."""

    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return tidied


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, `rows` go to Python at once at most: a batch is held by both sides, and its copies beside it. For plans that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), rows) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def for_pandas(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the columns, for pandas: a column of longs with nulls would arrive as floating point and lose large ids, so a null
    doc_id travels as 0 and a flag. ids_of() puts it back."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("doc_id"), doc_id.isNull().alias("_no_id"), *columns)


def ids_of(df) -> list[int | None]:
    """The ids of a batch of for_pandas()."""
    return [None if no else i for i, no in zip(df["doc_id"].tolist(), df["_no_id"].tolist(), strict=True)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text's bytes; none for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or where that is unset (tests) one of our own."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not told:
        told = "file://" + tempfile.mkdtemp(prefix="cityloom-")
        spark.sparkContext.setCheckpointDir(told)
        told = spark.sparkContext.getCheckpointDir()
    return told.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> None:
    """Deletes the files of a settled() table that no later plan reads."""
    spark = df.sparkSession
    root = shared_folder(spark)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if name.startswith(root) or name.startswith(root.replace("file://", "file:")):
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
