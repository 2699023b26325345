"""What the operators of this folder share: staged tables, slices of Arrow batches, words, crc32."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker looks at in one go.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 600


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local, a temporary folder is made and set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="inkspan-")
        atexit.register(shutil.rmtree, found, True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Removes the files of a staged table that nothing will read again."""
    spark = df.sparkSession
    for top in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes of a batch that goes to a Python worker, unless the session says otherwise.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def narrow(df: DataFrame) -> DataFrame:
    """``df``, read by Python workers in small batches: texts are long, and Spark's 10,000 rows would be held several times over."""
    conf = df.sparkSession.conf
    for key, value in BATCH.items():
        if conf.get(key, None) is None:
            conf.set(key, str(value))
    return df


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of a value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def give_back() -> None:
    """Returns freed memory to the system, so that a worker which lives on doesn't keep its peak."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds at most ``limit`` bytes of text (or one row) and SLICE_ROWS rows; nulls become empty texts."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        text = pc.fill_null(batch.column(at), "")
        batch = batch.set_column(at, pa.field(column, text.type), text)
        ends = np.cumsum(pc.binary_length(text).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, done + limit, side="right"))))
            yield batch.slice(start, end - start)
            start = end
        give_back()


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of an array of texts: each word's row, each word's place among the distinct ones, and those."""
    lists = pc.ascii_split_whitespace(text)
    rows, flat = pc.list_parent_indices(lists), pc.list_flatten(lists)
    keep = pc.not_equal(pc.binary_length(flat), 0)
    flat, rows = flat.filter(keep), rows.filter(keep)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return rows.to_numpy(zero_copy_only=False).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """text and label of at most ``rows`` labelled documents to learn from: those not held out, in the order of a hash.

    The bound is what makes the broadcast safe: ``docs`` is not shuffled. Null labels don't count; a document with
    several label rows is learnt from once for each.
    """
    chosen = labels.where((crc32_mod(F.col("doc_id"), 5) != 0) & F.col(column).isNotNull()).select(F.col("doc_id").alias("_id"), F.col(column).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(rows)
    return narrow(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "label")
