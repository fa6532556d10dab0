"""Chunks of documents, and messages between chunks and buckets.

A chunk is a set of documents of a bounded number of bytes, chosen by a hash of the id, the text and
the input partition, so that a retried task finds the same documents in it.  A bucket owns a share of the hash space.  Chunks send
buckets packed arrays (already made distinct, so a key that occurs in very many documents reaches
its bucket once a chunk at most), and buckets answer chunks in the same way.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of a chunk, and the least worth a chunk of its own.
CHUNK_BYTES = 8 << 20
LEAST_CHUNK_BYTES = 256 << 10
#: Bytes of an Arrow batch between Spark and Python; Spark's own bound lets four such buffers of 64 MB stand a task.
BATCH_BYTES = 4 << 20
#: Text bytes that the vectorised kernels take at once.
SLICE_BYTES = 1 << 20
#: A key is hot with more rows than this, and than its share of the most hot keys that are broadcast.
HOT_ROWS, MOST_HOT_KEYS = 500, 100_000
MESSAGE = "dest int, src int, body binary"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints.  If it names none: a temporary one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def join_sized(left: DataFrame, right: DataFrame, keys: list[str], size: str, largest: int) -> DataFrame:
    """Inner join with a table of one row a key (the first column of it a long) that says how many rows of left have it.

    Keys of more than `largest` rows are broadcast; their rows go through the other keys' join by a hash of
    the row, and match nothing there.  So none of these keys is one task's.  They are fewer than left's
    rows over `largest`, which the caller bounds (see `hot_size`)."""
    values = [c for c in right.columns if c not in keys]
    hot = right.where(F.col(size) > largest).select(*keys, *[F.col(v).alias(f"_hot_{v}") for v in values])
    marked = left.join(F.broadcast(hot), keys, "left").withColumn("_is_hot", F.col(f"_hot_{size}").isNotNull())
    marked = marked.withColumn("_key", F.when(F.col("_is_hot"), F.xxhash64(*left.columns)).otherwise(F.col(keys[0])))
    cold = right.where(F.col(size) <= largest).select(F.col(keys[0]).alias("_key"), F.lit(False).alias("_is_hot"), *keys[1:], *values)
    both = marked.join(cold, ["_key", "_is_hot", *keys[1:]], "left").where(F.coalesce(f"_hot_{size}", size).isNotNull())
    return both.select(*left.columns, *[F.coalesce(f"_hot_{v}", v).alias(v) for v in values])


def hot_size(rows: int) -> int:
    """Rows of a key beyond which it is hot: of so many rows, fewer than 100,000 keys can be."""
    return max(HOT_ROWS, -(-rows // MOST_HOT_KEYS))


def result_first(carry: list[str], own: list[str]) -> list[str]:
    """The carried columns without those that have the name of a column of the result (in any case)."""
    taken = {c.lower() for c in own}
    return [c for c in carry if c.lower() not in taken]


def tidy(batches):
    """Passes batches on, and at the end of the task gives unused memory back, as workers live on between tasks."""
    try:
        yield from batches
    finally:
        release()


def release() -> None:
    """Returns what Arrow's and C's allocators hold unused to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded_batches(df: DataFrame) -> None:
    """Has the session cut Arrow batches by bytes, so that long texts don't make batches beyond an executor's memory."""
    conf = df.sparkSession.conf
    bound = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    if bound is not None and not (bound.rstrip("b").isdigit() and int(bound.rstrip("b")) <= BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunk_count(df: DataFrame, text_col: str, chunk_bytes: int = CHUNK_BYTES) -> int:
    total = df.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(1, -(-total // chunk_bytes), min(shuffle_partitions(df.sparkSession), -(-total // LEAST_CHUNK_BYTES)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_chunks(df: DataFrame, id_col: str, text_col: str, n: int, carry: list[str] = ()) -> DataFrame:
    """Columns chunk, id, text and c0, c1, ... for the carried ones."""
    bounded_batches(df)
    ident = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`").cast("string")
    # With the partition that a row was read from, rows that are wholly equal spread as well.
    chunk = F.pmod(F.xxhash64(ident, text, F.spark_partition_id()), F.lit(n)).cast("int")
    return df.select(chunk.alias("chunk"), ident.alias("id"), text.alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)])


def tidied(function):
    """The function for one group, which gives unused memory back when it is done."""
    if function.__code__.co_argcount == 3:

        def of_two(key, left, right):
            out = function(key, left, right)
            release()
            return out

        return of_two

    def of_one(key, table):
        out = function(key, table)
        release()
        return out

    return of_one


def messages(dest: list[int], src: int, bodies: list[bytes]) -> pa.Table:
    return pa.table({"dest": pa.array(dest, pa.int32()), "src": pa.array([src] * len(dest), pa.int32()), "body": pa.array(bodies, pa.binary())})


def split_by(keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order that gathers equal keys, and (key, from, to) of each that occurs."""
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), np.append(first[1:], len(keys))[: len(found)].tolist(), strict=True))


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids as int64; a missing id is the largest, so it is smaller than none."""
    return table["id"].combine_chunks().fill_null(2**63 - 1).to_numpy(zero_copy_only=False).astype(np.int64)
