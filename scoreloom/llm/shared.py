"""What the corpus operators share: the shared folder, written tables, packed shuffles and byte kernels."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Word separators of the contracts: space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; only a local session may do without, for it has one machine."""
    set_ = spark.conf.get("spark.checkpoint.dir", None)
    if not set_:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        set_ = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", set_)
    return set_.rstrip("/")


#: Bytes of an Arrow batch between the JVM and Python; texts are long, and both sides hold a batch or two.
BATCH_BYTES = 12 << 20


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's Arrow batch size to ``most``, never raises it. It stays so, as results are computed after the call."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(name).rstrip("b")) if spark.conf.get(name).rstrip("b").lstrip("-").isdigit() else None
    if now is None or now <= 0 or now > most:
        spark.conf.set(name, f"{most}b")


class Scratch:
    """Tables and files of one operator call under the shared folder.

    A written table cuts the lineage: a lost executor costs no more than the stage that runs. ``drop`` frees
    a table that no later step reads; what the returned DataFrame reads stays until the folder is emptied.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scoreloom/{name}-{uuid.uuid4().hex[:12]}"
        small_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            at = jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(conf).delete(at, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, n: int, part: str = "part") -> DataFrame:
    """Rows to the task that their own ``part`` (0 to n - 1) names: no hashing, so that n key ranges fill n tasks."""
    return df.repartitionById(n, F.col(part))


def with_class(rows: DataFrame, classes: DataFrame, key: list[str], size: str, spark: SparkSession) -> DataFrame:
    """``rows`` with the columns of ``classes``, one row a key, by an inner join; ``size`` is the number of rows that have the key.

    Keys that fill more than a quarter of a partition come by broadcast: there are at most 4 a partition, whatever the size of the data. The others
    are merged, so that no key makes one task much longer than the rest. Both sides are read twice: they should be tables.
    """
    share = max(1, rows.count() // (4 * partitions(spark)))
    hot, cold = classes.where(F.col(size) > share), classes.where(F.col(size) <= share)
    there = rows.join(F.broadcast(hot), key)
    return there.unionByName(rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold.hint("merge"), key))


def low(text: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def blobs(batch: pa.RecordBatch, name: str) -> list[memoryview | None]:
    """The values of a binary or string column without copies; None for null."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [None if not v.is_valid else memoryview(v.as_buffer()).cast("B") for v in col]


def joined_bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array, and where each begins and ends (n + 1 offsets); null counts as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).fill_null(b"")
    col = pa.concat_arrays([col])
    offsets = np.frombuffer(col.buffers()[1], np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    data = col.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return flat, (offsets - offsets[0]).astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of text each, so that numpy's copies stay bounded; a longer text is alone."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary()).fill_null(b"")
    sizes = np.asarray(pc.binary_length(col), np.int64)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def record_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def store(uri: str):
    """(pyarrow file system, path) of a place in the shared folder; tasks write and range-read their files through it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
