"""What the operators of this subpackage share: table access, shared folders, Arrow batches, folds."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once; a row is a whole document, so the default of 10,000 is too many.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows of an Arrow batch, and so the memory of a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where the setting is missing a local one is made, with a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="maskwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/maskwell-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage: checkpoint() in the shared folder, so that no lost executor takes the rows along.
    Spark's cleaner removes the files with the frame where it is told to."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


class Workspace:
    """Tables in the shared folder for the steps of a loop. Unlike a checkpoint, a table that is read again brings its
    own statistics: those that a checkpoint takes along multiply from round to round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, shared_folder(spark), 0

    def settle(self, df: DataFrame) -> DataFrame:
        path, self.n = f"{self.folder}/{self.n}", self.n + 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Removes the tables."""
        remove(self.spark, self.folder)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % n, F.lit(0))


def texts(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns that an operator reads, under names of its own; a null text counts as empty."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def tidied(run):
    """The function of batches, giving free memory back to the system when a task's batches are done: workers live on,
    and an executor's memory holds several of them beside the JVM."""

    @functools.wraps(run)
    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return inner


def keep_memory() -> None:
    """Lets malloc keep up to 128 MB of freed memory for the next arrays of a loop: pages that are given back and taken anew for
    each array cost as much as much of the arithmetic. tidied() gives them back in the end."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def words_of(text: str) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher(dict):
    """word -> 64-bit hash, remembered. Call trim() between batches to keep it small."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; one hash of all words where there are fewer; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    out = np.zeros(n - width + 1, dtype=np.uint64)
    for j in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : n - width + 1 + j])
    return out


#: A-Z to lower case, other ASCII bytes than letters and digits to spaces; bytes of other characters stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def plain_words(text: str) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


#: So many ids are broadcast (8 bytes each, 16 MB); beyond that the texts are joined by shuffling.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose id is not in the one column of ids (null matches null)."""
    name = "_drop_" + uuid.uuid4().hex[:8]
    ids = settle(ids.toDF(name).distinct())
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].eqNullSafe(ids[name]), "left_anti")
