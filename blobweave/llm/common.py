"""What the corpus operators share: staging, skew-safe lookups, text columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds over 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot.
HOT_SHARE = 2000
#: ... and at least this many rows.
HOT_LEAST = 100

_own_dir: str | None = None
#: Staged tables of this session are in a folder of their own.
_session = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A temporary folder stands in for it only in single-process local mode.
    """
    global _own_dir
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="blobweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/blobweave/{_session}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str = "stage", compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs the reread of files, not the
    recomputation of ``df``.
    """
    path = fresh_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        if at := getattr(df, "_staged_at", None):
            _delete(df.sparkSession, at)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this session has staged; no DataFrame built on it can be read afterwards."""
    _delete(spark, f"{shared_dir(spark)}/blobweave/{_session}")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """Left join of ``rows`` with ``table`` (one row per key, no null key), safe for hot keys.

    ``table[n]`` is the number of ``rows`` with that key.  Keys with more than
    1/HOT_SHARE of all rows are at most HOT_SHARE in number; they are joined by
    broadcast, so their rows stay where they are.  All others are joined by
    shuffle, where no key can hold more than that share.  ``n`` is not returned.
    Both inputs are read twice: pass staged or cheap ones.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    least = max(HOT_LEAST, total // HOT_SHARE)
    hot = F.broadcast(table.where(F.col(n) > least).drop(n).withColumn("_hot", F.lit(True)))
    out = rows.join(hot, key, "left")
    done = out.where("_hot").drop("_hot")
    rest = rows.join(hot.select(key), key, "left_anti")
    return done.unionByName(rest.join(table.where(F.col(n) <= least).drop(n), key, "left"))


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each row of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices_of(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``most`` bytes of ``column``; a longer row is a slice of its own."""
    batch = None
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, start = np.concatenate([[0], np.cumsum(sizes)]), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, upto[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()  # workers stay for other stages


def class_sums(texts: list[bytes], *tables: np.ndarray) -> list[np.ndarray]:
    """For each text the sum of ``table[byte]`` over its bytes, for each 256-entry table."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
    if not len(data):
        return [np.zeros(len(texts), np.int64) for _ in tables]
    full = np.flatnonzero(ends > starts)  # the sum over an empty range would be that of one byte
    out = []
    for table in tables:
        sums = np.zeros(len(texts), np.int64)
        sums[full] = np.add.reduceat(table[data], starts[full], dtype=np.int64)
        out.append(sums)
    return out


#: One entry per byte: 1 where a UTF-8 character begins.
CHAR_START = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.uint8)
#: One entry per byte: 1 for the white space that separates words.
SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)], np.uint8)

#: Numbers that are broadcast at most: 16 MB of ids, or of items of arrays.
FEW_IDS = 1_000_000


def only(rows: DataFrame, ids: DataFrame, key: str, array: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with the staged table ``ids`` (distinct in ``key``; a number and an ``array`` of small structs at most):
    by broadcast if that holds up to FEW_IDS ids and items, else by shuffle."""
    size = F.count("*") if array is None else F.count("*") + F.coalesce(F.sum(F.size(array)), F.lit(0))
    return rows.join(F.broadcast(ids) if ids.agg(size).first()[0] <= FEW_IDS else ids, key)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is null or not in the staged table ``ids``: by broadcast up to FEW_IDS of them, else by shuffle."""
    return rows.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, key, "left_anti")


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + _MIX[2]
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in a row, and where each text begins (one entry more than texts)."""
    from xxhash import xxh3_64_intdigest

    split = [t.lower().split() for t in texts] if lower else [t.split() for t in texts]  # bytes.lower() knows A-Z only
    starts = np.concatenate([[0], np.cumsum([len(w) for w in split])]).astype(np.int64)
    hashes = np.fromiter((xxh3_64_intdigest(w) for words in split for w in words), np.uint64, int(starts[-1]))
    return hashes, starts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive entries of ``words``; len(words) - size + 1 of them."""
    n = max(len(words) - size + 1, 0)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = mixed(out ^ words[i : i + n]) if n else out
    return out
