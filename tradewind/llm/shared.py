"""The shared folder, files in it, and rows of packed arrays."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_UNSET: dict[str, str] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share. Only where that is unset, and all runs in one process as in tests, a local one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _UNSET.get("base")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by driver and executors")
        base = _UNSET["base"] = tempfile.mkdtemp(prefix="tradewind-llm-")
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where the driver has it, whatever folder the driver was started in. Where executors do not have that
    path, the package comes with ``--py-files``."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder's URI and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def new_file(folder: str, name: str) -> str:
    """A path no other attempt of the task writes; readers take their files from what the successful attempts returned."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str) -> DataFrame:
    """The rows written as Parquet and read again: cuts the lineage, and each row is computed once."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


ARROW_ROWS = 2_000
READ_ROWS = 512


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Has this session send rows to Python workers in batches of at most ``rows`` (a few megabytes of texts): both sides of the pipe hold a batch or two, and keep
    what they once needed. Parquet's texts are read ``READ_ROWS`` at a time, as the reader doubles one array for all of them."""
    for key, unset, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", rows), ("spark.sql.parquet.columnarReaderBatchSize", "4096", READ_ROWS)):
        if not 0 < int(spark.conf.get(key, unset)) <= most:
            spark.conf.set(key, str(most))


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def one_file_each(files: DataFrame, by: str) -> DataFrame:
    """A manifest dealt out so that each of its files is read by a task of its own, however small the manifest."""
    n = max(1, files.count())
    return files.repartitionByRange(n, by)


def give_back() -> None:
    """Returns freed memory to the system. Workers live on between tasks, and an executor may hold idle ones beside those at work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not the GNU C library


# ---- packed arrays: one row holds many numbers, so a shuffle moves bytes instead of rows ----------------------


def pack(*columns: np.ndarray) -> bytes:
    """Equally long arrays one after the other."""
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    n = len(raw) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions of its members), buckets without members left out."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in range(n):
        if ends[b] < ends[b + 1]:
            yield b, order[ends[b] : ends[b + 1]]


def per_bucket(packed: DataFrame, merge: Callable[[int, list[bytes]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """All blobs of a bucket given to ``merge``. Rows (bucket, blob); buckets are ranges of hashes, so they are alike in size.

    A task holds one bucket at a time. The caller makes as many buckets as keep each of them small (see ``bucket_count``).
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, bytes]] = []
        for part in parts:
            for b, blob in zip(part["bucket"].tolist(), part["blob"]):
                if held and held[0][0] != b:
                    yield from merge(held[0][0], [x for _, x in held])
                    held = []
                held.append((b, blob))
        if held:
            yield from merge(held[0][0], [x for _, x in held])
        held = []
        give_back()

    return packed.select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket").mapInPandas(run, schema)


def bucket_count(df: DataFrame, per_partition: int = 4, least: int = 64) -> int:
    """Buckets in proportion to the input: a multiple of its partitions, which Spark sizes by bytes."""
    return max(least, per_partition * df.rdd.getNumPartitions())


# A semi or anti join sends its ids to all executors up to this number (some 16 MB); beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def crc32_mod5(doc_id: str = "doc_id"):
    """crc32(doc_id as text) mod 5; null ids have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
