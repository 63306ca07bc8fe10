"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from itertools import chain

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents are handed to Python code in groups of at most so many bytes of text (one longer text is its own group).
GROUP_BYTES = 2 << 20
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches of at most BATCH_ROWS rows: both sides hold a batch or two of long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator works on, under fixed names; all other columns go, so none can clash."""
    small_batches(df)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or in local mode (tests) a folder of our own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if context.master.partition("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
            held = context._jsc.sc().getCheckpointDir()
        path = held.get()
    return path.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def groups_of(batches, size: int = GROUP_BYTES):
    """Record batches cut into slices of about ``size`` bytes of their column ``text``."""
    for batch in batches:
        at, column = 0, batch.column(batch.schema.get_field_index("text"))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        total = 0
        for i, n in enumerate(lengths):
            if total and total + n > size:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(n)
        if at < batch.num_rows:
            yield batch.slice(at)
    trim()


def trim() -> None:
    """Hands freed memory back, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_held: dict = {}


def held(key: tuple, make):
    """``make()``, kept by a worker for its next tasks. A worker keeps one such object at a time: what an operator has built
    goes, with its memory, when another operator builds its own."""
    if key not in _held:
        _held.clear()
        gc.collect()
        trim()
        _held[key] = make()
        gc.collect()  # what only the making took
        trim()
    return _held[key]


def parted(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """``flat`` cut into parts of the given sizes."""
    return np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else []


class Numbers(dict):
    """Numbers words in the order in which they are first asked for; ``fresh`` holds the words since the last ``take``."""

    def __init__(self):
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def of(self, split: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of ``split``, end to end, and the size of each part."""
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes

    def take(self) -> list:
        fresh, self.fresh = self.fresh, []
        return fresh


class IdStore:
    """Token ids of numbered words, end to end."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size, self.flat = np.concatenate((self.size, sizes)), np.concatenate((self.flat, flat))

    def gather(self, at: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """Ids of texts that have ``counts`` words each, numbered ``at``."""
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return np.split(ids, np.concatenate(([0], ends))[np.cumsum(counts)][:-1]) if len(counts) else []

