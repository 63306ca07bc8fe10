"""Token-ID output as ORC: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of doc_id and sorted in each file before they are encoded, so only texts are
shuffled, once, and nothing is encoded twice. The ids are one array<int> column, which ORC writes as run-length (RLEv2)
integers. Readers split files at stripes, skip stripes and row groups by the indexes, and find single documents through
the Bloom filter (``find``).

Defined results: a null text counts as empty (its only id is the end id); null ids come first in the order; rows that repeat
a doc_id stay, ordered by text; an empty table gives an empty folder that reads as no rows.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import ODD, PLAIN
from tessera.llm.common import IdStore, Numbers, groups_of, held, texts

#: Schema of the files; ``seq`` is a row's place in its file.
SCHEMA = "doc_id long, seq long, n_tokens long, ids array<int>"
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 800_000
_END = "\0\0end"


class LibraryEncoder:
    """The tokenizers library's ids of texts. It encodes each word once, which is then kept; texts with special tokens or characters outside Latin go to it whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.specials = [t.content for t in self.own.get_added_tokens_decoder().values()]
        vocab = self.own.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)  # a letter of a byte-level token is a byte
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        self.words, self.store = Numbers(), IdStore()
        self._end()

    def learn(self, words: list[str], at_once: int = 500) -> None:
        """Encodes words, many in a call; where each ends among the ids shows in the bytes that tokens stand for."""
        for part in (words[i : i + 40 * at_once] for i in range(0, len(words), 40 * at_once)):
            found = self.own.encode_batch_fast([part[i : i + at_once] for i in range(0, len(part), at_once)], is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, np.int32) for e in found])
            ends = np.cumsum(np.fromiter(map(len, map(str.encode, part)), np.int64, len(part)))
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            self.store.add(ids, np.diff(last, prepend=0))

    def flat(self, batch: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, ``end_id`` after each, and how many each has with it."""
        whole = [bool(ODD.search(t)) or any(s in t for s in self.specials) for t in batch]
        if len(self.words) > CACHE_WORDS:
            self.words, self.store = Numbers(), IdStore()
            self._end()
        at, counts = self.words.of([[_END] if w else [*PLAIN.findall(t), _END] for t, w in zip(batch, whole)])
        self.learn(self.words.take())
        self.store.flat[0] = end_id
        size = self.store.size[at]
        ends = np.cumsum(size)
        ids = self.store.flat[np.repeat(self.store.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        sizes = np.add.reduceat(size, np.cumsum(counts) - counts) if len(counts) else np.empty(0, np.int64)
        if any(whole):
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            parts = [np.concatenate((np.array(self.own.encode(t, add_special_tokens=False).ids, np.int32), x)) if w else x for t, w, x in zip(batch, whole, parts)]
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes

    def _end(self) -> None:
        """The end of a text is a word that no text has, with one id."""
        self.words.of([[_END]])
        self.words.take()
        self.store.add(np.zeros(1, np.int32), np.ones(1, np.int64))


def _encoder(path: str) -> LibraryEncoder:
    return held(("library", path), lambda: LibraryEncoder(path))


def write(df: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", row_index_stride: int = 1000, stripe_bytes: int = 64 << 20) -> None:
    """Writes each document's ids, ``end_id`` appended, in ascending order of doc_id, to ORC files in ``path``."""

    def run(batches):
        seq, encode = 0, _encoder(vocabulary).flat
        for part in groups_of(batches, 4 << 20):
            flat, sizes = encode([t or "" for t in part.column(1).to_pylist()], end_id)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column(0),
                "seq": pa.array(np.arange(seq, seq + len(sizes))),
                "n_tokens": pa.array(sizes),
                "ids": pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat)),
            })
            seq += len(sizes)

    rows = texts(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)
    (rows.write.option("compression", "lz4").option("orc.create.index", "true").option("orc.row.index.stride", row_index_stride).option("orc.stripe.size", stripe_bytes)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").orc(path))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows, with ``file``; files are read in parallel by stripes."""
    return spark.read.schema(SCHEMA).orc(path).select("doc_id", "seq", "n_tokens", "ids", F.col("_metadata.file_name").alias("file"))


def find(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Ids of a few documents; stripes and row groups without them are skipped by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of each document, from the files alone."""

    def run(batches):
        for part in batches:
            lists = part.column(3)
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(sums, pa.int64()), part.column(4)], names=["doc_id", "seq", "n_tokens", "ids_crc32", "file"])

    rows = read(spark, path).mapInArrow(run, "doc_id long, seq long, n_tokens long, ids_crc32 long, file string")
    # one row a file: what the other files before it hold
    files = spark.read.schema(SCHEMA).orc(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.sum("n_tokens").alias("held"), F.min("doc_id").alias("least"), F.min(F.isnotnull("doc_id")).alias("filled"))
    before = files.select("file", F.coalesce(F.sum("held").over(Window.orderBy("filled", F.col("least").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
