"""Quality rules: repetition counts, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into buckets. Two multinomials are counted over them: the raw corpus (all documents) and a
trusted target (all documents labelled good). A document's score is the sum of log target/raw over its n-grams divided by
their number; a document is kept if its score reaches a threshold. The threshold is a quantile of the trusted documents' scores,
each under a target counted without its own fold: so they score as documents do that the target hasn't seen.

Defined results: a null text has no words; a text without words has score null and is not kept; repeated rows give repeated
rows and count as often as they occur; a null id stays null. Counts and scores cover whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, groups_of, held, parted, texts, written

#: Fixed value: the characters counted as symbols.
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
CACHE_WORDS = 120_000
#: Parts of the trusted documents, each scored by the others.
FOLDS = 8
#: Trusted ids that are sent to all workers at most (8 bytes each); documents are joined to more of them by a shuffle.
BROADCAST_IDS = 1 << 24
#: Score bins of the threshold's search, a unit.
BINS = 1 << 12


class Words:
    """Numbers of words, and their hashes, of the texts a worker has seen."""

    def __init__(self):
        self.known, self.hashes = Numbers(), np.empty(0, np.uint64)

    def number(self, split: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.known) > CACHE_WORDS:
            self.__init__()
        flat, sizes = self.known.of(split)
        new = self.known.take()
        self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))))
        return parted(flat, sizes)


def buckets_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of a text's words and word pairs."""
    mix = np.uint64(0x9E3779B97F4A7C15)  # any odd number
    one = hashes * mix
    two = (one[:-1] ^ (hashes[1:] + np.uint64(0x632BE59BD9B4E019))) * mix
    return np.concatenate((one, two)) >> np.uint64(64 - bits)


def repeats(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more."""
    if len(ids) < 4:
        return 0
    _, small = np.unique(ids, return_inverse=True)
    base = int(small.max()) + 1
    pair = small[:-1].astype(np.int64) * base + small[1:]
    _, pair = np.unique(pair, return_inverse=True)
    key = pair[:-1].astype(np.int64) * base + small[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    again = np.flatnonzero(count[inverse] > 1)
    marked = np.zeros(len(ids), bool)
    for shift in range(3):
        marked[again + shift] = True
    return int(marked.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen: set[str] = set()
    n = 0
    for line in lines:
        if line.strip(SPACES):
            n += line in seen
            seen.add(line)
    return n


def fold_of() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids with quality 1 that aren't toxic, and their folds."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return good.withColumn("fold", fold_of())


def with_folds(df: DataFrame, trusted: DataFrame) -> tuple[DataFrame, Callable[[pa.RecordBatch], np.ndarray]]:
    """doc_id, text and a third column of ``df``, and what tells from its batches each row's fold, -1 where it isn't trusted."""
    if trusted.count() > BROADCAST_IDS:
        return df.join(trusted, "doc_id", "left").select("doc_id", "text", F.coalesce("fold", F.lit(-1))), lambda part: part.column(2).to_numpy()
    ids = df.sparkSession.sparkContext.broadcast(np.sort(trusted.select("doc_id").toArrow().column(0).to_numpy()))

    def folds(part):
        known, own = ids.value, part.column(0)
        if not len(known):
            return np.full(part.num_rows, -1)
        asked = pc.fill_null(own, 0).to_numpy()
        there = known[np.minimum(np.searchsorted(known, asked), len(known) - 1)] == asked
        return np.where(there & own.is_valid().to_numpy(zero_copy_only=False), part.column(2).to_numpy(), -1)

    return df.select("doc_id", "text", fold_of()), folds


def count(df: DataFrame, trusted: DataFrame, bits: int) -> np.ndarray:
    """Bucket counts, of all texts of ``df`` (doc_id, text) and of each fold of the target. ``trusted``: doc_ids and their folds."""
    size = 1 << bits

    def run(batches):
        words, total = held(("words",), Words), np.zeros((1 + FOLDS, size), np.int64)
        for part in groups_of(batches):
            rows = folds(part) + 1  # 0: not trusted
            numbers = words.number([t.lower().encode().split() if t else [] for t in part.column(1).to_pylist()])
            for row in np.unique(rows).tolist():
                found = [buckets_of(words.hashes[x], bits) for x, r in zip(numbers, rows.tolist()) if r == row and len(x)]
                if found:
                    total[row] += np.bincount(np.concatenate(found).astype(np.int64), minlength=size)
        total[0] = total.sum(0)
        at = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in total)], names=["bucket", *columns])

    columns = ["raw", *(f"target{k}" for k in range(FOLDS))]
    marked, folds = with_folds(df, trusted)
    total = np.zeros((1 + FOLDS, size), np.int64)
    for r in marked.mapInArrow(run, "bucket long, " + ", ".join(f"{c} long" for c in columns)).groupBy("bucket").agg(*(F.sum(c).alias(c) for c in columns)).collect():  # 2**bits rows at most
        total[:, r["bucket"]] = r[1:]
    return total


def weights(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of target to raw of each bucket, one added to every count."""
    raw, target = raw + 1.0, target + 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def measure(df: DataFrame, weight: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and score of each text: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score."""
    bits = int(len(weight)).bit_length() - 1

    def run(batches):
        words, cased = held(("words", "cased"), lambda: (Words(), Words()))
        for part in groups_of(batches):
            docs = [t or "" for t in part.column(1).to_pylist()]
            numbers = words.number([t.lower().encode().split() for t in docs])
            plain = cased.number([t.encode().split() for t in docs])
            score = [float(weight[buckets_of(words.hashes[x], bits)].mean()) if len(x) else None for x in numbers]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(x) for x in plain], pa.int64()),
                    pa.array([len(t) - sum(map(t.count, SPACES)) for t in docs], pa.int64()),
                    pa.array([sum(map(t.count, SYMBOLS)) for t in docs], pa.int64()),
                    pa.array([repeated_lines(t) for t in docs], pa.int64()),
                    pa.array([repeats(x) for x in plain], pa.int64()),
                    pa.array(score, pa.float64()),
                ],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double")


def threshold(df: DataFrame, trusted: DataFrame, counts: np.ndarray, share: float) -> float:
    """The score that all but ``share`` of the trusted documents reach under a target without their own fold; -inf without any."""
    target = counts[1:].sum(0)
    weight = [weights(counts[0], target - own) for own in counts[1:]]
    bits = int(counts.shape[1]).bit_length() - 1

    def run(batches):
        words = held(("words",), Words)
        for part in groups_of(batches):
            fold = folds(part)
            numbers = words.number([t.lower().encode().split() if t else [] for t in part.column(1).filter(pa.array(fold >= 0)).to_pylist()])
            score = [float(weight[k][buckets_of(words.hashes[x], bits)].mean()) for x, k in zip(numbers, fold[fold >= 0].tolist()) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(score, pa.float64())], names=["score"])

    marked, folds = with_folds(df, trusted)
    return quantile(written(marked.mapInArrow(run, "score double"), "scores"), share)


def quantile(scores: DataFrame, share: float) -> float:
    """The exact quantile of a column ``score``, between two values in proportion; -inf without any. Only counts of bins and the values of one or two bins are collected."""
    scores = scores.withColumn("bin", F.floor(F.col("score") * BINS))
    held = sorted((r["bin"], r["n"]) for r in scores.groupBy("bin").agg(F.count("*").alias("n")).collect())
    if not held:
        return float("-inf")
    ends = np.cumsum([n for _, n in held])
    rank = share * (int(ends[-1]) - 1)
    low, high = int(np.floor(rank)), int(np.ceil(rank))
    first, last = np.searchsorted(ends, [low, high], side="right")
    values = sorted((r["score"], r["n"]) for r in scores.filter(F.col("bin").isin(held[first][0], held[last][0])).groupBy("score").agg(F.count("*").alias("n")).collect())
    upto = np.cumsum([n for _, n in values]) + (ends[first - 1] if first else 0)
    a, b = (values[i][0] for i in np.searchsorted(upto, [low, high], side="right"))
    return a + (b - a) * (rank - low)


def assess(df: DataFrame, labels: DataFrame, bits: int = 16, share: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` of each document, with ``enough`` (score reaches the threshold)."""
    docs = texts(df, id_col, text_col)
    trusted = written(trusted_ids(labels), "trusted")
    counts = count(docs, trusted, bits)
    weight = weights(counts[0], counts[1:].sum(0))
    least = threshold(docs, trusted, counts, share)
    return measure(docs, weight).withColumn("enough", F.coalesce(F.col("score") >= F.lit(least), F.lit(False)))
