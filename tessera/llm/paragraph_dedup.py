"""Substring dedup by paragraphs: MinHash banding, exact verification, removal by components.

A paragraph is a line of up to LONGEST words. A longer line is cut into stretches of about 10 words: after each word whose key
is the least among the REACH words before and after it. The key hashes the word and the next one, ends of sentences come
before other words, and nothing further away counts, so the same passage is cut alike wherever it stands in a line, but for
its first and last words: what precedes its first cut and follows its last is in stretches with other text.

Paragraphs with the same set of n-word shingles are one class. Bands of MinHash values bring classes together: with 8 bands of
2, two sets of similarity 0.8 meet in some band with a chance of 0.9997. Sets of up to SMALL shingles have the pairs of their
least hashes instead, as many as it takes for two sets that reach the threshold to have a pair in common: none is missed; sets
just above SMALL have both, to meet either. Each band value names one class; the others are verified against it (exact Jaccard
of the shingle sets), and what a band value's classes still differ in is paired up under exact bounds and verified, as in the
n-gram Jaccard join.
Verified links form components; all but a component's first paragraph (by doc_id, then place) are copies.
Copies go where a run of them, with nothing but paragraphs under n words between, reaches ``least_words`` words (0: all go).

Defined results: null or empty texts have no paragraphs; paragraphs under n words are left alone; rows with a null id keep
all their text; rows that repeat a doc_id are one document; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import groups_of, held, texts, written
from tessera.llm.components import components
from tessera.llm.jaccard_join import MAP, Shingler, bit_table, in_table, mixed, open_pairs, parity, verified

#: Words of a line that isn't cut, words on both sides that a cut's key is compared with.
LONGEST, REACH = 25, 4
#: Shingles of a set that has no bands, but pairs of its least hashes.
SMALL = 11
_SEEDS = [np.uint64(xxhash.xxh3_64_intdigest(b"minhash %d" % i)) for i in range(64)]


class Words(Shingler):
    """Shingles, and which words end a sentence."""

    def forget(self) -> None:
        super().forget()
        self.final = np.empty(0, bool)

    def learn(self, new: list[bytes]) -> None:
        super().learn(new)
        self.final = np.concatenate((self.final, np.fromiter((w[-1] in b".!?" for w in new), bool, len(new))))


def cuts(h: np.ndarray, final: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which words a paragraph ends after inside lines of more than LONGEST words, from the words' hashes, whether they end a
    sentence and the numbers of their lines."""
    n = len(h) - 2 * REACH - 1
    if n < 1:
        return np.empty(0, np.int64)
    top = np.uint64(1 << 63)
    low, key = h >> np.uint64(1), h >> np.uint64(1)
    key[:-1] = mixed(mixed(low[:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + low[1:]) >> np.uint64(1)
    key[~final] |= top
    at = slice(REACH, REACH + n)
    # REACH + 1 words at least are on both sides of a cut in its line
    least = (line[:n] == line[2 * REACH + 1 :]) & (np.bincount(line)[line[at]] > LONGEST)
    for d in range(1, REACH + 1):
        least &= (key[at] < key[REACH - d : REACH - d + n]) & (key[at] <= key[REACH + d : REACH + d + n])
    return np.flatnonzero(least) + REACH


def cut_up(make: Words, batch: list[str | None]) -> tuple[np.ndarray, ...]:
    """All paragraphs of the texts: row, start, end (code points, line end included), words; and the hashes of all words."""
    docs = [t or "" for t in batch]
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    offsets = np.cumsum(lengths + 1) - lengths - 1
    joined = "\n".join([*docs, ""])  # a line end after each text
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    lines = np.flatnonzero(codes == 10) + 1
    space = (codes == 32) | (codes - np.uint32(9) <= 4)
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    words, _ = make.numbered([joined.encode().lower().split()])  # of bytes: lowers A-Z, cuts at the six ASCII spaces
    h = make.hashes[words]
    stops = np.sort(np.concatenate((lines, ends[cuts(h, make.final[words], np.searchsorted(lines, ends))])))
    counts = np.bincount(np.searchsorted(stops, ends), minlength=len(stops))
    starts = np.concatenate(([0], stops[:-1]))[: len(stops)]
    row = np.searchsorted(offsets, starts, "right") - 1
    start, end = starts - offsets[row], np.minimum(stops - offsets[row], lengths[row])
    real = end > start  # the rest is our own line ends
    return row[real], start[real], end[real], counts[real], h


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph, in code points, its line end included."""
    _, start, end, *_ = cut_up(Words(1), [text])
    return list(zip(start.tolist(), end.tolist()))


def bands(items: np.ndarray, starts: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Hashes of the bands of MinHash values, a row for each set; sets lie end to end in ``items`` and aren't empty."""
    out = np.empty((len(starts), count), np.uint64)
    for band in range(count):
        total = np.full(len(starts), band + 1, np.uint64)
        for k in range(rows):
            least = np.minimum.reduceat(mixed(items ^ _SEEDS[band * rows + k]), starts)
            total = mixed(total * np.uint64(0xC2B2AE3D27D4EB4F) + least)
        out[:, band] = total
    return out.view(np.int64)


def tokens(items: np.ndarray, starts: np.ndarray, counts: np.ndarray, count: int, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """By what sets are brought together, end to end, and how many each has; sets ascend in ``items``."""
    # sets of a and b >= a shingles share ceil(percent b) of them at least, so that all but so many of the least hold two of these
    most = SMALL if percent > 50 else 0
    two = {s: s - o + 2 for s in range(1, 100 * most // percent + 1) if (o := -(-percent * s // 100)) > 1}
    pairs = {s: p * (p - 1) // 2 for s, p in two.items() if 100 * s // percent > s or -(-percent * s // 100) < s}  # others link with equal sets alone
    sizes = np.zeros(max(two, default=0) + 1, np.int64)
    sizes[list(pairs)] = list(pairs.values())
    small = np.where(counts < len(sizes), sizes[np.minimum(counts, len(sizes) - 1)], 0)
    banded = counts > most
    held = small + banded * count
    at = np.cumsum(held) - held
    out = np.empty(int(held.sum()), np.int64)
    for s in pairs:
        those = np.flatnonzero(counts == s)
        least = items[starts[those][:, None] + np.arange(two[s])]
        i, j = np.triu_indices(two[s], 1)
        out[at[those][:, None] + np.arange(pairs[s])] = mixed(mixed(least[:, i]) * np.uint64(0x9E3779B97F4A7C15) + least[:, j]).view(np.int64)
    if banded.any():
        some = counts[banded]
        out[(at + small)[banded][:, None] + np.arange(count)] = bands(items[np.repeat(banded, counts)], np.cumsum(some) - some, count, rows)
    return out, held


def classes_of(items: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each set, from the sum of its items' hashes and its size."""
    return mixed(np.add.reduceat(mixed(items * np.uint64(0x9E3779B97F4A7C15)), starts) ^ counts.astype(np.uint64)).view(np.int64)


def _pieces(make: Words, batch: list[str | None]):
    """Paragraphs of n words or more: row, start, end, words, sets end to end, their starts and sizes."""
    row, start, end, words, h = cut_up(make, batch)
    enough = words >= make.n
    items, counts = make.sets(h[np.repeat(enough, words)], words[enough])
    return row[enough], start[enough], end[enough], words[enough], items, np.cumsum(counts) - counts, counts


def worker_words(n: int) -> Words:
    """The worker's, with the words it knows."""
    return held(("paragraphs", n), lambda: Words(n))


def signatures(docs: DataFrame, n: int, count: int, rows: int, percent: int) -> DataFrame:
    """A row for each paragraph: doc_id, start, stop, nth (in its document), words, class; bands where a task meets the class first. Documents without any have one row without class."""

    def run(batches):
        make, seen = worker_words(n), np.empty(0, np.int64)
        for part in groups_of(batches):
            at, start, stop, words, items, starts, counts = _pieces(make, part.column(1).to_pylist())
            bare = np.flatnonzero(np.bincount(at, minlength=part.num_rows) == 0)
            key = classes_of(items, starts, counts) if len(at) else np.empty(0, np.int64)
            _, first = np.unique(key, return_index=True)
            new = np.zeros(len(key), bool)
            met = key[first]
            new[first] = np.searchsorted(seen, met, "left") == np.searchsorted(seen, met, "right")
            if len(seen) < 2_000_000:
                seen = np.sort(np.concatenate((seen, key[new])), kind="stable")  # two runs, mostly
            some = counts[new]
            hashed, sizes = tokens(items[np.repeat(new, counts)], np.cumsum(some) - some, some, count, rows, percent)
            each = np.zeros(len(key) + len(bare), np.int64)
            each[np.flatnonzero(new)] = sizes
            offsets = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
            mask = np.concatenate((new, np.zeros(len(bare), bool)))
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed), mask=pa.array(~mask))
            none = pa.nulls(len(bare), pa.int64())
            long = lambda x: pa.concat_arrays([pa.array(x, pa.int64()), none])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate((at, bare)))), long(start), long(stop), long(np.arange(len(at)) - np.searchsorted(at, at)), long(words), long(key), lists], names=["doc_id", "start", "stop", "nth", "words", "class", "bands"])

    return docs.mapInArrow(run, "doc_id long, start long, stop long, nth long, words long, class long, bands array<long>")


def wanted_sets(docs: DataFrame, marked: DataFrame, wanted: DataFrame, n: int, bits: int = 22) -> DataFrame:
    """(class, n, items, map) of the ``wanted`` classes, from documents that have them."""
    one = marked.filter("doc_id is not null").join(wanted, "class", "left_semi").groupBy("class").agg(F.min("doc_id").alias("doc"))
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(one, "doc", bits))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    # classes are hashes already: their own low bits say where they are in a second map
    low = (F.col("class").bitwiseAND(F.lit((1 << bits) - 1))).alias("low")
    places = docs.sparkSession.sparkContext.broadcast(bit_table(wanted.select(low), "low", bits, hashed=False))

    def run(batches):
        make, table = worker_words(n), sent.value

        for batch in batches:
            bucket, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hit = (table[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            for part in groups_of([batch.filter(pa.array(hit.astype(bool)))]):
                *_, items, starts, counts = _pieces(make, part.column(1).to_pylist())
                keys = classes_of(items, starts, counts).tolist() if len(starts) else []
                hit = in_table(places.value, np.array(keys, np.int64) & ((1 << bits) - 1))
                found = {k: items[a : a + c] for k, a, c, h in zip(keys, starts.tolist(), counts.tolist(), hit) if h}
                maps = np.array([parity(mixed(x), 64 * MAP) for x in found.values()], np.uint64).reshape(len(found), MAP)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([len(x) for x in found.values()], pa.int64()), pa.array([x.view(np.int64) for x in found.values()], pa.list_(pa.int64())), *(pa.array(maps[:, k].view(np.int64)) for k in range(MAP))], names=["class", "n", "items", *(f"m{k}" for k in range(MAP))])

    marked_docs = docs.filter("doc_id is not null").select("doc_id", "text", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    found = marked_docs.mapInArrow(run, "class long, n long, items array<long>, " + ", ".join(f"m{k} long" for k in range(MAP)))
    return found.join(wanted, "class", "left_semi").dropDuplicates(["class"])


def in_long_runs(spans: DataFrame, least_words: int) -> DataFrame:
    """Of ``spans`` (doc_id, start, nth, words) those in runs of paragraphs that follow each other, of so many words in all."""
    island = F.col("nth") - F.row_number().over(Window.partitionBy("doc_id").orderBy("nth", "start"))
    total = F.sum("words").over(Window.partitionBy("doc_id", "island"))
    return spans.withColumn("island", island).withColumn("total", total).filter(F.col("total") >= least_words).drop("island", "total")


def dedup(df: DataFrame, n: int = 5, percent: int = 80, count: int = 8, rows: int = 2, least_words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs (of n words or more), n_removed and removed (array of start and stop, code points) of each document.

    ``least_words``: copies are removed where they follow each other with so many words in all; lone short ones stay.
    """
    docs = texts(df, id_col, text_col)
    marked = written(signatures(docs, n, count, rows, percent), "paragraphs")
    posts = marked.filter("doc_id is not null and bands is not null").select("class", F.explode("bands").alias("token"))
    shared = posts.groupBy("token").agg(F.min("class").alias("first"), F.max("class").alias("last")).filter("first <> last").select("token", "first")
    met = written(posts.join(shared, "token").distinct(), "postings")
    pairs = written(met.filter("class <> first").select(F.col("first").alias("a"), F.col("class").alias("b")).distinct(), "pairs")
    sets = written(wanted_sets(docs, marked, met.select("class").distinct(), n), "sets")
    items = sets.select("class", "items")
    stars = written(verified(pairs, items, percent), "stars")
    label = stars.select(F.col("b").alias("class"), "a").groupBy("class").agg(F.min("a").alias("a"))
    labelled = sets.drop("items").join(label, "class", "left").withColumn("label", F.least("class", "a")).drop("a")
    rest = written(open_pairs(met.filter("class <> first").select("token", "class").join(labelled, "class"), percent), "pairs")
    found = stars.union(verified(rest, items, percent))
    roots = components(found)

    full = marked.filter("class is not null and doc_id is not null").select("doc_id", "start", "stop", "nth", "words", "class")
    # only classes that occur twice or are linked can have copies; most are neither and stay out of the joins
    many = full.groupBy("class").count().filter("count > 1").select("class")
    some = many.join(roots.withColumnRenamed("node", "class"), "class", "full").select("class", F.coalesce("root", "class").alias("root"))
    named = written(full.join(some, "class").drop("class").distinct(), "repeated")
    place = F.struct("doc_id", "start")
    first = named.groupBy("root").agg(F.min(place).alias("kept"))
    copies = named.join(first, "root").filter(place != F.col("kept"))
    gone = (in_long_runs(copies, least_words) if least_words else copies).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    counts = marked.groupBy("doc_id").agg(F.count("class").alias("n_paragraphs"))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    return counts.join(gone, "doc_id", "left").select("doc_id", "n_paragraphs", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))


def clean(df: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their ``removed`` stretches (result of ``dedup``) cut out of the text; all columns stay."""
    spans = removed.filter("n_removed > 0 and doc_id is not null").select(F.col("doc_id").alias("_of"), F.col("removed").alias("_cut"))
    both = df.join(spans, df[id_col] == spans["_of"], "left")
    edges = F.concat(F.transform("_cut", lambda x: x["stop"]))
    starts = F.concat(F.array(F.lit(0).cast("long")), edges)
    stops = F.concat(F.transform("_cut", lambda x: x["start"]), F.array(F.length(text_col).cast("long")))
    kept = F.concat_ws("", F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.substring(F.col(text_col), (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int"))))
    return both.withColumn(text_col, F.when(F.col("_cut").isNull(), F.col(text_col)).otherwise(kept)).select(*df.columns)
