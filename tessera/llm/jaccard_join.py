"""N-gram Jaccard join: a grouped prefix join over word shingles.

A document is the set of its distinct n-word shingles (64-bit hashes). Shingles have one global order: rare ones first, by a
count sketch over all documents, then by hash. Two sets can only reach the threshold if their prefixes (the first
n - ceil(t n) + 1 shingles of n) share a shingle. So:

1. Documents with equal sets are one class; classes with the same size and prefix are one group. Groups post their prefixes.
2. Each shingle names one representative, the member whose shingles are the most common ones (of a group of near copies, the
   text they are copies of). Members are verified against representatives: a number of pairs in proportion to the postings.
3. What a shingle's members still differ in (labels by the links so far) is paired up, if sizes fit and a bitmap bound does:
   the bits in which two parity maps differ never exceed the sets' difference. The bound is checked inside the join, as is
   that the pair wasn't met under an earlier shingle; pairs that pass are verified. No pair is left out that could link.
4. Classes linked by verified pairs form components.

Memory: postings, pairs and sets are only ever shuffled on their keys; a hot key's rows are pre-aggregated or joined in plain
equi joins. The sketch has a fixed number of counters, the filter of wanted documents a fixed number of bits.

Defined results: a null or empty text, or one without words, has no shingles and links with nothing (its component is its own
doc_id); a text of fewer words than n has its whole sequence as its shingle; rows with a null id stay with a null component
and link nothing; rows that repeat a doc_id stay, each judged by its own text; an empty table gives no rows.
Classes are known by 64-bit hashes of their sets and sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, groups_of, held, parted, texts, written
from tessera.llm.components import components

CACHE_WORDS = 120_000
#: Longs of the parity map.
MAP = 8
#: Sets of more shingles have a map of WIDE longs besides, as the small one's bits are soon all used.
LONG, WIDE = 1500, 128
#: Earlier shingles by which a pair is known to have been met already.
EARLIER = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[3]
    return x ^ (x >> np.uint64(29))


def parity(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Map of ``bits`` (a power of two) bits, each flipped by every hash that falls on it."""
    flips = np.bincount((hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view("<u8")


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, n: int):
        self.n = n
        self.forget()

    def forget(self) -> None:
        self.known, self.hashes = Numbers(), np.empty(0, np.uint64)

    def flat(self, batch: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of all texts end to end (ascending in each), how many each text has, and its number of words."""
        words, sizes = self.numbered([t.encode().lower().split() if t else [] for t in batch])  # of bytes: lowers A-Z, cuts at the six ASCII spaces
        return *self.sets(self.hashes[words], sizes), sizes

    def numbered(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, end to end, at which ``hashes`` has their hashes, and how many words each text has."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        words, sizes = self.known.of(split)
        self.learn(self.known.take())
        return words, sizes

    def learn(self, new: list[bytes]) -> None:
        self.hashes = np.concatenate((self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))))

    def sets(self, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of texts of so many words, whose hashes are ``h``, and how many each text has."""
        n, ends = self.n, np.cumsum(sizes)
        whole = np.flatnonzero(np.arange(len(h)) + n <= np.repeat(ends, sizes))
        parts, of = [self._rolled(h, whole, n)], [np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, 0))]
        for size in range(1, n):  # texts of fewer words are one shingle
            short = np.flatnonzero(sizes == size)
            parts.append(self._rolled(h, (ends - sizes)[short], size))
            of.append(short)
        found, text = np.concatenate(parts), np.concatenate(of)
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        keep = np.ones(len(found), bool)
        keep[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
        return found[keep], np.bincount(text[keep], minlength=len(sizes))

    @staticmethod
    def _rolled(h: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        total = np.full(len(starts), size, np.uint64)
        for k in range(size):
            total = mixed(total * _MIX[1] + h[starts + k])
        return total

    def __call__(self, batch: list[str | None]) -> list[np.ndarray]:
        found, counts, _ = self.flat(batch)
        return parted(found, counts)


def shingler(n: int) -> Shingler:
    """The worker's, with the words it knows."""
    return held(("shingler", n), lambda: Shingler(n))


def packed(at: np.ndarray) -> bytes:
    """Ascending numbers as gaps of a byte each; a gap of 255 or more takes bytes of 255 first."""
    gaps = np.diff(at, prepend=0)
    full = gaps // 255
    out = np.full(len(at) + int(full.sum()), 255, np.uint8)
    out[np.cumsum(full + 1) - 1] = gaps % 255
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    gaps = np.frombuffer(data, np.uint8).astype(np.int64)
    return np.cumsum(gaps)[gaps < 255]


def sketch(docs: DataFrame, n: int, bits: int, salts: int = 4, slices: int = 16) -> np.ndarray:
    """About how many documents have a shingle of each of 2**bits buckets, as log2, from all documents.

    Tasks count their own documents (at most 255 a bucket) and send slices, the buckets as gaps; sums of slices stream
    through a few tasks, in two levels so that no task sees more than a salt's share.
    """
    step = (1 << bits) // slices

    def sent(i, at, counts):
        return pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "salt": pa.array([int(at[:64].sum())], pa.int64()), "gaps": pa.array([packed(at)], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    def run(batches):
        make, total = shingler(n), np.zeros(1 << bits, np.uint8)
        for part in groups_of(batches):
            at, count = np.unique(np.concatenate([np.empty(0, np.uint64), *make(part.column(1).to_pylist())]) >> np.uint64(64 - bits), return_counts=True)
            at = at.astype(np.int64)
            total[at] = np.minimum(total[at] + count, 255)
        for i in range(slices):
            at = np.flatnonzero(total[i * step : (i + 1) * step])
            if len(at):
                yield sent(i, at, total[i * step + at])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, gaps, counts in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                own = total.setdefault(i, np.zeros(step, np.uint32))
                own[unpacked(gaps)] += np.frombuffer(counts, np.uint8)
        return total

    def first(batches):
        for i, own in summed(batches).items():
            at = np.flatnonzero(own)
            yield sent(i, at, np.minimum(own[at], 255).astype(np.uint8))

    def last(batches):
        for i, own in summed(batches).items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "levels": pa.array([np.ceil(np.log2(own + 1.0)).astype(np.uint8).tobytes()], pa.binary())})

    schema = "slice int, salt long, gaps binary, counts binary"
    own = docs.mapInArrow(run, schema).repartition(slices * salts, "slice", F.col("salt") % salts).mapInArrow(first, schema)
    level = np.zeros(1 << bits, np.uint8)
    for r in own.repartition(slices, "slice").mapInArrow(last, "slice int, levels binary").collect():  # a byte a bucket
        level[r["slice"] * step : (r["slice"] + 1) * step] = np.frombuffer(r["levels"], np.uint8)
    return level


def signatures(docs: DataFrame, n: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, and for sets that aren't empty: class and group hashes, a representative's rank, parity map, prefix."""
    bits = int(len(levels)).bit_length() - 1
    sent = docs.sparkSession.sparkContext.broadcast(levels)  # 2**bits bytes

    def run(batches):
        make, level = shingler(n), sent.value
        for part in groups_of(batches):
            rows: dict[str, list] = {k: [] for k in ("n", "class", "grp", "rank", "prefix", "wide")}
            maps = np.zeros((part.num_rows, MAP), np.uint64)
            for i, s in enumerate(make(part.column(1).to_pylist())):
                size = len(s)
                rows["n"].append(size)
                if not size:
                    for k in ("class", "grp", "rank", "prefix", "wide"):
                        rows[k].append(None)
                    continue
                mine = level[(s >> np.uint64(64 - bits)).astype(np.int64)]
                own = mixed(s)
                prefix = s[np.lexsort((own, mine))[: size - (percent * size + 99) // 100 + 1]]
                maps[i] = parity(own, 64 * MAP)
                rows["wide"].append(parity(own, 64 * WIDE).view(np.int64) if size > LONG else None)
                key = xxhash.xxh3_64_intdigest(s.tobytes(), seed=size)
                rows["class"].append(key - (1 << 63))
                rows["grp"].append(xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=size) - (1 << 63))
                rows["rank"].append((int(mine.mean() * 4) << 55) | (key >> 9))  # 24 levels at most
                rows["prefix"].append(prefix.view(np.int64))
            kinds = {"n": pa.int64(), "class": pa.int64(), "grp": pa.int64(), "rank": pa.int64(), "prefix": pa.list_(pa.int64()), "wide": pa.list_(pa.int64())}
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(rows[k], t) for k, t in kinds.items()), *(pa.array(maps[:, k].view(np.int64)) for k in range(MAP))], names=["doc_id", *kinds, *(f"m{k}" for k in range(MAP))])

    return docs.mapInArrow(run, "doc_id long, n long, class long, grp long, rank long, prefix array<long>, wide array<long>, " + ", ".join(f"m{k} long" for k in range(MAP)))


def bit_table(ids: DataFrame, column: str, bits: int, hashed: bool = True) -> np.ndarray:
    """Map of 2**bits bits, those of the hashed values (or of values that are small numbers) set; its size doesn't depend on the input."""
    place = F.pmod(F.xxhash64(column), F.lit(1 << bits)) if hashed else F.col(column)
    rows = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("map"))
    table = np.zeros(((1 << bits) // 32768 + 1, 4096), np.uint8)
    for r in rows.collect():
        table[r["bucket"]] = np.frombuffer(bytes(r["map"]), np.uint8)
    return table


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which small numbers are set; buckets count from 1, as in the functions that made the map."""
    bucket, bit = np.where(values > 0, 1 + (values - 1) // 32768, 0), np.where(values > 0, (values - 1) % 32768, 0)
    return (table[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0


def wanted_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, n: int, bits: int = 22) -> DataFrame:
    """(class, items array<long>): the shingle sets of the ``wanted`` classes, from their least documents' texts.

    A bit map of 2**bits hashed ids lets tasks skip other documents before they are cut up; what it lets through by chance
    goes in the join.
    """
    ids = classes.join(wanted.distinct(), "class", "left_semi").select("class", "doc")
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(ids, "doc", bits))
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    marked = docs.select("doc_id", "text", F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).filter("doc_id is not null")

    def run(batches):
        make, table = shingler(n), sent.value
        for batch in batches:
            bucket, bit = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hit = (table[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1
            for part in groups_of([batch.filter(pa.array(hit.astype(bool)))]):
                sets = make(part.column(1).to_pylist())
                keys = [xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["class", "doc", "items"])

    found = marked.mapInArrow(run, "class long, doc long, items array<long>").filter("class is not null")
    return found.join(ids, ["class", "doc"], "left_semi").dropDuplicates(["class"]).select("class", "items")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold."""
    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("items").alias("left_items")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("items").alias("right_items")), "b")
    common = F.size(F.array_intersect("left_items", "right_items")).cast("long")
    return both.select("a", "b", common.alias("common"), (F.size("left_items") + F.size("right_items") - common).alias("all")).filter(100 * F.col("common") >= percent * F.col("all")).select("a", "b", "common")


def close_enough(x: str, y: str, percent: int):
    """Whether two classes' sizes and parity maps leave room for the threshold."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.m{k}").bitwiseXOR(F.col(f"{y}.m{k}"))) for k in range(MAP)), F.lit(0))
    fits = (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * differ <= (100 - percent) * (n + m))
    return fits


def still_close(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) without those of long sets whose wide maps differ too much."""
    left = wide.select(F.col("class").alias("a"), F.col("n").alias("an"), F.col("wide").alias("aw"))
    right = wide.select(F.col("class").alias("b"), F.col("n").alias("bn"), F.col("wide").alias("bw"))
    differ = F.aggregate(F.zip_with("aw", "bw", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.filter(F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("an") + F.col("bn")), F.lit(True))).select("a", "b")


def open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of classes that share a token, have different labels and may reach the threshold. ``rows``: token, class, label, n, map.

    Tokens whose classes all have one label are done with; a pair comes up once or a few times, under the first tokens it shares.
    """
    maps = [f"m{k}" for k in range(MAP)]
    undone = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token")
    before = Window.partitionBy("class").orderBy("token").rowsBetween(-EARLIER, -1)
    left = written(rows.join(undone, "token", "left_semi").select("token", "class", "label", "n", *maps, F.collect_list("token").over(before).alias("earlier")), "open")
    x, y = left.alias("x"), left.alias("y")
    fits = (F.col("x.class") < F.col("y.class")) & (F.col("x.label") != F.col("y.label")) & close_enough("x", "y", percent) & ~F.arrays_overlap("x.earlier", "y.earlier")
    return x.join(y, (F.col("x.token") == F.col("y.token")) & fits).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()


def links(df: DataFrame, n: int = 5, percent: int = 80, sketch_bits: int = 26, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their classes, verified links between classes); the links connect all that similar pairs connect."""
    docs = texts(df, id_col, text_col)
    size = docs.select(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    levels = sketch(docs, n, max(12, min(sketch_bits, int(size // 64).bit_length())), salts=4 + size // (64 << 30))
    marked = written(signatures(docs, n, percent, levels), "signatures")
    maps = [f"m{k}" for k in range(MAP)]
    full = marked.filter("class is not null and doc_id is not null")
    classes = written(full.groupBy("class", "grp", "n", "rank", *maps).agg(F.min("doc_id").alias("doc")), "classes")
    groups = classes.groupBy("grp").agg(F.count("*").alias("members"), F.max("rank").alias("rank"))
    heads = full.select("grp", "prefix").dropDuplicates(["grp"])
    posted = groups.join(heads, "grp").select("grp", "members", "rank", F.explode("prefix").alias("token"))
    shared = posted.groupBy("token").agg(F.sum("members").alias("m"), F.max("rank").alias("first")).filter("m > 1")
    # a row for each group and shingle that something else has
    rows = written(posted.select("grp", "token").join(shared, "token"), "postings")

    seen = rows.select("grp", "first").distinct().join(classes, "grp").alias("x")
    near = seen.join(classes.select(F.col("rank").alias("first"), *(F.col(c).alias(c) for c in ("class", "n", *maps))).alias("y"), F.col("x.first") == F.col("y.first"))
    wide = written(full.filter("wide is not null").groupBy("class", "n").agg(F.any_value("wide").alias("wide")), "wide")
    starred = near.filter((F.col("x.class") != F.col("y.class")) & close_enough("x", "y", percent)).select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    starred = written(still_close(starred, wide, percent), "pairs")
    sets = written(wanted_sets(docs, classes, starred.select(F.col("a").alias("class")).union(starred.select("b")), n), "sets")
    stars = written(verified(starred, sets, percent), "stars")

    label = stars.select(F.col("a").alias("class"), "b").union(stars.select("b", "a")).groupBy("class").agg(F.min("b").alias("b"))
    labelled = classes.join(label, "class", "left").select("class", "grp", "n", "rank", *maps, F.least("class", "b").alias("label"))
    open_rows = rows.filter("m > 2").select("token", "grp", "first").join(labelled, "grp").filter("rank <> first")
    rest = written(still_close(open_pairs(open_rows, percent), wide, percent), "pairs")
    if rest.isEmpty():
        return marked, stars
    more = rest.select(F.col("a").alias("class")).union(rest.select("b")).distinct().join(sets, "class", "left_anti")
    both = sets.union(wanted_sets(docs, classes, more, n))
    return marked, stars.union(written(verified(rest, both, percent), "links"))


def join(df: DataFrame, n: int = 5, percent: int = 80, sketch_bits: int = 26, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to) of each row."""
    marked, found = links(df, n, percent, sketch_bits, id_col, text_col)
    roots = components(found)
    named = marked.select("doc_id", "n", "class").join(roots.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", F.coalesce("root", "class").alias("root"))
    least = named.filter("doc_id is not null and root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("held")).filter("held > 1")
    return named.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
