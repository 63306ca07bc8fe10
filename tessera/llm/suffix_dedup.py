"""Suffix-array dedup by bucket-pointer refinement: bytes of long strings that an earlier document has too are removed.

Suffixes only matter to a depth of ``length`` bytes. They are sorted by bucket-pointer refinement: buckets of equal q-grams
come first; each bucket is refined by sorting on the bucket identifiers of later offsets, and refined identifiers are used
for the next, deeper round; suffixes alone in their bucket drop out. Three steps bring only suffixes that can repeat to a
task, and those with equal strings to the same one:

1. Anchors. Each string of ``length`` bytes has its least k-gram (by hash, the first of equal ones), so equal strings have
   equal anchors. Short grams repeat by chance, the more the larger the input; so an anchor has two sides: strings that reach
   at least half of what is beside the gram to its left hold the same longer context (33 of 50 bytes), the other ones a
   context to its right (34 bytes). Blocks of documents send the contexts' 32-bit hashes, in blobs by set, and get back one of
   three marks for each: in one document only, in several, in very many.
2. Segments. The bytes around an anchor that hold the strings of its marked sides go to the anchor's bucket; equal segments
   of a block go once, with their least document. Of contexts in very many documents, each string goes on its own to a bucket
   of its own hash, so that no bucket gathers what follows or precedes a common line. Which side a string is on depends on its
   bytes alone, so equal strings meet.
3. Refinement in each bucket finds, for each segment's first document, which strings an earlier document has; its copies in
   later documents are covered whole. Covered stretches go back to the blocks, which cut them out.

All three steps deal documents to the same blocks by a hash of doc_id, so their exchange can be used again. Hashes only
bring candidates together: what is removed has been compared byte by byte.

Defined results: a null text is empty; texts under ``length`` bytes stay; rows with a null id stay whole and remove nothing;
rows that repeat a doc_id don't remove from each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held, texts, trim

#: Bytes of an anchor; hash base (odd, so it has an inverse modulo 2**64).
GRAM = 16
BASE = 0x9E3779B97F4A7C15
#: Bytes of text in a block, anchors in a bucket and in a set of contexts, on average.
BLOCK_BYTES = 4 << 20
BUCKET_ANCHORS = 1 << 18
SET_ANCHORS = 1 << 20
#: Bits of a place in the bytes worked on at once.
PLACE_BITS = 30
#: Strings of one segment at most; only runs of one repeated gram have more.
SEGMENT = 1024
#: Documents from which a context's strings are dealt one by one.
MANY = 2000
#: Bytes worked on at once in a block.
CHUNK = 1 << 20


def grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-gram of ``b``."""
    power, size, mul = {1: b.astype(np.uint64) + np.uint64(1)}, 1, {1: BASE}
    while size * 2 <= k:
        x = power[size]
        power[2 * size] = x[:-size] * np.uint64(mul[size]) + x[size:]
        mul[2 * size] = mul[size] * mul[size] % (1 << 64)
        size *= 2
    total, at, n = None, 0, len(b) - k + 1
    for size in sorted(power, reverse=True):
        if k - at >= size:
            part = power[size][at : at + n]
            total = part if total is None else total * np.uint64(mul[size]) + part
            at += size
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return total ^ (total >> np.uint64(29))


def slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (minimum or maximum) over each window of ``width``."""
    size = 1
    while size * 2 <= width:
        x, size = f(x[:-size], x[size:]), size * 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def context(h: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place ``at``, from the hashes of all grams."""
    total = np.full(len(at), seed, np.uint64)
    for o in (*range(0, size - GRAM, GRAM), size - GRAM):
        total = (total ^ h[at + o]) * np.uint64(0xC2B2AE3D27D4EB4F)
        total ^= total >> np.uint64(29)
    return total


class Anchors(NamedTuple):
    """Each anchor's hash, first and last start of the strings it is the least gram of, last start on its left side, contexts."""

    hash: np.ndarray
    first: np.ndarray
    last: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, at: np.ndarray) -> Anchors:
        return Anchors(*(x[at] for x in self))

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether strings are on the left and on the right side."""
        return self.split >= self.first, self.split < self.last


_NONE = Anchors(np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))


def anchors(b: np.ndarray, ends: np.ndarray, length: int) -> Anchors:
    """Anchors of the joined texts ``b``."""
    width = length - GRAM + 1
    if len(b) < length:
        return _NONE
    h = grams(b, GRAM)
    place = np.uint64((1 << PLACE_BITS) - 1)
    low = slide(h & ~place | np.arange(len(h), dtype=np.uint64), width, np.minimum)
    valid = np.repeat(ends, np.diff(ends, prepend=0))[: len(low)] >= np.arange(len(low)) + length
    starts = np.flatnonzero(valid)
    if not len(starts):
        return _NONE
    at = (low[starts] & place).astype(np.int64)
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = starts[np.concatenate(([0], change))], starts[np.concatenate((change - 1, [len(starts) - 1]))]
    at = at[np.concatenate(([0], change))]
    half = (width - 1) // 2
    split = np.clip(at - half, first - 1, last)
    found = Anchors(h[at], first, last, split, np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64))
    on_left, on_right = found.sides()
    found.left[on_left] = context(h, at[on_left] - half, GRAM + half, 1)
    found.right[on_right] = context(h, at[on_right], length - half + 1, 2)
    # a repeated gram has one anchor after the other with the same context: they are one, in pieces
    more = (found.right[1:] == found.right[:-1]) & ~on_left[1:] & ~on_left[:-1] & (found.hash[1:] == found.hash[:-1]) & (first[1:] == last[:-1] + 1)
    if more.any():
        lead = np.flatnonzero(np.concatenate(([True], ~more)))
        last = last[np.append(lead[1:], len(last)) - 1]
        found = found.take(lead)
        pieces = (last - found.first) // SEGMENT + 1
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        found, last = found.take(np.repeat(np.arange(len(lead)), pieces)), np.repeat(last, pieces)
        first = found.first + nth * SEGMENT
        last = np.minimum(last, first + SEGMENT - 1)
        found = found._replace(first=first, last=last, split=np.where(found.split < found.first, first - 1, found.split))
    return found


class Block:
    """The documents of a block in a fixed order, and its anchors chunk by chunk."""

    def __init__(self, table: pa.Table, length: int):
        held(("blocks",), dict)  # whatever another operator holds goes
        trim()
        table = table.filter(pc.is_valid(table.column("doc_id"))).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids = table.column("doc_id").to_numpy()
        self.texts = [(t or "").encode() for t in table.column("text").to_pylist()]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.length = length

    def chunks(self):
        """(bytes, row of each document, its start and end in the bytes) of documents that are long enough, about CHUNK bytes each."""
        rows, total = [], 0
        for i in np.flatnonzero(self.sizes >= self.length).tolist():
            if total and total + self.sizes[i] > CHUNK:
                yield self._chunk(rows)
                rows, total = [], 0
            rows.append(i)
            total += int(self.sizes[i])
        if rows:
            yield self._chunk(rows)

    def _chunk(self, rows):
        ends = np.cumsum(self.sizes[rows])
        return np.frombuffer(b"".join([self.texts[i] for i in rows]), np.uint8), np.array(rows), ends

    def anchors(self):
        """Of each chunk: bytes, anchors, their row, offset of the row's text."""
        for b, rows, ends in self.chunks():
            found = anchors(b, ends, self.length)
            at = np.searchsorted(ends, found.first, side="right")
            yield b, found, rows[at], (ends - self.sizes[rows])[at]


def keys_of(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit hash in it of an anchor or context."""
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def codes_of(h: np.ndarray, sets: int) -> np.ndarray:
    """Set and 32-bit hash in it of a context, in one number."""
    of, key = keys_of(h, sets)
    return of << 32 | key


def block_contexts(block: Block, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the block's distinct contexts, in order, and documents that have each (255 at most)."""
    codes, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, found, row, _ in block.anchors():
        for h, there in zip((found.left, found.right), found.sides()):
            codes.append(codes_of(h[there], sets))
            rows.append(row[there])
    code, doc = np.concatenate(codes), block.ids[np.concatenate(rows)]
    order = np.lexsort((doc, code))
    code, doc = code[order], doc[order]
    new = np.concatenate((np.ones(min(1, len(code)), bool), (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))
    code = code[new]
    starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(code)), bool), code[1:] != code[:-1])))
    return code[starts], np.minimum(np.diff(np.append(starts, len(code))), 255)


def packed(keys: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as the gaps between them, first bytes first, which the shuffle's compression makes small."""
    return np.diff(keys, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4")[:, 0], dtype=np.int64)


def refine(bucket: np.ndarray, step: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: suffixes at ``starts`` that aren't alone, in new buckets by (own bucket, bucket ``step`` later)."""
    a, b = bucket[starts], bucket[starts + step]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    name = np.cumsum(new)
    count = np.bincount(name)
    refined = np.zeros(len(bucket), np.int64)
    refined[starts[order]] = name
    keep = np.sort(starts[order][count[name] > 1])
    return refined, keep


def equal_strings(b: np.ndarray, starts: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket-pointer refinement to depth ``length`` of the suffixes at ``starts`` of ``b``: (starts not alone, their buckets)."""
    alive = starts
    offsets = np.unique(np.concatenate([starts + o for o in _offsets(length, q)]))
    h = grams(b, q)
    _, name = np.unique(h[offsets], return_inverse=True)
    bucket = np.zeros(len(b) + 1, np.int64)
    bucket[offsets] = name + 1
    count = np.bincount(name)
    alone = np.zeros(len(b) + 1, bool)
    alone[offsets] = count[name] == 1
    depth = q
    while depth < length and len(alive):
        step = min(depth, length - depth)
        rest = [o for o in _offsets(length, depth + step)]
        need = np.unique(np.concatenate([alive + o for o in rest]))
        need = need[~alone[need] & ~alone[need + step]]
        if not len(need):
            return need, need
        refined, keep = refine(bucket, step, need)
        alone[:] = True
        alone[keep] = False
        bucket = refined
        alive = alive[~alone[alive]]
        depth += step
    return alive, bucket[alive]


def _offsets(length: int, depth: int) -> list[int]:
    """Offsets whose buckets of ``depth`` bytes, in rounds that double it, make up ``length`` bytes."""
    if depth >= length:
        return [0]
    step = min(depth, length - depth)
    above = _offsets(length, depth + step)
    return sorted({o + s for o in above for s in (0, step)})


def dedup(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept binary) of each row."""
    docs = texts(df, id_col, text_col)
    size = int(docs.select(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0)
    blocks, buckets, sets = max(8, size // BLOCK_BYTES), max(4, size // 16 // BUCKET_ANCHORS), max(4, size // 16 // SET_ANCHORS)
    q = (length + 1) // 2
    dealt = docs.select(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def post(table):
        return _post(table, length, sets)

    def segments(docs_of, marks_of):
        if not docs_of.num_rows or not marks_of.num_rows:
            return _SEGMENTS.empty_table()
        return _segments(docs_of, marks_of, buckets, sets, length)

    def cover(table):
        return _cover(table, length, q)

    def cut(docs_of, spans_of):
        return _cut(docs_of, spans_of, length, with_text)

    posted = dealt.groupBy("block").applyInArrow(post, "block int, part int, keys binary, docs_with binary")
    marked = posted.groupBy("part").applyInArrow(_mark, "block int, part int, marks binary")
    sent = dealt.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(segments, "block int, bucket int, row binary, start binary, size binary, doc binary, key binary, bytes binary")
    covered = sent.groupBy("bucket").applyInArrow(cover, "block int, row binary, start binary, size binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return dealt.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(cut, schema)


_SEGMENTS = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("row", "start", "size", "doc", "key", "bytes"))])


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of BASE and of its inverse, kept for later."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            grown = np.full(n + 1 + (n >> 3), base, np.uint64)
            grown[0] = 1
            _powers[k] = np.cumprod(grown)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def rows_at(b: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes from each start, a row each."""
    return np.lib.stride_tricks.sliding_window_view(b, width)[starts]


def _distinct(b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each distinct string, number of each string's); equal hashes are compared byte by byte."""
    power, inverse = powers(len(b))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:-1])))
    h = (total[start + size] - total[start]) * inverse[start]
    h = (h ^ (h >> np.uint64(32)) ^ size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    width = int(size.max()) if len(size) else 0
    padded = np.concatenate((b, np.zeros(width, np.uint8)))
    other = np.flatnonzero(np.arange(len(start)) != first[number])
    for part in np.array_split(other, max(1, len(other) * width >> 24)):
        of = first[number[part]]
        same = (size[part] == size[of]) & ((rows_at(padded, start[part], width) == rows_at(padded, start[of], width)) | (np.arange(width) >= size[part][:, None])).all(1)
        for i in part[~same].tolist():  # equal hash, other bytes: on its own
            number[i] = len(first)
            first = np.append(first, i)
    return first, number


def _post(table: pa.Table, length: int, sets: int) -> pa.Table:
    """The contexts of a block, a row for each set."""
    code, docs_with = block_contexts(Block(table, length), sets)
    cuts = np.flatnonzero(np.diff(code >> 32)) + 1
    parts = [(c, d) for c, d in zip(np.split(code, cuts), np.split(docs_with, cuts)) if len(c)]
    return pa.table({
        "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int32()),
        "part": pa.array([int(c[0] >> 32) for c, _ in parts], pa.int32()),
        "keys": pa.array([packed(c & 0xFFFFFFFF) for c, _ in parts], pa.binary()),
        "docs_with": pa.array([d.astype(np.uint8).tobytes() for _, d in parts], pa.binary()),
    })


def _mark(table: pa.Table) -> pa.Table:
    """Marks of a set's contexts, in the order of each block."""
    keys = [unpacked(x) for x in table.column("keys").to_pylist()]
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("docs_with").to_pylist()])
    _, inverse = np.unique(np.concatenate(keys).astype(np.uint32), return_inverse=True)
    total = np.bincount(inverse, weights=count)[inverse]
    marks = np.where(total >= MANY, 2, total >= 2).astype(np.uint8)
    return pa.table({"block": table.column("block"), "part": table.column("part"), "marks": pa.array([m.tobytes() for m in np.split(marks, np.cumsum([len(k) for k in keys])[:-1])], pa.binary())})


def _places(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, place) of each place from ``first`` to ``last``."""
    count = last - first + 1
    of = np.repeat(np.arange(len(first)), count)
    return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _segments(docs_of: pa.Table, marks_of: pa.Table, buckets: int, sets: int, length: int) -> pa.Table:
    """Segments and single strings of a block that may repeat, a row for each bucket."""
    block, name = Block(docs_of, length), docs_of.column("block")[0].as_py()
    code, _ = block_contexts(block, sets)
    mark = np.concatenate([np.frombuffer(x, np.uint8) for x in marks_of.sort_by("part").column("marks").to_pylist()])
    out: dict[str, list] = {k: [] for k in _SEGMENTS.names}

    def send(bucket, row, start, size, doc, key, flat):
        for k, v in zip(_SEGMENTS.names, (name, bucket, row.astype("<u4").tobytes(), start.astype("<u4").tobytes(), size.astype("<u2").tobytes(), doc.astype("<i8").tobytes(), key.astype("<u4").tobytes(), pa.compress(flat.tobytes(), "zstd", asbytes=True) if len(flat) else b"")):
            out[k].append(v)

    def marks(h, there):
        kind = np.zeros(len(h), np.uint8)
        kind[there] = mark[np.searchsorted(code, codes_of(h[there], sets))]
        return kind

    held: list[tuple] = []
    texts_of: list[np.ndarray] = []
    base = 0
    for b, found, row, offset in block.anchors():
        bucket, key = keys_of(found.hash, buckets)
        left, right = (marks(h, there) for h, there in zip((found.left, found.right), found.sides()))
        one = np.flatnonzero((left == 1) | (right == 1))
        begin, end = np.where(left == 1, found.first, found.split + 1)[one], np.where(right == 1, found.last, found.split)[one]
        each = np.concatenate((np.flatnonzero(left == 2), np.flatnonzero(right == 2)))
        among, place = _places(np.concatenate((found.first[left == 2], found.split[right == 2] + 1)), np.concatenate((found.split[left == 2], found.last[right == 2])))
        start = np.concatenate((begin, place))
        size = np.concatenate((end - begin + length, np.full(len(place), length)))
        of = np.concatenate((one, each[among]))
        held.append((start + base, size, row[of], start - offset[of], bucket[of], np.concatenate((np.maximum(key[one], 1), np.zeros(len(place), np.uint32)))))
        texts_of.append(b)
        base += len(b)
    if not held:
        return _SEGMENTS.empty_table()
    b = np.concatenate(texts_of)
    start, size, row, inside, bucket, key = (np.concatenate(x) for x in zip(*held))
    single = key == 0
    if not len(start):
        return _SEGMENTS.empty_table()
    _, number = _distinct(b, start, size)
    # strings of very common anchors go by their own bytes
    own = np.zeros(len(start), np.int64)
    if single.any():
        own[single] = ((grams(b, length)[start[single]] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    bucket = np.where(single, own, bucket)
    # of equal segments the least document's goes on; the others, in later documents, are covered here
    doc = block.ids[row]
    order = np.lexsort((inside, row, doc, number))
    lead = np.concatenate(([True], number[order][1:] != number[order][:-1]))
    least = doc[order][lead][np.cumsum(lead) - 1]
    later = order[doc[order] > least]
    same = order[(doc[order] == least)]
    if len(later):
        send(0, row[later], inside[later], size[later], np.full(len(later), -1), key[later], np.empty(0, np.uint8))
    same = same[np.argsort(bucket[same], kind="stable")]
    for part in np.split(same, np.flatnonzero(np.diff(bucket[same])) + 1):
        total = int(size[part].sum())
        flat = b[np.repeat(start[part] - (np.cumsum(size[part]) - size[part]), size[part]) + np.arange(total)]
        send(int(bucket[part[0]]), row[part], inside[part], size[part], doc[part], key[part], flat)
    if len(later):
        # their bucket only passes them on
        out["bucket"][0] = name % buckets
    return pa.table({f.name: pa.array(out[f.name], f.type) for f in _SEGMENTS})


_SPANS = pa.schema([("block", pa.int32()), ("row", pa.binary()), ("start", pa.binary()), ("size", pa.binary())])


def _cover(table: pa.Table, length: int, q: int) -> pa.Table:
    """Stretches of each block's documents whose strings an earlier document has."""
    trim()
    parts = {k: [np.frombuffer(x, t) for x in table.column(k).to_pylist()] for k, t in (("row", "<u4"), ("start", "<u4"), ("size", "<u2"), ("doc", "<i8"), ("key", "<u4"), ("bytes", np.uint8))}
    counts = [len(x) for x in parts["row"]]
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), counts)
    row, start, size, doc, key = (np.concatenate(parts[k]).astype(np.int64) for k in ("row", "start", "size", "doc", "key"))
    ready = np.repeat([len(x) == 0 for x in parts["bytes"]], counts)
    found = [(block[ready], row[ready], start[ready], size[ready])]
    block, row, start, size, doc, key = (x[~ready] for x in (block, row, start, size, doc, key))
    if len(row):
        b = np.concatenate([np.frombuffer(pa.decompress(x.tobytes(), int(z.sum(dtype=np.int64)), "zstd", asbytes=True), np.uint8) for x, z in zip(parts["bytes"], parts["size"]) if len(x)])
        at = np.cumsum(size) - size
        first, number = _distinct(b, at, size)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, number, doc)
        later = doc > least[number]
        found.append((block[later], row[later], start[later], size[later]))
        # one segment for each distinct string of bytes, its strings against all others' of the anchor; where an anchor has
        # but one segment, or its strings came one by one, equal bytes are all there is
        _, anchor, segments = np.unique(key[first], return_inverse=True, return_counts=True)
        open_ones = np.flatnonzero((key[first] > 0) & (segments[anchor] > 1))
        count = size[first][open_ones] - length + 1
        ends = np.cumsum(count)
        of = np.repeat(open_ones, count)
        step = np.arange(count.sum()) - np.repeat(ends - count, count)
        position = at[first][of] + step
        order = np.argsort(position, kind="stable")
        position, of, step = position[order], of[order], step[order]
        alive, bucket = equal_strings(b, position, length, q) if len(position) else (position, position)
        if len(alive):
            where = np.searchsorted(position, alive)
            seg = of[where]
            by = np.lexsort((least[seg], bucket))
            lead = np.concatenate(([True], bucket[by][1:] != bucket[by][:-1]))
            head = by[lead][np.cumsum(lead) - 1]
            earlier = by[least[seg[by]] > least[seg[head]]]
            source = head[least[seg[by]] > least[seg[head]]]
            same = np.concatenate([(rows_at(b, alive[x], length) == rows_at(b, alive[y], length)).all(1) for x, y in zip(np.array_split(earlier, max(1, len(earlier) >> 17)), np.array_split(source, max(1, len(earlier) >> 17)))] or [np.empty(0, bool)])
            hit, offset = seg[earlier[same]], step[where[earlier[same]]]
            # in every row that has the segment's bytes in its least document
            holders = np.flatnonzero(doc == least[number])
            holders = holders[np.argsort(number[holders], kind="stable")]
            lo, hi = np.searchsorted(number[holders], hit), np.searchsorted(number[holders], hit, side="right")
            times = hi - lo
            who = holders[np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            found.append((block[who], row[who], start[who] + np.repeat(offset, times), np.full(len(who), length)))
    block, row, start, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, row, block))
    block, row, start, size = block[order], row[order], start[order], size[order]
    cuts = np.flatnonzero(np.diff(block)) + 1
    out = [(int(k[0]), r, s, z) for k, r, s, z in zip(*(np.split(x, cuts) for x in (block, row, start, size))) if len(k)]
    return pa.table({"block": pa.array([x[0] for x in out], pa.int32()), **{k: pa.array([x[i].astype(t).tobytes() for x in out], pa.binary()) for i, (k, t) in enumerate((("row", "<u4"), ("start", "<u4"), ("size", "<u2")), 1)}})


def _cut(docs_of: pa.Table, spans_of: pa.Table, length: int, with_text: bool) -> pa.Table:
    """Rows of a block without their covered bytes."""
    block = Block(docs_of, length)
    ends = np.cumsum(block.sizes)
    edge = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    for r, s, z in zip(*(spans_of.column(k).to_pylist() for k in ("row", "start", "size"))):
        row, start, size = np.frombuffer(r, "<u4").astype(np.int64), np.frombuffer(s, "<u4").astype(np.int64), np.frombuffer(z, "<u2").astype(np.int64)
        at = (ends - block.sizes)[row] + start
        np.add.at(edge, at, 1)
        np.add.at(edge, at + size, -1)
    gone = np.cumsum(edge)[:-1] > 0
    rows = []
    for i, (t, end) in enumerate(zip(block.texts, ends.tolist())):
        mine = gone[end - len(t) : end]
        n = int(mine.sum())
        kept = np.frombuffer(t, np.uint8)[~mine].tobytes() if n else t
        spans = int(mine[:1].sum() + (mine[1:] & ~mine[:-1]).sum()) if n else 0
        rows.append((int(block.ids[i]), len(t), n, spans, kept))
    rows += [(None, len((t or "").encode()), 0, 0, (t or "").encode()) for d, t in zip(docs_of.column("doc_id").to_pylist(), docs_of.column("text").to_pylist()) if d is None]
    columns = list(zip(*rows)) or [[]] * 5
    out = {"doc_id": pa.array(columns[0], pa.int64()), "n_bytes": pa.array(columns[1], pa.int64()), "n_removed": pa.array(columns[2], pa.int64()), "n_spans": pa.array(columns[3], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in columns[4]], pa.string())}
    if with_text:
        out["kept"] = pa.array(columns[4], pa.binary())
    return pa.table(out)
