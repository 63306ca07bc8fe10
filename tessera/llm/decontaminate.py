"""Benchmark decontamination: every training passage queries a BM25 index of test items; what it retrieves is verified.

The inverted index holds, of each term, the items it is in with its BM25 impact there, as a share of the item's own full
score, so that one threshold fits all items. Items are sorted by length and fall into classes whose longest item has at most
RATIO times the words of the shortest (or MORE words more); passages for a class are windows of twice its longest item, a
longest item apart, so each item that is in a text is in a window whole. Postings are cut into blocks of BLOCK items; of each
block that a term is in, the index keeps the greatest impact.

Retrieval is block-max WAND: a passage's terms stand at cursors in their lists; in the order of the cursors, the pivot is the
first block at which the sum of the terms' greatest impacts reaches the threshold. Cursors before it jump to it; where the
sum of the block maxima reaches the threshold, the block's items get their exact scores. All passages of a batch move at
once, a pivot a step. What scores the threshold or more is verified by the words it shares in order: of the item's question
(all but its last sentence) and of its answer (its last sentence) the share of words that lie in n-grams of the item, or in a
whole part of fewer words, that are in the passage as well.

Document frequencies and the mean length are of all items. The index is sent to all tasks and grows with the postings; if the
items exceed ``most_bytes``, they are indexed in several parts of at most about that size, each of which passes over the
documents.

Defined results: null or empty texts and items without words match nothing; rows with a null id give rows with a null id;
items with a null id count and are reported with a null item_id; repeated rows give repeated rows; repeated items count as
separate items; of an item's windows with one score the greater overlaps are reported; texts of any length are searched
whole; further columns are ignored by ``leaks``, whatever their names, and kept by ``clean``; empty tables give no rows.
"""

from __future__ import annotations

import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Numbers, groups_of, held, small_batches, texts, written

CACHE_WORDS = 120_000
#: BM25 constants, items in a block, greatest spread of lengths in a class.
K1, B, BLOCK = 1.2, 0.75, 16
RATIO, MORE = 1.5, 4
#: Cursors that move at once, and what sums of shares may lack by rounding.
CURSORS, SLACK = 1 << 20, 1e-6
EDGES = string.punctuation + "«»„“”‚‘’…–—¿¡"
SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in text.lower().split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of an item without its last sentence, and of that sentence; an item of one sentence is all question."""
    parts = [p for p in SENTENCE.split(text.strip()) if words_of(p)]
    return (words_of(" ".join(parts[:-1])), words_of(parts[-1])) if len(parts) > 1 else (words_of(text), [])


def ngrams(words: list, n: int) -> set[tuple]:
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices from each start on, as many as its size, end to end."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Postings:
    """Inverted lists of a class of items: of each term its items and impacts, and its blocks with the greatest impact."""

    def __init__(self, at: int, longest: int, term: np.ndarray, item: np.ndarray, impact: np.ndarray):
        self.at, self.longest = at, longest
        order = np.lexsort((item, term))
        term, self.item, self.impact = term[order], item[order].astype(np.int32), impact[order].astype(np.float32)
        self.terms, first = np.unique(term, return_index=True)
        self.most = np.maximum.reduceat(self.impact, first)
        block, of = self.item // BLOCK, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(term))))
        self.blocks = int(block.max()) + 1
        key = of * self.blocks + block
        self.key, start = np.unique(key, return_index=True)  # list and block of each entry
        self.block = (self.key % self.blocks).astype(np.int32)
        self.block_most = np.maximum.reduceat(self.impact, start)
        self.start = np.append(start, len(key))  # an entry's postings
        self.list = np.searchsorted(self.key, np.arange(len(first) + 1) * self.blocks)  # a list's entries

    def pivots(self, lists: np.ndarray, sizes: np.ndarray, least: float):
        """Block-max WAND for passages that have ``sizes`` distinct terms, of the given lists: yields passages, the block
        each has to score, and matrices of its terms' entries and of those that are in the block."""
        ends = np.cumsum(sizes)
        by_size = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(by_size):
            many = CURSORS // max(int(sizes[by_size[min(at + 4095, len(by_size) - 1)]]), 1)
            rows = by_size[at : at + min(max(many, 1), 4096)]
            at += len(rows)
            width = np.arange(int(sizes[rows].max()))
            real = width < sizes[rows][:, None]
            of = np.where(real, lists[np.where(real, (ends - sizes)[rows][:, None] + width, 0)], 0)
            bound = np.where(real, self.most[of], 0).astype(np.float64)
            cursor, end = np.where(real, self.list[of], 0), np.where(real, self.list[of + 1], 0)
            while len(rows):
                block = np.where(cursor < end, self.block[np.minimum(cursor, len(self.block) - 1)], self.blocks)
                order = np.argsort(block, axis=1, kind="stable")
                reached = np.cumsum(np.take_along_axis(bound, order, 1), 1) >= least
                pivot = np.take_along_axis(block, np.take_along_axis(order, reached.argmax(1)[:, None], 1), 1)
                live = reached[:, -1] & (pivot[:, 0] < self.blocks)
                if not live.all():
                    rows, of, bound, cursor, end, block, pivot = (x[live] for x in (rows, of, bound, cursor, end, block, pivot))
                r, c = np.nonzero(block < pivot)
                moved = np.searchsorted(self.key, of[r, c] * self.blocks + pivot[r, 0])
                cursor[r, c] = np.minimum(moved, end[r, c])
                here = cursor < end
                here &= self.block[np.minimum(cursor, len(self.block) - 1)] == pivot
                best = np.where(here, self.block_most[np.minimum(cursor, len(self.block) - 1)], 0).sum(1, dtype=np.float64)
                scored = np.flatnonzero(best >= least)
                if len(scored):
                    yield rows[scored], pivot[scored, 0], cursor[scored], here[scored]
                cursor[here] += 1

    def retrieved(self, lists: np.ndarray, sizes: np.ndarray, least: float):
        """(passage, item, score) of all that score ``least`` or more."""
        for rows, block, entry, here in self.pivots(lists, sizes, least):
            r, c = np.nonzero(here)
            entry = entry[r, c]
            count = self.start[entry + 1] - self.start[entry]
            post = spans(self.start[entry], count)
            slot = np.repeat(r, count) * BLOCK + self.item[post] % BLOCK
            score = np.bincount(slot, self.impact[post], len(rows) * BLOCK)
            for k in np.flatnonzero(score >= least).tolist():
                yield int(rows[k // BLOCK]), self.at + int(block[k // BLOCK]) * BLOCK + k % BLOCK, float(score[k])


class Index:
    """``items``: (id, text); ``known``: in how many of all items each word is, their number and their words in all."""

    def __init__(self, items: list[tuple[int, str]], n: int, known: tuple[dict, int, int]):
        df, total, words = known
        split = sorted(((i, words_of(t), t) for i, t in items), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        split = [x for x in split if x[1]]
        self.n, self.ids = n, [i for i, _, _ in split]
        self.terms: dict[str, int] = {}
        for _, ws, _ in split:
            for w in ws:
                self.terms.setdefault(w, len(self.terms))
        count = np.array([df[w] for w in self.terms], float)
        idf = np.log1p((total - count + 0.5) / (count + 0.5))
        self.lengths = np.array([len(ws) for _, ws, _ in split], np.int64)
        self.flat = np.fromiter((self.terms[w] for _, ws, _ in split for w in ws), np.int32, int(self.lengths.sum()))
        self.ends = np.cumsum(self.lengths)
        self.question = np.array([len(question_and_answer(t)[0]) for _, _, t in split], np.int64)
        self.classes = []
        at = 0
        while at < len(split):
            stop = int(np.searchsorted(self.lengths, max(self.lengths[at] * RATIO, self.lengths[at] + MORE), "right"))
            lengths = self.lengths[at:stop]
            pair, tf = np.unique(np.repeat(np.arange(stop - at), lengths) * len(self.terms) + self.flat[self.ends[at] - lengths[0] : self.ends[stop - 1]], return_counts=True)
            item, term = np.divmod(pair, len(self.terms))
            score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] * total / words))
            self.classes.append(Postings(at, int(lengths[-1]), term, item, score / np.bincount(item, score)[item]))
            at = stop

    def words(self, item: int) -> list[int]:
        return self.flat[self.ends[item] - self.lengths[item] : self.ends[item]].tolist()


def same_before(doc: np.ndarray, term: np.ndarray) -> np.ndarray:
    """Where the same term was last in the same document, or -1."""
    order = np.lexsort((term, doc))
    same = (doc[order[1:]] == doc[order[:-1]]) & (term[order[1:]] == term[order[:-1]])
    before = np.full(len(term), -1)
    before[order[1:][same]] = order[:-1][same]
    return before


class Searcher:
    """Searches texts for the items of an index."""

    def __init__(self, index: Index, least_score: float, least_overlap: float):
        self.index, self.least, self.overlap = index, least_score, least_overlap
        self.forget()

    def forget(self) -> None:
        self.known, self.term = Numbers(), np.empty(0, np.int64)

    def __call__(self, batch: list[str | None]) -> list[list[tuple[int, float, float, float]]]:
        """Of each text: item, best score, question and answer overlap of what is verified."""
        index, other = self.index, len(self.index.terms)
        found: list[dict] = [{} for _ in batch]
        if len(self.known) > CACHE_WORDS:
            self.forget()
        flat, sizes = self.known.of([t.lower().split() if t else [] for t in batch])
        self.term = np.concatenate((self.term, np.fromiter((index.terms.get(w.strip(EDGES), other if w.strip(EDGES) else -1) for w in self.known.take()), np.int64)))
        term = self.term[flat]
        doc = np.repeat(np.arange(len(batch)), sizes)
        real = term >= 0
        term, doc = term[real], doc[real]
        sizes = np.bincount(doc, minlength=len(batch))
        ends = np.cumsum(sizes)
        before = same_before(doc, term)
        used, place = np.unique(term, return_inverse=True)
        for part in index.classes:
            longest = part.longest
            spot = np.minimum(np.searchsorted(part.terms, used), len(part.terms) - 1)
            of = np.where(part.terms[spot] == used, spot, -1)[place]  # each word's list
            at = np.flatnonzero(of >= 0)
            of = of[at]
            # a window that the one before it reaches past the end of isn't needed
            count = np.where(sizes > 0, np.maximum(-(-sizes // longest) - 1, 1), 0)
            first = np.repeat(ends - sizes, count) + spans(np.zeros(len(batch), np.int64), count) * longest
            last = np.minimum(first + 2 * longest, np.repeat(ends, count))
            low, high = np.searchsorted(at, first), np.searchsorted(at, last)
            total = np.concatenate(([0.0], np.cumsum(part.most[of], dtype=np.float64)))
            window = np.flatnonzero(total[high] - total[low] >= self.least - SLACK)
            if not len(window):
                continue
            size = (high - low)[window]
            word = spans(low[window], size)
            row = np.repeat(np.arange(len(window)), size)
            new = before[at[word]] < first[window][row]  # a term counts once a window
            text = np.repeat(np.arange(len(batch)), count)[window]
            for k, item, score in part.retrieved(of[word[new]], np.bincount(row[new], minlength=len(window)), self.least - SLACK):
                self.verify(found[text[k]], item, score, term[first[window[k]] : last[window[k]]].tolist())
        return [[(index.ids[i], *x) for i, x in sorted(f.items())] for f in found]

    def verify(self, found: dict, item: int, score: float, window: list[int]) -> None:
        words, border = self.index.words(item), int(self.index.question[item])
        in_both = [False] * len(words)
        whole = [(0, len(words))] + [p for p in ((0, border), (border, len(words))) if 0 < p[1] - p[0] < self.index.n]
        for start, stop in whole:
            size = min(self.index.n, stop - start)
            have = ngrams(window, size)
            for i in range(start, stop - size + 1):
                if tuple(words[i : i + size]) in have:
                    in_both[i : i + size] = [True] * size
        q, a = (sum(p) / len(p) if p else 1.0 for p in (in_both[:border], in_both[border:]))
        if q >= self.overlap and a >= self.overlap and (item not in found or found[item] < (score, q, a)):
            found[item] = (score, q, a)


def _searcher(items: list[tuple[int, str]], known: tuple, n: int, least_score: float, least_overlap: float) -> Searcher:
    return held(("searcher", tuple(items), known[1:], n, least_score, least_overlap), lambda: Searcher(Index(items, n, known), least_score, least_overlap))


def word_counts(rows: DataFrame) -> DataFrame:
    """(term, items, words): in how many items a term is; in the row of a null term, the number of items and of their words."""

    def run(batches):
        for batch in batches:
            split = [ws for ws in map(words_of, batch.column(0).to_pylist()) if ws]
            count = Counter(w for ws in split for w in set(ws))
            yield pa.RecordBatch.from_arrays([pa.array([None, *count], pa.string()), pa.array([len(split), *count.values()], pa.int64()), pa.array([sum(map(len, split))] + [0] * len(count), pa.int64())], names=["term", "items", "words"])

    return small_batches(rows.select("text")).mapInArrow(run, "term string, items long, words long").groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"))


def item_groups(items: DataFrame, most_bytes: int, item_col: str = "item_id", text_col: str = "text"):
    """Lists of (item, text), each of about ``most_bytes`` at most, with the counts that an index of them needs."""
    rows = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).filter("text is not null")
    size = rows.select(F.sum(F.octet_length("text") + 16).alias("s")).first()["s"] or 0
    groups = -(-size // most_bytes)
    counts = word_counts(rows) if groups < 2 else written(word_counts(rows), "item-words")
    for g in range(groups):
        chosen = rows if groups == 1 else rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        needed = counts if groups == 1 else counts.join(word_counts(chosen).select(F.col("term").alias("_t")), F.col("term").eqNullSafe(F.col("_t")), "left_semi")
        df = {r["term"]: (r["items"], r["words"]) for r in needed.collect()}
        total, words = df.pop(None, (0, 0))
        yield sorted(((r["item"], r["text"]) for r in chosen.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), ({t: n for t, (n, _) in df.items()}, total, words)


def leaks(df: DataFrame, items: DataFrame, n: int = 3, least_score: float = 0.6, least_overlap: float = 0.6, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of each item that is in a document."""
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    docs, out = texts(df, id_col, text_col), []
    for group, known in item_groups(items, most_bytes):

        def run(batches, group=group, known=known):
            search = _searcher(group, known, n, least_score, least_overlap)
            for part in groups_of(batches):
                rows = [(d, *x) for d, found in zip(part.column(0).to_pylist(), search(part.column(1).to_pylist())) for x in found]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        out.append(docs.mapInArrow(run, schema))
    result = out[0] if out else df.sparkSession.createDataFrame([], schema)
    for more in out[1:]:
        result = result.union(more)
    return result


def clean(df: DataFrame, items: DataFrame, n: int = 3, least_score: float = 0.6, least_overlap: float = 0.6, most_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text has no item in it."""
    at = df.columns.index(text_col)
    for group, known in item_groups(items, most_bytes):

        def run(batches, group=group, known=known):
            search = _searcher(group, known, n, least_score, least_overlap)
            for batch in batches:
                named = batch.rename_columns([str(i) if i != at else "text" for i in range(batch.num_columns)])
                for part in groups_of([named]):
                    kept = [not found for found in search(part.column(at).to_pylist())]
                    yield part.filter(pa.array(kept, pa.bool_())).rename_columns(batch.schema.names)

        df = small_batches(df).mapInArrow(run, df.schema)
    return df
