"""Language ID by cross-parsing entropy.

For each language, labelled text becomes a suffix automaton. A text is cut greedily into phrases, each the longest match of
what follows in that automaton; the fewer phrases a language needs, the closer the text is to it. Phrases times the log of
the labelled length, over the characters parsed, estimates the cross entropy; the least wins, ties go to the first name.
Words are parsed one by one with their borders as characters, so phrases don't run over a word's end; a distinct word is
parsed once and counted as often as it occurs, which gives the same sum as parsing the whole text word by word.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or where nothing could be learned; repeated
rows give repeated rows; a null id stays null (and is never learned from). Whole texts are parsed.

What is accepted as a learned language: bits a character of its labelled documents that weren't learned from have a mean and a
spread, which shrinks with the root of a text's length up to the language's mean length (longer texts have that one's); texts
SPREADS spreads above the mean are in some other language. Limits are of all labelled documents that are held out; learning reads a
bounded sample, by parameters, of which stretches start at hashed places.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import groups_of, held, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Word border in labelled and parsed text.
BORDER = "\x00"
#: Words whose phrase counts a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 120_000
UNDETERMINED = "und"
#: Spreads above a language's mean that a text in it may be.
SPREADS = 10.0


class SuffixAutomaton:
    """All substrings of a text as paths from state 0."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        length, link, last = [0], [-1], 0
        for c in text:
            state = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = state
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[state] = q
                else:
                    copy = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[state] = copy
            last = state

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; a character that never occurs is a phrase of its own."""
        step, start = self.next, self.next[0]
        at: dict[str, int] = {}
        n = 0
        for c in text:
            state = at.get(c)
            if state is None:
                n += 1
                state = start.get(c)
            at = step[state] if state is not None else {}
        return n


class CrossParser:
    def __init__(self, labelled: dict[str, str]):
        self.names = sorted(labelled)
        self.automata = [SuffixAutomaton(labelled[x]) for x in self.names]
        self.weights = np.log2([max(2, len(labelled[x])) for x in self.names])
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.counts = np.empty((0, len(self.names)), np.int32)
        self.sizes = np.empty(0, np.int64)

    def predict(self, batch: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Names, scores, bits a character and characters (borders included) of each text."""
        split = [WORD.findall(t.lower()) if t else [] for t in batch]
        split = [ws if any(map(str.isalpha, ws)) or any(c.isalpha() for w in ws for c in w) else [] for ws in split]
        if len(self.words) > CACHE_WORDS:
            self.forget()
        new = list({w for ws in split for w in ws} - self.words.keys())
        if new:
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))
            marked = [f"{BORDER}{w}{BORDER}" for w in new]
            more = np.array([[a.phrases(w) for a in self.automata] for w in marked], np.int32).reshape(len(new), -1)
            self.counts, self.sizes = np.concatenate((self.counts, more)), np.concatenate((self.sizes, [len(w) for w in marked]))
        names, scores, bits, chars = [], np.zeros(len(batch)), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
        for i, ws in enumerate(split):
            if not ws or not self.names:
                names.append(UNDETERMINED)
                continue
            at = np.fromiter(map(self.words.__getitem__, ws), np.int64, len(ws))
            chars[i] = self.sizes[at].sum()
            cost = self.counts[at].sum(0) * self.weights / chars[i]
            order = np.argsort(cost, kind="stable")
            best, second = cost[order[0]], cost[order[1]] if len(order) > 1 else np.inf
            names.append(self.names[order[0]])
            scores[i], bits[i] = 1 - best / second if second > 0 else 0, best
        return names, scores, bits, chars


def usable_rows(df: DataFrame, usable: Column, lang_col: str, id_col: str, text_col: str) -> DataFrame:
    """The ``usable`` labelled rows: id, lang and text."""
    return df.filter(usable).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("id is not null and lang is not null and text is not null")


def drawn(df: DataFrame, usable: Column, most_docs: int, lang_col: str, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, int]]:
    """A hashed sample of the ``usable`` labelled rows (lang, drawn, id, text), about 1.5 ``most_docs`` a language or all it has, and each language's rows."""
    rows = usable_rows(df, usable, lang_col, id_col, text_col)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 1.5 * most_docs / n + 64 / n) * (1 << 40)))])
    picked = rows.withColumn("drawn", F.pmod(F.xxhash64("id"), F.lit(1 << 40)))
    return (picked.filter(F.col("drawn") < limit[F.col("lang")]) if counts else picked.filter("false")), counts


def learn(df: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most_docs: int = 400, most_chars: int = 40_000, of_one: int = 1_000) -> dict[str, str]:
    """Labelled text of each language from a bounded sample of the ``usable`` rows.

    At most ``most_docs`` documents and about ``most_chars`` characters of words a language, documents chosen by a hash of their
    ids. Of one document at most ``of_one`` characters of words are taken, from a stretch that starts at a hashed place; of a
    language of so few documents that this doesn't reach ``most_chars``, as much of each as it takes.
    """
    sample, counts = drawn(df, usable, most_docs, lang_col, id_col, text_col)
    if not counts:
        return {}
    share = {lang: max(of_one, -(-most_chars // n)) for lang, n in counts.items()}
    size = F.create_map(*[F.lit(x) for lang, n in share.items() for x in (lang, 4 * n)])[F.col("lang")]
    start = F.pmod(F.xxhash64("id", F.lit("start")), F.greatest(F.length("text") - size + 1, F.lit(1))) + 1
    labelled: dict[str, str] = {}
    taken: dict[str, int] = {}
    for r in sorted(sample.select("lang", "drawn", "id", F.substring("text", start.cast("int"), size).alias("text")).collect(), key=lambda r: (r["lang"], r["drawn"], r["id"], r["text"])):
        so_far = labelled.get(r["lang"], BORDER)
        if len(so_far) >= most_chars or taken.get(r["lang"], 0) >= most_docs:
            continue
        words = BORDER.join(WORD.findall(r["text"].lower()))[: share[r["lang"]]]
        labelled[r["lang"]], taken[r["lang"]] = so_far + words + BORDER, taken.get(r["lang"], 0) + 1
    return labelled


def limits(df: DataFrame, held_out: Column, labelled: dict[str, str], lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> dict[str, tuple[float, float, float]]:
    """Mean bits a character of each language, its spread times the root of the characters, and the mean length, from all labelled
    ``held_out`` documents that are told right; ``labelled`` is learned from others."""
    if not labelled:
        return {}
    rows = usable_rows(df, held_out, lang_col, id_col, text_col)
    told = identify(rows.select("lang", "text", F.xxhash64("id").alias("key")), labelled, "key", "text", also="lang").filter("lang = lang_pred")
    out = {}
    for r in told.groupBy("lang").agg(F.sum("chars").alias("n"), F.sum(F.col("bits") * F.col("chars")).alias("b"), F.sum(F.col("bits") ** 2 * F.col("chars")).alias("bb"), F.count("*").alias("docs")).collect():
        mean = r["b"] / r["n"]
        out[r["lang"]] = mean, float(np.sqrt(max(0.0, r["bb"] - 2 * mean * r["b"] + mean**2 * r["n"]) / r["docs"])), r["n"] / r["docs"]
    return out


def _parser(labelled: dict[str, str]) -> CrossParser:
    return held(("language", tuple(sorted(labelled.items()))), lambda: CrossParser(labelled))


def identify(df: DataFrame, labelled: dict[str, str], id_col: str = "doc_id", text_col: str = "text", also: str | None = None) -> DataFrame:
    """doc_id, lang_pred, score (how much cheaper the best language is than the next, 0 to 1), bits a character and characters;
    and the column ``also`` of texts, as it is."""

    def run(batches):
        parser = _parser(labelled)
        for part in groups_of(batches):
            names, scores, bits, chars = parser.predict(part.column(1).to_pylist())
            columns = [part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(bits), pa.array(chars), *part.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "bits", "chars", *([also] if also else [])])

    more = [F.col(also).cast("string").alias(also)] if also else []
    docs = small_batches(df).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, bits double, chars long" + (f", {also} string" if also else ""))


def in_language(bits: float, chars: int, limit: tuple[float, float, float], spreads: float) -> bool:
    mean, spread, typical = limit
    return bits <= mean + spreads * spread / min(chars, typical) ** 0.5


def accepted(df: DataFrame, labelled: dict[str, str], limit: dict[str, tuple[float, float, float]], spreads: float = SPREADS, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, whose text is in one of the languages: not ``und``, and at most ``spreads`` spreads for
    its length above the mean of its language in ``limit`` (result of ``limits``; a language that isn't there has the most lenient
    of the others' values; without any, all that isn't ``und`` is kept)."""
    at = df.columns.index(text_col)
    most = (max(m for m, *_ in limit.values()), max(s for _, s, _ in limit.values()), min(n for *_, n in limit.values())) if limit else None

    def run(batches):
        parser = _parser(labelled)
        for batch in batches:
            named = batch.rename_columns([str(i) if i != at else "text" for i in range(batch.num_columns)])
            for part in groups_of([named]):
                names, _, bits, chars = parser.predict(part.column(at).to_pylist())
                kept = [x != UNDETERMINED and (not limit or in_language(b, n, limit.get(x, most), spreads)) for x, b, n in zip(names, bits.tolist(), chars.tolist())]
                yield part.filter(pa.array(kept, pa.bool_())).rename_columns(batch.schema.names)

    return small_batches(df).mapInArrow(run, df.schema)
