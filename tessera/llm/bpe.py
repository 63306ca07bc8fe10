"""BPE encoding and decoding with a pair occurrence index.

The words (pre-tokens) of a group of documents form one symbol array. An index maps each pair of neighbouring symbols,
named by its merge rank, to all its positions. Active ranks are taken in ascending order; all positions of a rank are merged
at once and the lists of the pairs this creates are updated. A new pair contains a symbol that no earlier merge can make,
so its rank is above the current one and ascending order gives what merging word by word gives.

Defined results: a null text counts as empty (no ids, the digest of no bytes); repeated rows give repeated rows; a null id
stays null; an empty table gives no rows. Very long texts are encoded whole; memory is bounded by one text or GROUP_BYTES,
whichever is larger, and the word cache by CACHE_WORDS.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import IdStore, Numbers, groups_of, held, texts

#: Fixed value: the pattern that splits a text into words before any merge (that of the vocabulary's own library).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same split in the standard library's syntax, letters first as no other branch can match where they do; right for texts
#: without characters that ODD finds.
PLAIN = re.compile(r""" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+""")
#: Characters outside Latin, or in Latin-1 but classed differently by the two libraries (separators 1C-1F, superscripts, fractions).
ODD = re.compile("[^\\x00-\\x1b\\x20-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")
#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 150_000


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PairIndexBpe:
    """Encoder and decoder of a byte-level BPE vocabulary file (JSON with ``model`` and ``added_tokens``)."""

    def __init__(self, content: bytes):
        file = json.loads(content)
        letters, vocab = byte_letters(), file["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = max(vocab.values()) + 1
        keys = self.left * self.base + self.right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]
        special = {t["content"]: t["id"] for t in file.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in special.items()}
        self.special = special
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(PATTERN)
        self.forget()

    def forget(self) -> None:
        """An empty word cache. Special tokens are words."""
        self.words, self.store = Numbers(), IdStore()
        self.words.of([list(self.special)])
        self.words.take()
        self.store.add(np.fromiter(self.special.values(), np.int32), np.ones(len(self.special), np.int64))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 for pairs that never merge."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the (non-empty) words, end to end, and how many each has, by the pair occurrence index over all of them."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(lengths)
        starts, n = ends - lengths, len(sym)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1], prv[starts] = -1, -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(pos: np.ndarray) -> None:
            """Adds the pairs that start at ``pos`` to the index."""
            rank = self.ranks(sym[pos], sym[nxt[pos]])
            live = rank >= 0
            pos, rank = pos[live], rank[live]
            if not len(pos):
                return
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(pos, cuts) if len(cuts) else [pos]):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(nxt >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b = self.left[r], self.right[r]
            after = nxt[pos]
            pos = pos[(sym[pos] == a) & (after >= 0) & (sym[after] == b)]
            if a == b:  # runs of one symbol pair off from the left
                taken, used = [], -1
                for p in np.unique(pos).tolist():
                    if p != used:
                        taken.append(p)
                        used = int(nxt[p])
                pos = np.array(taken, np.int64)
            if not len(pos):
                continue
            gone = nxt[pos]
            rest = nxt[gone]
            sym[pos], sym[gone], nxt[pos] = self.made[r], -1, rest
            prv[rest[rest >= 0]] = pos[rest >= 0]
            before = prv[pos]
            note(np.unique(np.concatenate((before[before >= 0], pos[nxt[pos] >= 0]))))
        kept = sym >= 0
        return sym[kept], np.add.reduceat(kept.astype(np.int64), starts)

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text) if ODD.search(text) else PLAIN.findall(text)

    def encode_batch(self, batch: list[str]) -> list[np.ndarray]:
        """Ids of each text; strings of special tokens in a text become their ids."""
        cut, special = self.cut, self.special
        split = [[w for p in cut.split(t) for w in ([p] if p in special else self.pieces(p))] if cut and cut.search(t) else self.pieces(t) for t in batch]
        if len(self.words) > CACHE_WORDS:
            self.forget()
        at, counts = self.words.of(split)
        new = self.words.take()
        if new:
            self.store.add(*self.encode_words([w.encode() for w in new]))
        return self.store.gather(at, counts)

    def decode(self, ids) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


def _coder(path: str) -> PairIndexBpe:
    def make():
        with open(path, "rb") as f:
            return PairIndexBpe(f.read())

    return held(("bpe", path), make)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_text: bool = False) -> DataFrame:
    """Each row's ids and what they decode to.

    ``vocabulary`` is the path of the vocabulary file, which every node has as it has the Python packages. Columns: doc_id,
    n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded text), then
    ids (array<int>) and decoded where asked for.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        coder = _coder(vocabulary)
        for part in groups_of(batches):
            ids = coder.encode_batch([t or "" for t in part.column(1).to_pylist()])
            decoded = [coder.decode(x) for x in ids]
            columns = {
                "doc_id": part.column(0),
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if with_text:
                columns["decoded"] = pa.array(decoded, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return texts(df, id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text that ``ids_col`` (array<int>, null: empty) decodes to."""

    def run(batches):
        coder = _coder(vocabulary)
        for part in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": pa.array([coder.decode(x or []) for x in part.column(1).to_pylist()], pa.string())})

    return df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
