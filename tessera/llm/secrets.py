"""Secret scan: fixed patterns, and a token-efficiency test.

Random strings cut into many short tokens. A run of key characters whose characters per token under a public vocabulary
(tiktoken ranks) fall below a ratio is reported as ``random``, after known digests and identifiers are excluded: hex runs of
digest length, UUIDs, rulers, dates and other numbers, paths and identifiers of plain words. Of a run of letter groups and
digit groups the letter groups alone are judged, by the same ratio: words reach it, random letters don't, whatever their number
or length. Runs of fewer than 20 key characters aren't tested, as few tokens say little.

Defined results: a null text counts as empty; repeated rows give repeated rows; a null id stays null. Texts are scanned
whole. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import groups_of, held, small_batches, texts

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "random")
# The patterns of the three base kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORD = re.compile(r"(?ai:pass|secret|token|api)")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: What the method looks at: runs of so many key characters.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What it leaves alone.
DIGESTS = {32, 40, 48, 56, 64, 96, 128}
HEX_RUN = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
PLAIN_PARTS = re.compile(r"[/_=+-]*(?:[A-Za-z]+|\d+)(?:[/_=+-]+(?:[A-Za-z]+|\d+))*[/_=+-]*")
LETTERS = re.compile(r"[A-Za-z]+")
RULER = re.compile(r"(.)\1+|[/_=+-]+")


class RandomRuns:
    """The token-efficiency test under a tiktoken rank file."""

    def __init__(self, ranks_path: str, pattern: str, most_ratio: float):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.most = most_ratio

    def excluded(self, run: str) -> bool:
        if HEX_RUN.fullmatch(run) and len(run) in DIGESTS or UUID.fullmatch(run) or RULER.fullmatch(run):
            return True
        if not PLAIN_PARTS.fullmatch(run):
            return False
        words = LETTERS.findall(run)
        return sum(map(len, words)) >= self.most * sum(len(self.encoding.encode_ordinary(w)) for w in words)

    def __call__(self, run: str) -> bool:
        return not self.excluded(run) and len(run) < self.most * len(self.encoding.encode_ordinary(run))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three base kinds; matches that fail their length are dropped, yet they take up their text."""
    found = []
    if KEYWORD.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _test(*key) -> RandomRuns:
    return held(("random", *key), lambda: RandomRuns(*key))


def scan(df: DataFrame, ranks_path: str, pattern: str, most_ratio: float = 1.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each text: doc_id, spans array<struct<kind,start,end>> (base kinds and ``random``), base_list, span_list (strings).

    ``most_ratio``: a run with fewer characters per token is random. ``ranks_path`` is on every node, as the packages are.
    """

    def run(batches):
        random = _test(ranks_path, pattern, most_ratio)
        for part in groups_of(batches):
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                more = [(m.start(), 3, m.end()) for m in RUN.finditer(text or "") if random(m.group())]
                rows.append((base, sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for _, spans in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array([listed(base) for base, _ in rows], pa.string()),
                    pa.array([listed(spans) for _, spans in rows], pa.string()),
                    pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows], pa.string()),
                ],
                names=["doc_id", "found", "base_list", "span_list", "base_sha256"],
            )

    schema = "doc_id long, found array<struct<kind:string,start:long,end:long>>, base_list string, span_list string, base_sha256 string"
    return texts(df, id_col, text_col).mapInArrow(run, schema)


def redact(df: DataFrame, ranks_path: str, pattern: str, most_ratio: float = 1.9, mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with each stretch of text that spans cover replaced by ``mask``; null texts stay null."""
    at = df.columns.index(text_col)

    def run(batches):
        random = _test(ranks_path, pattern, most_ratio)
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = sorted([(a, b) for a, _, b in base_spans(text or "")] + [(m.start(), m.end()) for m in RUN.finditer(text or "") if random(m.group())])
                if spans:
                    pieces, end = [], 0
                    for a, b in spans:
                        if a >= end:
                            pieces += [text[end:a], mask]
                        end = max(end, b)
                    text = "".join([*pieces, text[end:]])
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))

    return small_batches(df).mapInArrow(run, df.schema)
