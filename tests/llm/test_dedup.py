import random

import pytest

from tessera.llm import paragraph_dedup, suffix_dedup

from .conftest import sha


def brute_suffix(rows, length=50):
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        if d is not None:
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        if d is not None:
            for k in range(len(b) - length + 1):
                if first[b[k : k + length]] < d:
                    gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def copied(seed):
    r = random.Random(seed)
    source = "".join(r.choice("ab cdé\n") for _ in range(3000))
    rows = [(i * 5 % 97, "".join(source[a : a + r.randrange(20, 200)] for a in [r.randrange(2800) for _ in range(4)])) for i in range(60)]
    return rows + [(200, "a" * 3000), (201, "a" * 2500 + "b"), (202, "ab" * 1500), (150, "")]


@pytest.mark.parametrize("many", [2000, 5])
def test_suffix_dedup_equals_brute_force(spark, small, odd, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 1 << 9)
    made = spark.createDataFrame(copied(3), "doc_id long, text string")
    for docs in (made, small.limit(80), odd.filter("doc_id is null or doc_id not in (6, 7)")):
        docs = docs.select("doc_id", "text").cache()
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(map(repr, map(tuple, suffix_dedup.dedup(docs).collect()))) == sorted(map(repr, brute_suffix(rows)))


def test_suffix_dedup_other_lengths(spark):
    docs = spark.createDataFrame(copied(5), "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, suffix_dedup.dedup(docs, length=37).collect()))) == sorted(map(repr, brute_suffix(rows, 37)))


def test_suffix_dedup_long_and_empty(odd, empty):
    got = {r.doc_id: r for r in suffix_dedup.dedup(odd, with_text=True).collect()}
    assert got[6].n_removed == 0 and got[6].n_bytes == 200_000 and got[5].n_removed == got[4].n_bytes
    assert suffix_dedup.dedup(empty).collect() == []


def test_chance_repeats_of_anchors_send_nothing():
    """In words of few syllables most grams of 16 bytes repeat by chance; only what can hold a repeated string is sent."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(7)
    syllables = ["th", "in", "er"]
    block = lambda k: pa.table({"block": [k] * 100, "doc_id": range(k, 200, 2), "text": ["".join(r.choice(syllables) for _ in range(1500)) for _ in range(100)]}, schema=pa.schema([("block", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string())]))
    blocks = [block(0), block(1)]
    passage = blocks[0]["text"][0].as_py()[100:500]
    blocks[1] = pa.concat_tables([blocks[1].slice(1), pa.table({"block": [1], "doc_id": [999], "text": [passage]}, schema=blocks[1].schema)])
    grams = [np.unique(np.concatenate([a.hash for _, a, *_ in suffix_dedup.Block(b, 50).anchors()])) for b in blocks]
    assert len(np.intersect1d(*grams)) > 0.3 * len(grams[1])
    posted = pa.concat_tables([suffix_dedup._post(b, 50, 1) for b in blocks])
    marked = suffix_dedup._mark(posted)
    sent = [suffix_dedup._segments(b, marked.slice(k, 1), 4, 1, 50) for k, b in enumerate(blocks)]
    size = [sum(int(np.frombuffer(x, "<u2").sum()) for x in s["size"].to_pylist()) for s in sent]
    assert size[1] >= 400 and max(size) < 0.05 * 100 * 2000, size
    covered = suffix_dedup._cover(pa.concat_tables(sent), 50, 25)
    rows = {(b, i) for b, x in zip(covered["block"].to_pylist(), covered["row"].to_pylist()) for i in np.frombuffer(x, "<u4").tolist()}
    assert (1, 99) in rows


def test_contexts_travel_in_gaps():
    import numpy as np

    for keys in ([], [0], [5, 6, 1 << 20, (1 << 32) - 1]):
        assert suffix_dedup.unpacked(suffix_dedup.packed(np.array(keys, np.int64))).tolist() == keys


def test_paragraphs_cover_the_text():
    r = random.Random(1)
    for text in ("", "a\n\nb", "x\r\ny\x0bz", " ".join(r.choice(["word.", "other", "end!"]) for _ in range(500)), "é ü\n"):
        spans = paragraph_dedup.paragraphs(text)
        assert "".join(text[a:b] for a, b in spans) == text and all(b > a for a, b in spans)


def brute_paragraphs(rows, n=5, percent=80):
    found = []
    for d, t in rows:
        for a, b in paragraph_dedup.paragraphs(t or ""):
            w = t[a:b].encode().lower().split()
            if len(w) >= n:
                found.append((d, a, b, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))))
    parent = list(range(len(found)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(found):
        for j in range(i):
            k = len(x[3] & found[j][3])
            if k and 100 * k >= percent * len(x[3] | found[j][3]):
                parent[find(i)] = find(j)
    first = {}
    for i, x in enumerate(found):
        first[find(i)] = min(x[:2], first.get(find(i), x[:2]))
    return {(x[0], x[1], x[2]) for i, x in enumerate(found) if first[find(i)] != x[:2]}


def test_paragraph_dedup_equals_brute_force(spark, small):
    docs = small.limit(60).select("doc_id", "text").cache()
    removed = paragraph_dedup.dedup(docs)
    got = {(r.doc_id, s.start, s.stop) for r in removed.collect() for s in r.removed}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_paragraphs(rows)
    assert got == want and removed.count() == len(rows)
    cleaned = {r.doc_id: r.text for r in paragraph_dedup.clean(docs, removed).collect()}
    for d, t in rows:
        assert cleaned[d] == "".join(c for k, c in enumerate(t) if not any(x == d and a <= k < b for x, a, b in want))


def test_paragraph_dedup_odd_rows(odd, empty):
    got = {r.doc_id: r for r in paragraph_dedup.dedup(odd).collect()}
    assert got[5].n_removed == 3 and got[1].n_paragraphs == got[2].n_paragraphs == 0 and got[None].n_removed == 0
    assert paragraph_dedup.dedup(empty).collect() == []


def prose(r, n):
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) + r.choice(["", "", "", "", "", ",", "."]) for _ in range(n)]
    return " ".join(words)


def test_passages_inside_longer_lines_are_found(spark):
    r = random.Random(11)
    rows, planted = [], []
    for k in range(150):
        passage = prose(r, 50)
        for d in (2 * k, 2 * k + 1):
            before = prose(r, r.randrange(5, 60)) + " "
            rows.append((d, before + passage + " " + prose(r, r.randrange(5, 60))))
        planted.append((2 * k + 1, len(before), len(before) + len(passage)))
    got = {x.doc_id: x.removed for x in paragraph_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    covered = [sum(len(rows[d][1][max(a, s.start) : min(b, s.stop)].split()) for s in got[d] if s.start < b and s.stop > a) / 50 for d, a, b in planted]
    assert sum(c > 0 for c in covered) >= 0.95 * len(covered) and sum(covered) / len(covered) > 0.6
    assert not any(got[2 * k] for k in range(150))


def test_short_repeats_stay_and_runs_go(spark):
    r = random.Random(5)
    line, block = prose(r, 12), "\n".join(prose(r, 12) for _ in range(3)) + "\nAs.\n" + prose(r, 12)
    rows = [(1, f"{line}\n{prose(r, 20)}\n{block}"), (2, f"{prose(r, 20)}\n{line}\n{prose(r, 20)}"), (3, f"{block}\n{prose(r, 20)}\n{line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in paragraph_dedup.dedup(docs, least_words=30).collect()}
    assert got == {1: 0, 2: 0, 3: 4}
    assert {x.doc_id: x.n_removed for x in paragraph_dedup.dedup(docs).collect()} == {1: 0, 2: 1, 3: 5}


def test_small_sets_that_reach_the_threshold_share_a_token():
    import numpy as np

    r = random.Random(3)
    for percent in (80, 67, 95):
        for _ in range(3000):
            a = set(r.sample(range(1 << 40), r.randrange(1, paragraph_dedup.SMALL + 6)))
            b = set(a)
            for _ in range(r.randrange(1, 4)):
                b ^= {r.choice([r.choice(sorted(a)), r.randrange(1 << 40)])}
            if not b or min(len(a), len(b)) > paragraph_dedup.SMALL or 100 * len(a & b) < percent * len(a | b) or a == b:
                continue
            items = np.array(sorted(a) + sorted(b), np.uint64)
            counts = np.array([len(a), len(b)])
            found, held = paragraph_dedup.tokens(items, np.cumsum(counts) - counts, counts, 8, 2, percent)
            assert set(found[: held[0]].tolist()) & set(found[held[0] :].tolist())
