import math
import random
from collections import Counter

from tessera.llm import decontaminate


def known_of(items):
    split = [ws for ws in (decontaminate.words_of(t) for _, t in items) if ws]
    return Counter(w for ws in split for w in set(ws)), len(split), sum(map(len, split))


def plainly(items, index, texts, n, least_score, least_overlap):
    """Every item scored for every window by the formula, without an index."""
    df, total, words = known_of(items)
    idf = {w: math.log1p((total - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    longest = {i: part.longest for part in index.classes for i in range(part.at, part.at + int(part.item.max()) + 1)}
    order = sorted(((i, decontaminate.words_of(t), t) for i, t in items), key=lambda x: (len(x[1]), x[0]))
    out = []
    for text in texts:
        said, best = decontaminate.words_of(text or ""), {}
        for at, (item, ws, raw) in enumerate(order):
            tf = Counter(ws)
            impact = {w: idf[w] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(ws) * total / words)) for w, c in tf.items()}
            parts = [len(decontaminate.question_and_answer(raw)[0])]
            for start in range(0, len(said), longest[at]):
                window = said[start : start + 2 * longest[at]]
                score = sum(impact[w] for w in set(window) if w in impact) / sum(impact.values())
                if score < least_score - 1e-6:
                    continue
                has = lambda a, b: any(window[i : i + b - a] == ws[a:b] for i in range(len(window)))  # noqa: B023, E731
                runs = [(i, i + min(n, len(ws))) for i in range(len(ws) - min(n, len(ws)) + 1)] + [(a, b) for a, b in ((0, parts[0]), (parts[0], len(ws))) if 0 < b - a < n]
                inside = {k for a, b in runs if has(a, b) for k in range(a, b)}
                q = len([k for k in inside if k < parts[0]]) / parts[0] if parts[0] else 1.0
                a = len([k for k in inside if k >= parts[0]]) / (len(ws) - parts[0]) if len(ws) > parts[0] else 1.0
                if q >= least_overlap and a >= least_overlap:
                    best[item] = max(best.get(item, (0, 0, 0)), (round(score, 4), round(q, 6), round(a, 6)))
        out.append(best)
    return out


def test_wand_finds_all_that_score(spark):
    """Scores and overlaps of all items for all windows of random texts with items, whole and changed, in them."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(300)]
    often = [1 / (k + 2) for k in range(300)]
    some = lambda k: rng.choices(vocabulary, often, k=k)
    items = [(i, " ".join(some(rng.randint(1, 40))) + rng.choice(["", ". " + " ".join(some(rng.randint(1, 12))) + "."])) for i in range(150)]
    texts = [None, "", " - "]
    for _ in range(40):
        said = some(rng.randint(0, 150))
        for _, t in rng.sample(items, 3):
            ws = t.split()
            if rng.random() < 0.6:
                ws[rng.randrange(len(ws))] = "changed"
            cut = rng.randint(0, len(said))
            said[cut:cut] = ws
        texts.append(" ".join(said))
    index = decontaminate.Index(items, 3, known_of(items))
    for least_score, least_overlap in ((0.6, 0.6), (0.3, 0.2)):
        got = decontaminate.Searcher(index, least_score, least_overlap)(texts)
        want = plainly(items, index, texts, 3, least_score, least_overlap)
        assert sum(map(len, want)) > 100
        assert [{f[0]: (round(f[1], 4), round(f[2], 6), round(f[3], 6)) for f in found} for found in got] == want


def test_pivots_skip_blocks_and_the_index_grows_with_its_postings():
    rng = random.Random(3)
    make = lambda count: [(i, " ".join(["the", "of", "and"] + [f"t{rng.randrange(20 * count)}" for _ in range(12)])) for i in range(count)]
    held = {}
    for count in (2000, 8000):
        items = make(count)
        index = decontaminate.Index(items, 3, known_of(items))
        held[count] = sum(x.nbytes for part in index.classes for x in vars(part).values() if hasattr(x, "nbytes"))
        assert held[count] < 100 * sum(map(len, (t.split() for _, t in items)))
        part = index.classes[0]
        said = ["the", "of", "and"] + items[count // 2][1].split()[3:]
        lists = decontaminate.np.searchsorted(part.terms, sorted({index.terms[w] for w in said}))
        visited = sum(len(rows) for rows, *_ in part.pivots(lists, decontaminate.np.array([len(lists)]), 0.6))
        assert 1 <= visited <= 3 < part.blocks
    assert held[8000] < 5 * held[2000]


def test_planted_items_are_found_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    texts = {r.item_id: r.text for r in items.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want and got == want
    in_parts = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, most_bytes=2000).collect()}
    assert in_parts == want
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "The quick brown fox jumps over the lazy dog near the old river bank"), (3, "The quick brown fox jumps over the lazy dog near the old river bank"), (None, "x")], "item_id long, text string")
    got = decontaminate.leaks(odd, items).collect()
    assert {r.doc_id for r in got} == {4, 5, None, -9}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(odd, none).collect() == [] and decontaminate.leaks(empty, items).collect() == []
    assert decontaminate.clean(odd, none).count() == odd.count()


def test_items_with_a_null_id_count(spark):
    text = "What is the name of the small river behind the old mill? It is the Wend."
    docs = spark.createDataFrame([(1, f"some words before. {text} some words after."), (2, "nothing of it here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, text), (7, "Which bird sings at night in the garden of roses? The nightingale does.")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()] == [(1, None)]
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [2]
