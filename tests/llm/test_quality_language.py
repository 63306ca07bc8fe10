import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from tessera.llm import language, quality
from tessera.llm.queries import QUERIES, fold


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(marked)


def test_counts_equal_brute_force(spark, small, odd):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for docs in (small, odd):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.assess(docs, labels).collect()), key=str)
        assert got == sorted(((r.doc_id, *base(r.text)) for r in docs.collect()), key=str)


def test_score_equals_brute_force(spark, small):
    import math

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trusted = {r.doc_id for r in labels.filter("quality = 1 and toxic = 0").collect()}
    rows = [(r.doc_id, r.text or "") for r in small.collect()]
    words, raw, target = quality.Words(), Counter(), Counter()
    grams = {d: quality.buckets_of(words.hashes[n], 16).tolist() if len(n) else [] for d, t in rows for n in words.number([t.lower().encode().split()])}
    for d, g in grams.items():
        raw.update(g)
        if d in trusted:
            target.update(g)
    size = 1 << 16
    weight = lambda b: math.log((target[b] + 1) / (sum(target.values()) + size)) - math.log((raw[b] + 1) / (sum(raw.values()) + size))
    got = {r.doc_id: r.score for r in quality.assess(small, labels).collect()}
    for d, g in grams.items():
        assert got[d] is None if not g else abs(got[d] - sum(map(weight, g)) / len(g)) < 1e-9


def test_quality_keeps_good_and_drops_bad(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    joined = quality.assess(docs, labels).join(labels, "doc_id").filter("n_words >= 50")
    share = {(r.quality): r.s for r in joined.groupBy("quality").agg(F.avg(F.col("enough").cast("int")).alias("s")).collect()}
    assert share[1] > 0.97 and share[0] < 0.1


def test_quality_keeps_good_documents_it_has_not_seen(spark):
    """Trusted documents of one half set the threshold; good ones of the other half aren't in the target."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    joined = quality.assess(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").filter("n_words >= 50 and toxic = 0")
    share = {r.quality: r.s for r in joined.groupBy("quality").agg(F.avg(F.col("enough").cast("int")).alias("s")).collect()}
    assert share[1] > 0.95 and share[0] < 0.1


def test_threshold_equals_brute_force(spark, small):
    import numpy as np

    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    trusted, docs = quality.trusted_ids(labels), small.select("doc_id", "text")
    fold = {r.doc_id: r.fold for r in trusted.collect()}
    counts = quality.count(docs, trusted, 12)
    words, grams = quality.Words(), {}
    for r in small.collect():
        for x in words.number([(r.text or "").lower().encode().split()]):
            grams[r.doc_id] = quality.buckets_of(words.hashes[x], 12).astype(int).tolist() if len(x) else []
    raw = np.bincount([b for g in grams.values() for b in g], minlength=1 << 12)
    assert counts[0].tolist() == raw.tolist()
    scores = []
    for d, k in fold.items():
        if grams.get(d):
            target = np.bincount([b for e, g in grams.items() if fold.get(e, k) != k for b in g], minlength=1 << 12)
            scores.append((np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum()))[grams[d]].mean())
    assert abs(quality.threshold(docs, trusted, counts, 0.05) - np.quantile(scores, 0.05)) < 1e-9


def test_all_trusted_documents_count(spark, monkeypatch):
    """More good labels than were once taken, by a broadcast and by a shuffle."""
    n = 20_500
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    docs = spark.range(n).selectExpr("id as doc_id", "concat('a', id % 7, ' b', id % 5, if(id % 1000 = 3, ' rare', '')) as text")
    trusted = quality.trusted_ids(labels).cache()
    assert trusted.count() == n
    got = []
    for most in (quality.BROADCAST_IDS, 10):
        monkeypatch.setattr(quality, "BROADCAST_IDS", most)
        counts = quality.count(docs, trusted, 12)
        assert counts[0].sum() == counts[1:].sum() == 3 * n + 2 * 21
        got.append((counts.tolist(), quality.threshold(docs, trusted, counts, 0.01)))
    assert got[0] == got[1]


def test_quantile_is_exact(spark):
    import random

    import numpy as np

    r = random.Random(2)
    for values in ([1.5], [0.25, 0.25, -3.0], [r.gauss(0, 1) for _ in range(500)], [r.randrange(3) / 7 for _ in range(200)], [r.random() / 9000 for _ in range(99)]):
        scores = spark.createDataFrame([(x,) for x in values], "score double")
        for share in (0.0, 0.01, 0.37, 1.0):
            assert abs(quality.quantile(scores, share) - np.quantile(values, share)) < 1e-12
    assert quality.quantile(spark.createDataFrame([], "score double"), 0.5) == float("-inf")


def test_registered_quality_query(spark):
    sf = "/root/testdata/sf0.001"
    score = {r.doc_id: r.enough for r in quality.assess(*(spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))).collect()}
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_quality_ratio"](spark, sf).collect():
        n, *_, again = base(rows[r.doc_id])
        assert r.base_failed == (n < 50 or 100 * again > 50 * n) and r.kept == (not r.base_failed and score[r.doc_id])


def test_quality_without_labels_or_documents(spark, small, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.assess(small, none).filter("n_words > 0 and not enough").count() == 0
    assert quality.assess(empty, none).collect() == []


def test_automaton_parses_greedily():
    text = "abracadabra\x00alakazam"
    automaton = language.SuffixAutomaton(text)
    for word in ("abra", "abracadabrax", "zzz", "kazamabra", "", "qabraq"):
        n, rest = 0, word
        while rest:
            size = next((k for k in range(len(rest), 0, -1) if rest[:k] in text), 1)
            n, rest = n + 1, rest[size:]
        assert automaton.phrases(word) == n


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labelled = language.learn(docs, fold() != 2)
    got = {r.doc_id: r for r in language.identify(docs, labelled).collect()}
    held = [r for r in docs.collect() if crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(spark, odd, empty):
    labelled = language.learn(odd, F.lit(True))
    got = language.identify(odd, labelled).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.learn(empty, F.lit(True)) == {} and language.identify(empty, labelled).collect() == []
    kept = language.accepted(odd, labelled, language.limits(odd, F.lit(True), labelled))
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})
    kept = language.accepted(odd, labelled, {})
    assert kept.columns == odd.columns and {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect()})


def test_an_unlearned_language_goes_and_learned_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for out in ("de", "fr"):
        rest = docs.filter(F.col("lang") != out)
        labelled = language.learn(rest, fold() != 2)
        kept = language.accepted(docs, labelled, language.limits(rest, fold() == 2, labelled))
        share = {r.other: r.n / r.held for r in docs.groupBy((F.col("lang") == out).alias("other")).agg(F.count("*").alias("held")).join(kept.groupBy((F.col("lang") == out).alias("other")).agg(F.count("*").alias("n")), "other").collect()}
        assert share.get(True, 0) < 0.25 and share[False] > 0.99


def test_limits_are_of_all_held_out_documents(spark):
    """2,000 documents of each language, more than a sample ever took; the far ones are few."""
    words = {"en": ["the", "water", "house", "nothing", "light"], "de": ["wasser", "häuser", "nichts", "licht", "über"]}
    text = lambda lang, i: " ".join(words[lang][(i * k + k) % 5] for k in range(1, 4 + i % 7)) + (" qx" * 3 if i % 401 == 7 else "")
    docs = spark.createDataFrame([(2 * i + k, text(lang, i), lang) for i in range(2_000) for k, lang in enumerate(words)], "doc_id long, text string, lang string")
    labelled = {lang: "\x00" + "\x00".join(w) + "\x00" for lang, w in words.items()}
    got = language.limits(docs, F.lit(True), labelled)
    parser = language.CrossParser(labelled)
    for lang in words:
        names, _, bits, chars = parser.predict([text(lang, i) for i in range(2_000)])
        told = [(b, n) for x, b, n in zip(names, bits.tolist(), chars.tolist()) if x == lang]
        total = sum(n for _, n in told)
        mean = sum(b * n for b, n in told) / total
        want = mean, (sum((b - mean) ** 2 * n for b, n in told) / len(told)) ** 0.5, total / len(told)
        assert all(abs(x - y) < 1e-6 for x, y in zip(got[lang], want)), (got[lang], want)


def test_few_documents_give_all_it_takes(spark):
    text = " ".join(f"{a}{b}" for a in ("uno", "dos", "tres", "cuatro") for b in map(chr, range(97, 123))) * 40
    docs = spark.createDataFrame([(i, text, "es") for i in range(3)] + [(9, "one two three", "en")], "doc_id long, text string, lang string")
    got = language.learn(docs, F.lit(True), most_chars=9_000)
    assert len(got["es"]) >= 9_000 and len(got["en"]) == 15
    assert len(language.learn(docs, F.lit(True), most_docs=1, most_chars=30_000, of_one=500)["es"]) <= 10_002
