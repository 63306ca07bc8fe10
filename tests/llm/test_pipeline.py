import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import language

from .test_jaccard import brute
from .test_secrets import brute as spans


def test_stages_by_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    from pyspark.sql import functions as F

    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    part, parser = language.CrossParser(language.learn(docs, ~held_out)), language.CrossParser(language.learn(docs, F.lit(True)))
    told: dict = {}
    for r in docs.filter(held_out).filter("lang is not null").collect():
        (name,), _, bits, chars = part.predict([r.text])
        if name == r.lang:
            told.setdefault(name, []).append((bits[0], chars[0]))
    bound = {}
    for name, seen in told.items():
        total = sum(n for _, n in seen)
        mean = sum(b * n for b, n in seen) / total
        bound[name] = mean, (sum((b - mean) ** 2 * n for b, n in seen) / len(seen)) ** 0.5, total / len(seen)

    def fits(text):
        (name,), _, bits, chars = parser.predict([text])
        return name != "und" and bits[0] <= bound[name][0] + language.SPREADS * bound[name][1] / min(chars[0], bound[name][2]) ** 0.5

    rows = {d: t for d, t in rows.items() if fits(t)}
    rows = {d: rows[d] for d, _, c in brute(sorted(rows.items()), 5, 80) if d == c}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {d: t for d, t in rows.items() if not any(i in t for i in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    clean = [d for d, t in rows.items() if not spans(t)]
    assert clean and all(got[d].ids == library.encode(rows[d], add_special_tokens=False).ids for d in clean)
    for d in set(rows) - set(clean):
        assert "[SECRET]" in library.decode(got[d].ids)


def test_stages_keep_the_columns(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"), "/root/testdata/sf0.001")
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.collect()


def test_rows_that_share_a_doc_id_are_judged_by_their_texts(spark):
    x, y = (" ".join(f"{w}{k}" for k in range(30)) for w in "xy")
    docs = spark.createDataFrame([(1, x), (5, x), (5, y), (None, x)], "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, x), (5, y), (None, x)]))
