import struct
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tessera.errors import Refusal
from tessera.functions import compat
from tessera.operators import design, exact
from tessera.plans.engine import Engine
from tessera.queries import sample_catalog
from tessera.sources import copy
from tessera.streaming import streams


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    s = F.lit("hello world")
    cases = [
        (compat.strpos(s, F.lit("o")), 5), (compat.starts_with(s, F.lit("he")), True), (compat.concat_skip_nulls(F.lit("a"), F.lit(None), F.lit("b")), "ab"), (compat.left(s, -6), "hello"), (compat.left(s, 2), "he"),
        (compat.right(s, 5), "world"), (compat.right(s, -6), "world"), (compat.substr(s, 0, 3), "he"), (compat.substr(s, -1, 4), "he"), (compat.substr(s, 7), "world"), (compat.regexp_replace_first(s, "o", "0"), "hell0 world"),
        (compat.regexp_replace_first(s, "O", "0", "gi"), "hell0 w0rld"), (compat.regexp_match(s, "(h.)(l+)"), ["he", "ll"]), (compat.regexp_match(s, "z"), None), (compat.regexp_matches(s, "o"), ["o", "o"]),
        (compat.regexp_split_to_array(s, r"\s+"), ["hello", "world"]), (compat.string_to_array(F.lit("a.b..c"), ".", ""), ["a", "b", None, "c"]), (compat.array_to_string(F.array(F.lit("a"), F.lit(None), F.lit("c")), "-"), "a-c"),
        (compat.quote_literal(F.lit("it's")), "'it''s'"), (compat.quote_ident(F.lit("A b")), '"A b"'), (compat.quote_ident(F.lit("ab_1")), "ab_1"), (compat.format_("%s is %L in %I%%", F.lit("x"), F.lit(None), F.lit("T")), 'x is NULL in "T"%'),
        (compat.to_hex(F.lit(255)), "ff"), (compat.encode_hex(compat.decode_hex(F.lit("00ff"))), "00ff"),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [w for _, w in cases]


def test_number_time_json_and_array_functions(spark):
    t = F.lit("2024-03-03 13:45:10").cast("timestamp")
    j = F.lit('{"a": {"b": [1, 2]}, "c": null}')
    cases = [
        (compat.trunc(F.lit(-2.567), 1), -2.5), (compat.trunc(F.lit(2.9)), 2.0), (compat.log10(F.lit(100.0)), 2.0), (compat.div(F.lit(-7), F.lit(2)), -3), (compat.dow(t), 0), (compat.epoch(t), 1709473510.0),
        (compat.date_bin(900, t, F.lit("2024-01-01").cast("timestamp")).cast("string"), "2024-03-03 13:45:00"), (compat.to_char(t, 'YYYY-MM-DD "at" HH24:MI'), "2024-03-03 at 13:45"), (compat.age_days(t, F.lit("2024-03-02 13:45:10").cast("timestamp")), 1.0),
        (compat.json_path(j, "a", "b", 1), "2"), (compat.json_build_object(x=F.lit(1), y=F.lit(None).cast("string")), '{"x":1,"y":null}'), (compat.json_build_array(F.lit(1), F.lit(2)), "[1,2]"), (compat.json_typeof(F.lit(" [1]")), "array"),
        (compat.json_path_exists(j, "$.a.b"), True), (compat.jsonb_strip_nulls(j), '{"a": {"b": [1, 2]}}'), (compat.jsonb_set(j, ["a", "b", "0"], 9), '{"a": {"b": [9, 2]}, "c": null}'), (compat.jsonb_insert(j, ["a", "b", "1"], 7), '{"a": {"b": [1, 7, 2]}, "c": null}'),
        (compat.jsonb_pretty(F.lit('{"a": 1}')), '{\n    "a": 1\n}'), (compat.json_array_elements(F.lit("[1, \"x\"]")), ["1", "x"]), (compat.array_length(F.array()), None), (compat.array_length(F.array(F.lit(1))), 1), (compat.array_positions(F.array(F.lit(1), F.lit(2), F.lit(1)), F.lit(1)), [1, 3]),
        (compat.array_cat(F.array(F.lit(1)), F.array(F.lit(2))), [1, 2]), (compat.generate_series(F.lit(1), F.lit(7), F.lit(3)), [1, 4, 7]), (compat.generate_series(F.lit(5), F.lit(1), F.lit(1)), None), (compat.generate_subscripts(F.array(F.lit(4), F.lit(5))), [1, 2]),
    ]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(cases))).first()
    assert list(row) == [w for _, w in cases]


def test_registered_functions(spark):
    compat.register(spark)
    assert tuple(spark.sql("select strpos('abc', 'c'), to_hex(255), starts_with('abc', 'a'), array_to_string(array('a', 'b'), '-'), quote_literal('it''s')").first()) == (3, "ff", True, "a-b", "'it''s'")


def test_exact_numbers(spark):
    big = spark.createDataFrame([((1 << 62),)] * 4, "x long")
    assert big.agg(exact.dec_sum(F.col("x"), 0).alias("s")).first().s == Decimal(1 << 64)
    assert spark.createDataFrame([(1,), (2,), (2,)], "x long").agg(exact.dec_avg(F.col("x"), 0).alias("a")).first().a == Decimal("1.6666666666666667")
    with pytest.raises(Refusal):
        exact.float_total(F.col("x"), strict=True)


def test_nulls_order_and_ties(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 7), (5, None), (6, 5)], "k int, v int")
    assert [r.k for r in exact.ordered(df, ("v", False), ("k", False)).collect()] == [1, 3, 6, 4, 2, 5]
    assert [r.k for r in exact.ordered(df, ("v", True), ("k", False)).collect()] == [2, 5, 4, 1, 3, 6]
    for n in range(7):
        for desc in (False, True):
            rows = exact.ordered(df, ("v", desc), ("k", False)).collect()
            want = [r.k for r in rows if n and r.v in [x.v for x in rows[:n]]]
            assert sorted(r.k for r in exact.with_ties(df, n, ("v", desc)).collect()) == sorted(want)
    assert {(r.v, r.k) for r in exact.distinct_on(df, ["v"], ("k", True)).collect()} == {(5, 6), (None, 5), (7, 4)}
    with pytest.raises(Refusal):
        exact.top(df, -1, ("v", False))


def test_membership_has_three_values(spark):
    a = F.array(F.lit(1), F.lit(None))
    assert [one(spark, exact.is_member(F.lit(v).cast("int"), x)) for v, x in ((1, a), (2, a), (2, F.array(F.lit(1))), (None, a))] == [True, None, False, None]


def test_copy_text_round_trip(spark, tmp_path):
    rows = [(1, "tab\there", None), (2, "back\\slash", "\n\r"), (3, "", "plain"), (4, "\\N", "x")]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    copy.write_text(df, str(tmp_path / "t"))
    assert sorted(map(tuple, copy.read_text(spark, str(tmp_path / "t"), "k int, a string, b string").collect())) == rows
    (tmp_path / "hard").write_text("1\t\\101\\x42\\tz\n2\t\\N\n\\.\n")
    assert sorted(map(tuple, copy.read_text(spark, str(tmp_path / "hard"), "k int, a string").collect())) == [(1, "AB\tz"), (2, None)]
    (tmp_path / "short").write_text("1\n")
    with pytest.raises(Exception, match="has not 2 columns"):
        copy.read_text(spark, str(tmp_path / "short"), "k int, a string").collect()


def test_copy_csv_round_trip(spark, tmp_path):
    rows = [(1, 'quo"te', None), (2, "a,b", ""), (3, "two\nlines", "x")]
    copy.write_csv(spark.createDataFrame(rows, "k int, a string, b string"), str(tmp_path / "c"))
    assert sorted(map(tuple, copy.read_csv(spark, str(tmp_path / "c"), "k int, a string, b string").collect())) == rows


def test_copy_binary(spark, tmp_path):
    field = lambda b: struct.pack(">i", len(b)) + b
    data = copy.SIGNATURE + struct.pack(">ii", 0, 0)
    data += struct.pack(">h", 4) + field(struct.pack(">q", 42)) + field("é".encode()) + field(struct.pack(">i", 60)) + field(struct.pack(">HhHH2H", 2, 0, 0x4000, 2, 12, 3400))
    data += struct.pack(">h", 4) + struct.pack(">i", -1) * 4 + struct.pack(">h", -1)
    (tmp_path / "b").write_bytes(data)
    got = copy.read_binary(spark, str(tmp_path / "b"), "k bigint, s string, d date, n decimal(10,2)").collect()
    assert [tuple(r) for r in got] == [(42, "é", date(2000, 3, 1), Decimal("-12.34")), (None,) * 4]


def test_copy_deals_rows_and_refuses_null_keys(spark):
    e = Engine(spark, sample_catalog())
    df = spark.createDataFrame([(5, "x")], "o_orderkey long, v string")
    assert copy.dealt(e, "orders", df).first().owner == e.catalog.keyspaces["order"].owner(5)
    with pytest.raises(Exception, match="null key"):
        copy.dealt(e, "orders", spark.createDataFrame([(None, "x")], "o_orderkey long, v string")).collect()


def test_design():
    T, K = design.Table, design.ForeignKey
    tables = [T("tenants", {"id": "bigint"}, ("id",), 1 << 20), T("orders", {"tenant_id": "bigint", "id": "bigint", "country": "text"}, ("tenant_id", "id"), 1 << 30), T("countries", {"code": "text"}, ("code",), 1 << 10), T("log", {"id": "uuid", "x": "text"}, ("id",), 1 << 31)]
    keys = [K("orders", "tenant_id", "tenants", "id"), K("orders", "country", "countries", "code")]
    assert design.tenant(tables, keys) in (("tenants", "id"), ("countries", "code"))
    chosen = design.choose(tables, keys)
    assert chosen["log"] == ("sharded", "id") and chosen["orders"][0] == "sharded"
    placed = [T("a", {"k": "bigint", "x": "bigint"}, ("x",), kind="sharded", key="k"), T("b", {"k": "bigint"}, (), kind="sharded", key="z"), T("c", {"k": "bigint", "a": "bigint"}, ("a", "k"), 1, kind="global"), T("d", {"k": "text"}, ("k",), 1 << 34, kind="reference"), T("e", {"k": "bigint"}, ("k",), 1 << 34), T("f", {"k": "bigint", "e": "bigint"}, ("k",), kind="sharded", key="k")]
    codes = {(f.code, f.table) for f in design.check(placed, [K("c", "k", "f", "k"), K("f", "e", "c", "k")])}
    assert codes >= {("blocked", "a"), ("missing_key_column", "b"), ("no_primary_key", "b"), ("reference_large", "d"), ("big_on_home", "e"), ("fk_not_indexed", "c"), ("belongs_with", "c"), ("should_be_reference", "c")}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", "30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r.d, r.event_type): r.n for r in events.groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert {(r.start.date(), r.event_type): r.n for r in spark.table("counted").collect()} == want


def test_change_log_replay(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, "x", 1, "upsert"), (1, "y", 3, "upsert"), (2, None, 2, "delete"), (9, "n", 4, "upsert"), (1, "y", 3, "upsert")], "k int, v string, seq int, op string")
    want = [(1, "y"), (3, "c"), (9, "n")]
    assert sorted(map(tuple, streams.replayed(base, log, ["k"]).collect())) == want
    log.write.parquet(str(tmp_path / "log"))
    seen = []
    streams.replay(streams.read_changes(spark, str(tmp_path / "log"), "k int, v string, seq int, op string"), lambda b: seen.extend(map(tuple, streams.replayed(base, b, ["k"]).collect())), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == want
