import random
from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import slots

# slots that are known from elsewhere: (type, value): (seed 0, seed 1)
KNOWN = {
    ("bigint", 0): (4154612158245552303, 434346878670890809), ("bigint", 1): (-3670598878359251130, -7620678293940249823), ("bigint", 42): (8010225493015854792, 3812564155960986560),
    ("bigint", -5): (-9082176226831438310, 7577986230592267202), ("bigint", 7): (-3288951424994980865, -3604598377573523768), ("text", ""): (-6939563903564495251, -150071773020461347),
    ("text", "tenant-1"): (-5960342201233910903, 1453456680727243884), ("text", "CA"): (923237629998376237, 6480974411818207586),
}


@pytest.mark.parametrize("key", KNOWN)
def test_known_slots(key):
    assert tuple(slots.slot_of(*key, seed) for seed in (0, 1)) == KNOWN[key]


@given(st.integers(-(1 << 15), (1 << 15) - 1), st.integers(0, 1 << 40))
def test_integer_widths_agree(v, seed):
    assert slots.slot_of("smallint", v, seed) == slots.slot_of("integer", v, seed) == slots.slot_of("bigint", v, seed)


def test_equal_spellings_have_one_slot():
    for kind, a, b in [("bigint", "007", "7"), ("numeric", "1.0", "1.00"), ("numeric", "1e2", "100"), ("bpchar", "CA ", "CA"), ("uuid", "{A0EEBC99-9C0B4EF8-BB6D6BB9BD380A11}", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11")]:
        assert slots.slot_of(kind, a, 3) == slots.slot_of(kind, b, 3) and slots.canonical(kind, a) == slots.canonical(kind, b)
    assert slots.slot_of("numeric", "0", 5) == 4 and slots.slot_of("numeric", "NaN", 5) == 5
    assert slots.numeric_parts(Decimal("12345.678")) == ([1, 2345, 6780], 1) and slots.numeric_parts(Decimal("0.00012")) == ([1, 2000], -1)


def test_types():
    assert slots.key_type("INT8") == "bigint" and slots.key_type("character varying") == "varchar"
    for bad in ("numeric(10,2)", "double", "json"):
        with pytest.raises(slots.KeyError_):
            slots.key_type(bad)
    for kind, bad in (("smallint", "40000"), ("uuid", "xyz"), ("date", "2024-13-01"), ("numeric", "abc")):
        with pytest.raises(slots.KeyError_):
            slots.canonical(kind, bad)


def test_columns_equal_single_values(spark):
    r = random.Random(1)
    ints = [0, 1, -1, 42, -(1 << 63), (1 << 63) - 1, None] + [r.randrange(-(1 << 63), 1 << 63) for _ in range(40)]
    for seed in (0, 1, -3, 1 << 35):
        df = spark.createDataFrame([(i,) for i in ints], "k long")
        rows = df.withColumn("c", slots.slot("bigint", F.col("k"), seed)).withColumn("d", slots.slot("bigint", F.col("k"), F.lit(seed).cast("long"))).collect()
        assert all(x.c == x.d == (None if x.k is None else slots.slot_of("bigint", x.k, seed)) for x in rows)
    words = [None, ""] + ["é" * n + "x" * m for n in range(8) for m in range(8)]
    df = spark.createDataFrame([(w,) for w in words], "k string")
    assert all(x.s == (None if x.k is None else slots.slot_of("text", x.k, 9)) for x in df.select("k", slots.slot("text", F.col("k"), 9).alias("s")).collect())
    typed = spark.sql("select date'2024-02-29' as d, timestamp_ntz'2024-02-29 12:34:56.789' as t, cast('123.4500' as decimal(20,4)) as n, 'a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11' as u, X'00ff10' as b, 'CA  ' as c")
    row = typed.select(*(slots.slot(k, F.col(c), 2).alias(c) for k, c in (("date", "d"), ("timestamp", "t"), ("numeric", "n"), ("uuid", "u"), ("bytea", "b"), ("bpchar", "c")))).first()
    want = [slots.slot_of(*x, 2) for x in (("date", "2024-02-29"), ("timestamp", "2024-02-29 12:34:56.789"), ("numeric", "123.45"), ("uuid", "a0eebc99-9c0b-4ef8-bb6d-6bb9bd380a11"), ("bytea", bytes.fromhex("00ff10")), ("bpchar", "CA"))]
    assert list(row) == want
