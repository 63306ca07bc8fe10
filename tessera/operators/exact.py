"""Operators that keep answers exact, and those whose syntax Spark lacks, as compositions of built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.errors import Refusal


def dec_sum(x: Column, scale: int = 2) -> Column:
    """Exact sum: bigint sums past 64 bits and sums of numerics don't overflow or round."""
    return F.sum(x.cast(f"decimal({min(38, 20 + scale)},{scale})")).cast(f"decimal(38,{scale})")


def dec_avg(x: Column, scale: int = 2, digits: int = 16) -> Column:
    """Exact sum over count, rounded half away from zero to ``digits`` places (fewer for sums that leave less room)."""
    total, n = F.sum(x.cast(f"decimal({20 + scale},{scale})")), F.count(x)
    whole = F.floor(F.abs(total) / n).cast("decimal(21,0)")
    # long division: what is left over the whole part is divided on its own, in types whose quotient keeps its places
    rest = (F.abs(total) - whole * n).cast(f"decimal({18 + scale},{scale})")
    part = F.round(rest / n.cast("decimal(18,0)"), digits).cast(f"decimal({digits + 2},{digits})")
    size = whole + part
    return F.when(total < 0, -size).otherwise(size).cast(f"decimal(38,{digits})")


def float_total(x: Column, strict: bool = False) -> Column:
    """Sum of floats by way of decimals, as the order of additions would show; refused in strict mode."""
    if strict:
        raise Refusal("sum of real or double depends on the order of rows", "cast the column to numeric")
    return F.sum(x.cast("decimal(28,6)")).cast("decimal(38,6)")


def numeric_round(x: Column, places: int = 0) -> Column:
    """Half away from zero; negative places round before the point."""
    return F.round(x, places)


def ordered(df: DataFrame, *keys: tuple[str | Column, bool]) -> DataFrame:
    """Sorted by (column, descending) pairs with nulls as the greatest: last ascending, first descending."""
    return df.orderBy(*order_keys(*keys))


def order_keys(*keys: tuple[str | Column, bool]) -> list[Column]:
    cols = [(F.col(k) if isinstance(k, str) else k, desc) for k, desc in keys]
    return [c.desc_nulls_first() if desc else c.asc_nulls_last() for c, desc in cols]


def top(df: DataFrame, n: int, *keys: tuple[str | Column, bool], offset: int = 0) -> DataFrame:
    """LIMIT n OFFSET m under a sort; each task keeps n + m rows only."""
    if n < 0 or offset < 0:
        raise Refusal("LIMIT and OFFSET must not be negative", "give a number from 0")
    return ordered(df, *keys).offset(offset).limit(n)


def with_ties(df: DataFrame, n: int, *keys: tuple[str | Column, bool]) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES: the n-th row's keys come from a top-n, then one filter; no window over all rows."""
    if n <= 0:
        return df.limit(0)
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = df.select("*", *((F.col(k) if isinstance(k, str) else k).alias(name) for (k, _), name in zip(keys, names)))
    marks = [(name, desc) for name, (_, desc) in zip(names, keys)]
    bound = top(keyed.select(*names), n, *marks)
    # the last of the first n
    last = bound.orderBy(*[F.col(name).asc_nulls_last() if desc else F.col(name).desc_nulls_first() for name, desc in marks]).limit(1).select(*(F.col(c).alias(f"_b{c}") for c in names))
    reached = F.lit(True)
    for name, desc in reversed(marks):
        a, b = F.col(name), F.col(f"_b{name}")
        # nulls are the greatest
        before = (a.isNull() & b.isNotNull()) | (a > b) if desc else (b.isNull() & a.isNotNull()) | (a < b)
        reached = F.coalesce(before, F.lit(False)) | (a.eqNullSafe(b) & reached)
    return keyed.join(F.broadcast(last), on=F.coalesce(reached, F.lit(False)), how="left_semi").select(*df.columns)  # one row is sent


def distinct_on(df: DataFrame, on: list[str], *keys: tuple[str | Column, bool]) -> DataFrame:
    """DISTINCT ON: the first row by the keys of each group."""
    w = Window.partitionBy(*on).orderBy(*order_keys(*keys))
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ordered_string_agg(x: str, separator: str, by: str | None = None) -> Column:
    """string_agg(x, separator ORDER BY by); nulls are left out."""
    by = by or x
    parts = F.array_sort(F.collect_list(F.when(F.col(x).isNotNull(), F.struct(F.col(by).alias("k"), F.col(x).cast("string").alias("v")))))
    return F.array_join(F.transform(parts, lambda s: s["v"]), separator)


def ranked(df: DataFrame, column: str, order: list[str]) -> Column:
    """Rank of a column's values in a stated order (enums, own collations); others are null."""
    table = F.create_map(*[F.lit(x) for i, v in enumerate(order) for x in (v, i)])
    return table[df[column]]


def is_member(x: Column, array: Column) -> Column:
    """x = ANY(array), with its three values."""
    return F.when(x.isNull() | array.isNull(), F.lit(None).cast("boolean")).when(F.array_contains(array, x), True).when(F.exists(array, lambda v: v.isNull()), F.lit(None).cast("boolean")).otherwise(False)
