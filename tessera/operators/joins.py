"""Join strategies over placements: colocated, broadcast, repartition, gather; by size, under caps.

Catalyst joins whatever it is given; these operators choose what to send where when the catalog or a policy says more than
file sizes do. Broadcast happens only for a side whose size was checked against the cap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import Refusal


@dataclass(frozen=True)
class Caps:
    """Policy of data movement; 0 turns a strategy off."""

    broadcast_bytes: int = 64 << 20
    broadcast_rows: int = 100_000
    repartition_bytes: int = 1 << 60
    gather_rows: int = 1_000_000

    @staticmethod
    def of(spark) -> Caps:
        """Session settings tessera.join.* over the defaults."""
        read = lambda name, default: int(spark.conf.get(f"tessera.join.{name}", str(default)))
        base = Caps()
        return Caps(*(read(k, getattr(base, k)) for k in ("broadcast_bytes", "broadcast_rows", "repartition_bytes", "gather_rows")))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, caps: Caps) -> bool:
    """Whether a side may be sent to all: by the optimizer's estimate, or by counting at most one row past the cap."""
    if not caps.broadcast_rows or not caps.broadcast_bytes:
        return False
    return estimated_bytes(df) <= caps.broadcast_bytes and df.limit(caps.broadcast_rows + 1).count() <= caps.broadcast_rows


def choose(left: DataFrame, right: DataFrame, how: str, equi: bool, colocated: bool, caps: Caps) -> str:
    if colocated:
        return "colocated"
    if how in ("inner", "left", "left_semi", "left_anti", "cross") and small_enough(right, caps):
        return "broadcast right"
    if how in ("inner", "right") and small_enough(left, caps):
        return "broadcast left"
    if equi and caps.repartition_bytes and max(estimated_bytes(left), estimated_bytes(right)) <= caps.repartition_bytes:
        return "repartition"
    if caps.gather_rows and not equi and how in ("inner", "cross"):
        return "blocks"
    raise Refusal("no join strategy is left under the caps", "raise tessera.join.broadcast_rows or tessera.join.repartition_bytes")


def join(left: DataFrame, right: DataFrame, on: list[str] | object, how: str = "inner", colocated: bool = False, caps: Caps | None = None, strategy: str | None = None) -> DataFrame:
    """``left`` joined with ``right``; ``on`` is a list of shared columns or a condition. ``strategy`` overrides the choice."""
    caps = caps or Caps.of(left.sparkSession)
    equi = isinstance(on, list)
    chosen = strategy or choose(left, right, how, equi, colocated, caps)
    if chosen == "broadcast right":
        return left.join(F.broadcast(right), on, how)
    if chosen == "broadcast left":
        return F.broadcast(left).join(right, on, how)
    if chosen == "repartition" and equi:
        return left.hint("shuffle_merge").join(right, on, how)
    return left.join(right, on, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, hot: DataFrame | None = None) -> DataFrame:
    """Inner join whose hot keys (a table of ``on``; all keys if not given) are spread over ``salts`` parts.

    The left rows of a hot key take one salt each, by a hash of the row; the right rows of hot keys are repeated for each salt.
    """
    mark = lambda df: df.join(hot.select(*on).distinct().withColumn("_hot", F.lit(True)), on, "left") if hot is not None else df.withColumn("_hot", F.lit(True))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    many = mark(left).withColumn("_salt", salt).drop("_hot")
    each = mark(right).withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return many.join(each, [*on, "_salt"]).drop("_salt")


def not_in(left: DataFrame, right: DataFrame, column: str, other: str) -> DataFrame:
    """NOT IN with its nulls: a null among ``other`` leaves nothing; a null of ``column`` only stays if there are no others."""
    values = right.select(F.col(other).alias("_v"))
    state = values.agg(F.count("*").alias("_all"), F.count("_v").alias("_filled"))  # one row
    kept = left.join(values.filter("_v is not null").distinct(), left[column] == F.col("_v"), "left_anti")
    return kept.crossJoin(F.broadcast(state)).filter((F.col("_all") == 0) | ((F.col("_all") == F.col("_filled")) & F.col(column).isNotNull())).drop("_all", "_filled")
