"""Placement advice: skew by range, hot keys, split bounds; and what to do about them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalog import _ladder


def hot_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` keys with the most rows and their share of all rows; pre-aggregated, a top-n at the end."""
    total = df.agg(F.count("*").alias("_total"))  # one row
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc(key)).limit(n)
    return top.crossJoin(F.broadcast(total)).select(key, "n", F.round(F.col("n") / F.col("_total"), 9).alias("share"))


def _by_range(engine, table: str) -> DataFrame:
    r = engine.catalog.relation(table)
    ranges = sorted(engine.catalog.keyspaces[r.keyspace].ranges, key=lambda x: x.lo)
    return engine.owners(table).withColumn("range_no", _ladder(F.col("slot"), [(x.lo, i) for i, x in enumerate(ranges)]))


def rows_by_range(engine, table: str) -> DataFrame:
    """Rows and (estimated) bytes of each range and owner."""
    df = _by_range(engine, table)
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in engine.spark.table(table).columns), F.lit(0))
    return df.groupBy("range_no", "owner").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))


def split_bounds(engine, table: str, fraction: float = 0.5) -> DataFrame:
    """For each range the slot that ``fraction`` of its rows reach: equal slots are pre-aggregated, then one running count a range."""
    slots = _by_range(engine, table).groupBy("range_no", "slot").agg(F.count("*").alias("n"))
    w = Window.partitionBy("range_no")
    run = slots.withColumn("below", F.sum("n").over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.filter(F.col("below") >= F.ceil(F.col("all") * fraction)).groupBy("range_no").agg(F.min("slot").alias("bound"))


@dataclass(frozen=True)
class Settings:
    skew: float = 1.5  # a node's rows over the mean
    hot_share: float = 0.3  # a key's share of its range
    large_rows: int = 10_000_000
    reference_bytes: int = 16 << 20


@dataclass(frozen=True)
class Advice:
    what: str  # split, pin, move, add node, none
    table: str
    where: str
    why: str


def decide(table: str, nodes: dict[int, int], ranges: list[tuple[int, int, int]], hottest: dict[int, tuple[object, int]], settings: Settings = Settings()) -> list[Advice]:
    """Advice from rows by node, (range, owner, rows) and each range's hottest key with its rows. Pure."""
    total = sum(nodes.values())
    if not total or len(nodes) < 2:
        return []
    mean, out = total / len(nodes), []
    for node, rows in sorted(nodes.items(), key=lambda x: -x[1]):
        if rows <= settings.skew * mean:
            continue
        own = sorted((r for r in ranges if r[1] == node), key=lambda r: -r[2])
        target = min(nodes, key=lambda n: nodes[n])
        excess, best = rows - mean, own[0]
        key, count = hottest.get(best[0], (None, 0))
        if best[2] and count / best[2] >= settings.hot_share:
            out.append(Advice("pin", table, f"key {key} to node {target}", f"one key has {count / best[2]:.0%} of range {best[0]}'s rows, which no split divides"))
        elif best[2] > excess and best[2] > mean:
            out.append(Advice("split", table, f"range {best[0]}", f"node {node} has {rows / mean:.1f} times the mean, most of it in one range"))
        else:
            fitting = min(own, key=lambda r: abs(r[2] - excess))
            out.append(Advice("move", table, f"range {fitting[0]} to node {target}", f"node {node} has {rows / mean:.1f} times the mean"))
    if not out and mean > settings.large_rows:
        out.append(Advice("add node", table, "", f"nodes hold {mean:.0f} rows each"))
    return out


def advise(engine, table: str, settings: Settings = Settings()) -> list[Advice]:
    """``decide`` on a table's facts; what comes to the driver is a row for each range."""
    r = engine.catalog.relation(table)
    ranges = [(x["range_no"], x["owner"], x["n"]) for x in rows_by_range(engine, table).select("range_no", "owner", "n").collect()]
    keys = _by_range(engine, table).groupBy("range_no", r.key).agg(F.count("*").alias("n"))
    hottest = {x["range_no"]: (x["k"], x["n"]) for x in keys.groupBy("range_no").agg(F.max_by(r.key, F.struct("n", r.key)).alias("k"), F.max("n").alias("n")).collect()}
    nodes = {n.id: 0 for n in engine.catalog.nodes if n.state == "active"}
    for _, owner, n in ranges:
        nodes[owner] = nodes.get(owner, 0) + n
    return decide(table, nodes, ranges, hottest, settings)


@dataclass(frozen=True)
class Job:
    op: str
    state: str  # queued, running, done, failed
    by_hand: bool = False
    target: str = ""


def next_step(mode: str, advice: list[Advice], jobs: list[Job]) -> Advice | None:
    """What an autopilot does next: nothing while a job runs, after a failure, or on what was placed by hand. Pure."""
    if mode != "on" or any(j.state in ("queued", "running", "failed") for j in jobs):
        return None
    placed = {j.target for j in jobs if j.by_hand}
    return next((a for a in advice if a.what in ("split", "pin", "move") and a.table not in placed), None)
