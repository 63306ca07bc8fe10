"""The engine: statements in, DataFrames out, with routes, strictness and placed tables.

The route never changes an answer: a statement runs as Catalyst plans it, on the same tables, whatever the route says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog import Catalog
from tessera.errors import Refusal
from tessera.plans.facts import Facts, facts_of
from tessera.plans.route import Route, route

#: Statements that can't be split by owner; refused as soon as a sharded table is in them.
OPAQUE = ("merge", "call", "do", "prepare", "execute")


def statement_kind(sql: str) -> str:
    """select, insert, update, delete, copy, ddl, transaction, session or other, by the first word."""
    word = sql.lstrip(" \t\r\n(").split(None, 1)[0].lower().rstrip(";") if sql.strip(" ;\n") else "other"
    kinds = {"select": "select", "with": "select", "values": "select", "table": "select", "from": "select", "explain": "select"}
    kinds |= dict.fromkeys(("insert", "update", "delete", "copy"), "") | {w: w for w in ("insert", "update", "delete", "copy")}
    kinds |= dict.fromkeys(("create", "alter", "drop", "truncate", "comment", "analyze", "refresh"), "ddl")
    kinds |= dict.fromkeys(("begin", "commit", "rollback", "start", "savepoint", "end", "abort"), "transaction") | dict.fromkeys(("set", "reset", "show", "use", "discard"), "session")
    return kinds.get(word, "opaque" if word in OPAQUE else "other")


def read_only(sql: str) -> bool:
    return statement_kind(sql) == "select"


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog, strict: bool = False):
        self.spark, self.catalog, self.strict = spark, catalog, strict
        self._routes: dict[tuple[int, str], Route] = {}

    # tables

    def register(self, sf_dir: str, tables: list[str]) -> None:
        """Views over Parquet tables."""
        for t in tables:
            self.spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)

    def place(self, table: str, df: DataFrame, path: str) -> DataFrame:
        """Writes a sharded table dealt by chunk (a directory each), so statements that bind the key read one directory."""
        r = self.catalog.relation(table)
        ks = self.catalog.keyspaces[r.keyspace]
        dealt = ks.with_slot(df, F.col(r.key), F.col(r.second_key) if r.second_key else None)
        checked = dealt.withColumn("chunk_no", F.coalesce(ks.chunk_of(F.col("slot")), F.raise_error(F.lit(f"{table}.{r.key} is null"))).cast("int")).drop("slot")
        checked.repartition("chunk_no").write.partitionBy("chunk_no").parquet(path)
        return self.use_placed(table, path)

    def use_placed(self, table: str, path: str) -> DataFrame:
        df = self.spark.read.parquet(path)
        df.createOrReplaceTempView(table)
        return df

    def bucketed(self, table: str, df: DataFrame, buckets: int) -> DataFrame:
        """Saves a sharded table in buckets of its key: joins, groupings and windows on the key need no shuffle."""
        r = self.catalog.relation(table)
        df.write.bucketBy(buckets, r.key).sortBy(r.key).mode("overwrite").format("parquet").saveAsTable(f"{table}_placed")
        return self.spark.table(f"{table}_placed")

    def lookup(self, table: str, *values: object) -> DataFrame:
        """Rows of a placed table by key values: reads their chunks only."""
        r = self.catalog.relation(table)
        ks = self.catalog.keyspaces[r.keyspace]
        df = self.spark.table(table)
        if "chunk_no" in df.columns:
            df = df.filter(F.col("chunk_no").isin(*{ks.chunk_of_slot(ks.slot(v)) for v in values}))
        return df.filter(F.col(r.key).isin(*values))

    # statements

    def facts(self, df: DataFrame) -> Facts:
        return facts_of(df, self.catalog)

    def route(self, statement: str | DataFrame) -> Route:
        if isinstance(statement, str) and (self.catalog.epoch, statement) in self._routes:
            return self._routes[self.catalog.epoch, statement]
        df = self.spark.sql(statement) if isinstance(statement, str) else statement
        found = route(self.facts(df), self.catalog, self.strict)
        if isinstance(statement, str):
            if len(self._routes) >= 4096:
                self._routes.clear()
            self._routes[self.catalog.epoch, statement] = found
        return found

    def sql(self, statement: str, **args) -> DataFrame:
        kind = statement_kind(statement)
        if kind == "opaque" or kind == "other":
            raise Refusal(f"{statement.split(None, 1)[0].upper()} can't be split by owner", "use SELECT, INSERT, UPDATE, DELETE or COPY")
        if kind == "transaction":
            raise Refusal("there are no transactions of several statements", "each write job is atomic on its own")
        df = self.spark.sql(statement, args=args or None)
        if self.strict and kind == "select":
            self.route(df)
        return df

    def explain(self, statement: str) -> str:
        """The route, then Spark's plan."""
        df = self.spark.sql(statement)
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return f"{self.route(df)}\n{plan}"

    # ownership

    def owners(self, table: str, df: DataFrame | None = None) -> DataFrame:
        """The rows with their slot, owner and (if there are any) chunk."""
        r = self.catalog.relation(table)
        ks = self.catalog.keyspaces[r.keyspace]
        df = df if df is not None else self.spark.table(table)
        key, second = F.col(r.key), F.col(r.second_key) if r.second_key else None
        out = ks.with_slot(df, key, second).withColumn("owner", ks.owner_of(F.col("slot"), key))
        return out.withColumn("chunk_no", ks.chunk_of(F.col("slot"))) if ks.chunks else out
