"""COPY FROM and TO: text and CSV by Spark's reader and writer, binary by a vectorised splitter.

Rows are split in parallel and typed by a declared schema; with an engine they get their owner and chunk, and a null key is an
error, as it has no owner.
"""

from __future__ import annotations

import re
import struct
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import Refusal

#: Escapes of the text format, signature of the binary one.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
SIGNATURE = b"PGCOPY\n\xff\r\n\0"


def unescaped(field: str | None, null: str = "\\N") -> str | None:
    """A field of the text format."""
    if field == null:
        return None
    if field is None or "\\" not in field:
        return field

    def one(m: re.Match) -> str:
        s = m.group(1)
        if s in ESCAPES:
            return ESCAPES[s]
        if s[0] == "x" and len(s) > 1:
            return chr(int(s[1:], 16))
        return chr(int(s, 8) & 0xFF) if s[0] in "01234567" else s

    return re.sub(r"\\(x[0-9A-Fa-f]{1,2}|[0-7]{1,3}|.)", one, field, flags=re.S)


def _plain(c: Column, null: str) -> Column:
    """``unescaped`` for fields without octal and hex escapes, by built-in functions."""
    out = F.regexp_replace(c, r"\\\\", "\x00")
    for letter, char in ESCAPES.items():
        out = F.regexp_replace(out, r"\\" + letter, char)
    return F.when(c == null, F.lit(None)).otherwise(F.translate(F.regexp_replace(out, r"\\(.)", "$1"), "\x00", "\\"))


def read_text(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = "\t", null: str = "\\N", header: bool = False) -> DataFrame:
    """COPY FROM in text format. A line ``\\.`` ends the data of a stream and is left out here; a row of the wrong width is an error."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.option("lineSep", "\n").text(path).filter("value <> '\\\\.'")
    if header:
        names = delimiter.join(f.name for f in fields)
        lines = lines.filter(F.col("value") != names)
    # a delimiter after an odd number of backslashes is part of its field
    cut = F.split("value", rf"(?<=(?<!\\)(?:\\\\){{0,64}}){re.escape(delimiter)}", -1)
    parts = lines.select(cut.alias("p"))
    checked = parts.select(F.when(F.size("p") == len(fields), F.col("p")).otherwise(F.raise_error(F.concat(F.lit(f"a row has not {len(fields)} columns: "), F.concat_ws(delimiter, "p")))).alias("p"))
    hard = F.udf(lambda x: unescaped(x, null), "string")
    value = lambda c: F.when(c.rlike(r"\\[0-7x]"), hard(c)).otherwise(_plain(c, null))
    return checked.select(*(value(F.col("p")[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",", quote: str = '"', escape: str | None = None, null: str = "", header: bool = False) -> DataFrame:
    """COPY FROM in CSV format: quoted fields may hold delimiters, quotes (doubled) and line ends; only unquoted ``null`` is null."""
    empty = "\x01empty"  # a quoted empty field, which the reader would otherwise take for null
    df = (spark.read.schema(schema).option("sep", delimiter).option("quote", quote).option("escape", escape or quote).option("nullValue", null).option("emptyValue", empty)
          .option("header", header).option("multiLine", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return df.select(*(F.when(F.col(f.name) == empty, "").otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema))


def write_text(df: DataFrame, path: str, delimiter: str = "\t", null: str = "\\N") -> None:
    """COPY TO in text format."""

    def field(name: str) -> Column:
        c = F.regexp_replace(F.col(name).cast("string"), r"\\", r"\\\\")
        for letter, char in ESCAPES.items():
            c = F.regexp_replace(c, re.escape(char), r"\\" + letter)
        if delimiter != "\t":
            c = F.regexp_replace(c, re.escape(delimiter), r"\\" + re.escape(delimiter))
        return F.coalesce(c, F.lit(null))

    df.select(F.concat_ws(delimiter, *map(field, df.columns)).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', null: str = "", header: bool = False) -> None:
    """COPY TO in CSV format; empty strings are quoted, so they differ from nulls."""
    df.write.option("sep", delimiter).option("quote", quote).option("escape", quote).option("nullValue", null).option("emptyValue", quote * 2).option("header", header).csv(path)


_WIDTH = {"smallint": ">h", "int": ">i", "bigint": ">q", "float": ">f", "double": ">d", "boolean": ">?"}


def _decoded(data: bytes, kind: str):
    if kind in _WIDTH:
        return struct.unpack(_WIDTH[kind], data)[0]
    if kind == "date":
        return date(2000, 1, 1) + timedelta(days=struct.unpack(">i", data)[0])
    if kind.startswith("timestamp"):
        return datetime(2000, 1, 1) + timedelta(microseconds=struct.unpack(">q", data)[0])
    if kind.startswith("decimal"):
        count, weight, sign, scale = struct.unpack(">HhHH", data[:8])
        digits = struct.unpack(f">{count}H", data[8:])
        total = sum(Decimal(d) * Decimal(10000) ** (weight - i) for i, d in enumerate(digits))
        return (-total if sign == 0x4000 else total).quantize(Decimal(1).scaleb(-scale))
    return bytes(data) if kind == "binary" else data.decode()


def split_binary(data: bytes, kinds: list[str]) -> list[tuple]:
    """Rows of one COPY binary file."""
    if data[:11] != SIGNATURE:
        raise Refusal("the data isn't in COPY binary format", "check the file's first bytes")
    at, rows = 19 + struct.unpack(">i", data[15:19])[0], []
    while True:
        count = struct.unpack(">h", data[at : at + 2])[0]
        at += 2
        if count == -1:
            return rows
        if count != len(kinds):
            raise Refusal(f"a row has {count} columns, not {len(kinds)}", "declare the file's columns")
        row = []
        for kind in kinds:
            size = struct.unpack(">i", data[at : at + 4])[0]
            at += 4
            row.append(None if size < 0 else _decoded(data[at : at + size], kind))
            at += max(0, size)
        rows.append(tuple(row))


def read_binary(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """COPY FROM in binary format; files are split in parallel, each by one task."""
    import pandas as pd

    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = [f.dataType.simpleString() for f in fields]

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(split_binary(bytes(content), kinds), columns=[f.name for f in fields])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, fields)


def dealt(engine, table: str, df: DataFrame) -> DataFrame:
    """Rows to be written, with slot, owner and chunk; a null key has no owner and is an error."""
    r = engine.catalog.relation(table)
    if r.kind != "sharded":
        return df
    key = F.coalesce(F.col(r.key), F.raise_error(F.lit(f"null key: {table}.{r.key}")).cast(df.schema[r.key].dataType))
    return engine.owners(table, df.withColumn(r.key, key))
