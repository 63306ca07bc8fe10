"""Postgres-compatible scalars whose names Spark lacks or whose results differ; all are compositions of built-in functions.

Names as in Postgres; ``FUNCTIONS`` lists what an engine registers for use in SQL (``register``).
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def strpos(s: Column, part: Column) -> Column:
    return F.position(part, s)


def starts_with(s: Column, prefix: Column) -> Column:
    return F.startswith(s, prefix)


def concat_skip_nulls(*parts: Column) -> Column:
    """concat(): nulls count as empty."""
    return F.concat_ws("", *parts)


def left(s: Column, n: int) -> Column:
    """left(s, n); a negative n drops the last -n characters."""
    return F.substring(s, 1, n) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """right(s, n); a negative n drops the first -n characters."""
    return F.substring(s, F.greatest(F.length(s) - n + 1, F.lit(1)), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1 - n), F.length(s))


def substr(s: Column, start: int, count: int | None = None) -> Column:
    """substr with starts below 1: what lies before the text counts but isn't there."""
    if count is None:
        return F.substring(s, F.lit(max(1, start)), F.length(s))
    end = start + count
    return F.substring(s, F.lit(max(1, start)), F.lit(max(0, end - max(1, start))))


def regexp_replace_first(s: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """regexp_replace: the first match only, all with flag g; i ignores case."""
    pattern = ("(?i)" if "i" in flags else "") + pattern
    if "g" in flags:
        return F.regexp_replace(s, pattern, replacement)
    hit = F.regexp_extract(s, f"^((?:(?!{pattern})[\\s\\S])*)", 1)
    return F.when(s.rlike(pattern), F.concat(hit, F.regexp_replace(F.regexp_substr(s, F.lit(pattern)), pattern, replacement), F.substring(s, F.length(hit) + F.length(F.regexp_substr(s, F.lit(pattern))) + 1, F.length(s)))).otherwise(s)


def regexp_match(s: Column, pattern: str) -> Column:
    """The groups of the first match (the match itself if there are none); null without one."""
    groups = re.compile(pattern).groups
    found = F.array(*[F.regexp_extract(s, pattern, i) for i in (range(1, groups + 1) if groups else [0])])
    return F.when(s.rlike(pattern), found)


def regexp_matches(s: Column, pattern: str) -> Column:
    """An array of all matches' first groups (or whole matches); explode it for a row each."""
    return F.regexp_extract_all(s, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0))


def regexp_split_to_array(s: Column, pattern: str) -> Column:
    return F.split(s, pattern, -1)


def string_to_array(s: Column, separator: str, null: str | None = None) -> Column:
    parts = F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, re.escape(separator), -1))
    return F.transform(parts, lambda x: F.when(x != null, x)) if null is not None else parts


def array_to_string(a: Column, separator: str, null: str | None = None) -> Column:
    return F.array_join(a, separator, null) if null is not None else F.array_join(a, separator)


def quote_literal(s: Column) -> Column:
    doubled = F.replace(s, F.lit("'"), F.lit("''"))
    return F.when(F.contains(s, F.lit("\\")), F.concat(F.lit(" E'"), F.replace(doubled, F.lit("\\"), F.lit("\\\\")), F.lit("'"))).otherwise(F.concat(F.lit("'"), doubled, F.lit("'")))


def quote_ident(s: Column) -> Column:
    return F.when(s.rlike("^[a-z_][a-z0-9_]*$"), s).otherwise(F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"')))


def format_(pattern: str, *args: Column) -> Column:
    """format() with %s, %I, %L and %%."""
    parts, used = [], 0
    for piece in re.split(r"(%[sIL%])", pattern):
        if piece == "%%":
            parts.append(F.lit("%"))
        elif piece in ("%s", "%I", "%L"):
            a = args[used].cast("string")
            used += 1
            parts.append({"%s": F.coalesce(a, F.lit("")), "%I": quote_ident(a), "%L": F.coalesce(quote_literal(a), F.lit("NULL"))}[piece])
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def encode_hex(b: Column) -> Column:
    return F.lower(F.hex(b))


def decode_hex(s: Column) -> Column:
    return F.unhex(s)


def trunc(x: Column, places: int = 0) -> Column:
    """Towards zero."""
    size = F.lit(10**places)
    scaled = x * size
    return F.when(x >= 0, F.floor(scaled)).otherwise(F.ceil(scaled)) / size


def log10(x: Column) -> Column:
    """log(x): base 10 with one argument."""
    return F.log10(x)


def div(a: Column, b: Column) -> Column:
    """Integer quotient, towards zero."""
    return F.try_divide(a - a % b, b).cast("bigint")


def dow(t: Column) -> Column:
    """Day of the week, 0 on Sunday."""
    return F.dayofweek(t) - 1


def epoch(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(1e6)


def date_bin(seconds: int, t: Column, origin: Column) -> Column:
    """Start of the bin of ``seconds`` that holds t, counted from origin."""
    size = F.lit(seconds * 1000000)
    start, at = F.unix_micros(origin.cast("timestamp")), F.unix_micros(t.cast("timestamp"))
    return F.timestamp_micros(start + F.floor((at - start) / size).cast("bigint") * size)


def age_days(a: Column, b: Column) -> Column:
    """a - b in days and a part of a day."""
    return (F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / F.lit(86400e6)


#: Template patterns of to_char, longest first, and those of Spark's formatter.
TO_CHAR = (("YYYY", "yyyy"), ("HH24", "HH"), ("HH12", "hh"), ("Month", "MMMM"), ("Mon", "MMM"), ("DDD", "DDD"), ("Day", "EEEE"), ("Dy", "EEE"), ("MM", "MM"), ("DD", "dd"), ("MI", "mm"), ("SS", "ss"), ("MS", "SSS"), ("US", "SSSSSS"), ("YY", "yy"), ("AM", "a"), ("PM", "a"), ("Q", "q"))


def to_char(t: Column, template: str) -> Column:
    """to_char of timestamps; text in double quotes stands for itself."""
    known, out, at = dict(TO_CHAR), "", 0
    pattern = re.compile('"([^"]*)"|' + "|".join(k for k, _ in TO_CHAR))
    for m in pattern.finditer(template):
        out += template[at : m.start()].replace("'", "''") + (known[m.group()] if m.group(1) is None else "'" + m.group(1).replace("'", "''") + "'")
        at = m.end()
    return F.date_format(t, out + template[at:])


def timezone(zone: str, t: Column, has_zone: bool) -> Column:
    """timezone(zone, t): to local time for times with a zone, to an instant for times without."""
    return F.from_utc_timestamp(t, zone) if has_zone else F.to_utc_timestamp(t, zone)


# JSON


def json_path(j: Column, *path: str | int) -> Column:
    """jsonb_extract_path_text."""
    return F.get_json_object(j, "$" + "".join(f"[{p}]" if isinstance(p, int) else f"['{p}']" for p in path))


def json_build_object(**items: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in items.items())), {"ignoreNullFields": "false"})


def json_build_array(*items: Column) -> Column:
    return F.to_json(F.array(*items))


def json_agg(x: Column) -> Column:
    return F.to_json(F.collect_list(x))


def json_object_agg(k: Column, v: Column) -> Column:
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v))))


def json_array_elements(j: Column) -> Column:
    """Elements as text; explode it for a row each."""
    return F.from_json(j, "array<string>")


def json_each(j: Column) -> Column:
    """Entries (key, value as text); explode it for a row each."""
    return F.map_entries(F.from_json(j, "map<string,string>"))


def json_typeof(j: Column) -> Column:
    s = F.trim(j)
    return F.when(s.startswith("{"), "object").when(s.startswith("["), "array").when(s.startswith('"'), "string").when(s.isin("true", "false"), "boolean").when(s == "null", "null").when(s.rlike("^-?[0-9]"), "number")


def json_path_exists(j: Column, path: str) -> Column:
    return F.get_json_object(j, path).isNotNull()


def _changed(change, **form):
    """A JSON document by an Arrow UDF, where built-in functions can't write into documents."""
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: None if d is None else json.dumps(change(json.loads(d)), ensure_ascii=False, **form))

    return F.pandas_udf(run, "string")


def _strip(v):
    return {k: _strip(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [_strip(x) for x in v] if isinstance(v, list) else v


def _put(v, path: list, new, insert: bool, create: bool = True):
    if not path:
        return new
    head, rest = path[0], path[1:]
    if isinstance(v, dict):
        if not rest:
            return v if (insert and head in v) or (not insert and not create and head not in v) else v | {head: new}
        return v | {head: _put(v[head], rest, new, insert, create)} if head in v else v
    if isinstance(v, list):
        i = int(head)
        at = i if i >= 0 else len(v) + i
        if rest:
            return [*v[:at], _put(v[at], rest, new, insert, create), *v[at + 1 :]] if 0 <= at < len(v) else v
        if insert:
            at = max(0, min(at, len(v)))
            return [*v[:at], new, *v[at:]]
        return [*v[:at], new, *v[at + 1 :]] if 0 <= at < len(v) else ([*v, new] if i >= 0 else [new, *v]) if create else v
    return v


def jsonb_strip_nulls(j: Column) -> Column:
    return _changed(_strip)(j)


def jsonb_set(j: Column, path: list, new: object, create: bool = True) -> Column:
    return _changed(lambda d: _put(d, path, new, False, create))(j)


def jsonb_insert(j: Column, path: list, new: object) -> Column:
    return _changed(lambda d: _put(d, path, new, True))(j)


def jsonb_pretty(j: Column) -> Column:
    return _changed(lambda d: d, indent=4)(j)


# arrays


def array_length(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, F.size(a))


def array_lower(a: Column) -> Column:
    return F.when(F.size(a) > 0, F.lit(1))


array_upper = array_length


def array_positions(a: Column, v: Column) -> Column:
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i + 1)), lambda i: i.isNotNull())


def array_cat(a: Column, b: Column) -> Column:
    return F.concat(F.coalesce(a, F.array()), F.coalesce(b, F.array()))


def generate_subscripts(a: Column) -> Column:
    """Subscripts from 1; explode it for a row each."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))


def generate_series(lo: Column, hi: Column, step: Column) -> Column:
    """Values from lo to hi; explode it for a row each. Empty where the step leads away."""
    away = ((step > 0) & (lo > hi)) | ((step < 0) & (lo < hi))
    return F.when(~away, F.sequence(lo, hi, step))


#: SQL bodies of the functions that an engine registers: name, parameters, body.
FUNCTIONS = (
    ("strpos", "s string, p string", "instr(s, p)"),
    ("starts_with", "s string, p string", "startswith(s, p)"),
    ("to_hex", "n bigint", "lower(hex(n))"),
    ("array_to_string", "a array<string>, s string", "array_join(a, s)"),
    ("array_cat", "a array<string>, b array<string>", "concat(coalesce(a, array()), coalesce(b, array()))"),
    ("quote_literal", "s string", "concat('\\'', replace(s, '\\'', '\\'\\''), '\\'')"),
    ("gen_random_uuid", "", "uuid()"),
    ("isfinite", "t timestamp", "t is not null"),
    ("jsonb_array_length", "j string", "json_array_length(j)"),
    ("jsonb_extract_path_text", "j string, k string", "get_json_object(j, concat('$.', k))"),
)


def register(spark: SparkSession) -> None:
    """Temporary SQL functions under their Postgres names."""
    for name, parameters, body in FUNCTIONS:
        spark.sql(f"create or replace temporary function {name}({parameters}) return {body}")
