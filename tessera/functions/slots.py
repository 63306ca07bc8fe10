"""Placement slots: the signed 64-bit hash of a distribution key.

The hash is the public lookup3 family that Postgres uses for its extended hash functions, so placements agree with tables
that were distributed by such a hash. Integers, dates and timestamps are hashed by plain Column arithmetic (code generation,
no Python); byte strings of any length (text, bpchar, uuid, bytea, numeric) by an Arrow UDF that works on whole batches.
``slot_of`` is the same for one value, for pins and literals.
"""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

MASK = 0xFFFFFFFF
# Fixed values of the hash: its start value and the rotations of its two rounds.
START = 0x9E3779B9 + 3923095
MIX = (4, 6, 8, 16, 19, 4)
FINAL = (14, 11, 25, 16, 4, 14, 24)

#: Key types and their other names.
KEY_TYPES = {
    "smallint": ("int2",), "integer": ("int", "int4"), "bigint": ("int8",), "numeric": ("decimal",), "text": (), "varchar": ("character varying",),
    "bpchar": ("char", "character"), "uuid": (), "bytea": (), "date": (), "timestamp": ("timestamp without time zone",), "timestamptz": ("timestamp with time zone",),
}
INTEGERS = {"smallint": 16, "integer": 32, "bigint": 64}
EPOCH_DAYS, EPOCH_MICROS = 10957, 946684800000000  # 2000-01-01


class KeyError_(ValueError):
    """A value that isn't of its key's type."""


def key_type(name: str) -> str:
    """The canonical name of a key type; ``numeric(p,s)`` isn't one, as its values are rounded on the way in."""
    low = " ".join(name.lower().split())
    for kind, others in KEY_TYPES.items():
        if low == kind or low in others:
            return kind
    raise KeyError_(f"{name} can't be a distribution key; take one of {', '.join(KEY_TYPES)}")


# One set of rounds serves numbers, numpy arrays and Columns: each gives add, subtract, exclusive or and rotate on 32 bits.


class _Ints:
    add = staticmethod(lambda a, b: (a + b) & MASK)
    sub = staticmethod(lambda a, b: (a - b) & MASK)
    xor = staticmethod(lambda a, b: a ^ b)
    rot = staticmethod(lambda a, k: (a << k | a >> 32 - k) & MASK)


class _Arrays:
    add = staticmethod(lambda a, b: a + b)
    sub = staticmethod(lambda a, b: a - b)
    xor = staticmethod(lambda a, b: a ^ b)
    rot = staticmethod(lambda a, k: a << np.uint32(k) | a >> np.uint32(32 - k))


class _Columns:
    add = staticmethod(lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))
    sub = staticmethod(lambda a, b: (a - b).bitwiseAND(F.lit(MASK)))
    xor = staticmethod(lambda a, b: a.bitwiseXOR(b))
    rot = staticmethod(lambda a, k: F.shiftleft(a, k).bitwiseOR(F.shiftright(a, 32 - k)).bitwiseAND(F.lit(MASK)))


def _mix(w, x, keep=lambda v: v):
    """Three words, stirred reversibly; word i takes from the word before it and moves into it."""
    x = list(x)
    for i, k in enumerate(MIX):
        own, before, after = i % 3, (i + 2) % 3, (i + 1) % 3
        x[own] = w.xor(w.sub(x[own], x[before]), w.rot(x[before], k))
        x[before] = w.add(x[before], x[after])
        x = keep(x)
    return x


def _final(w, x, keep=lambda v: v):
    """Three words, stirred so that every bit moves the last two."""
    x = list(x)
    for i, k in enumerate(FINAL):
        own, before = (i + 2) % 3, (i + 1) % 3
        x[own] = w.sub(w.xor(x[own], x[before]), w.rot(x[before], k))
        x = keep(x)
    return x


def _signed(b: int, c: int) -> int:
    v = b << 32 | c
    return v - (1 << 64) if v >> 63 else v


def slot_of_bytes(data: bytes, seed: int) -> int:
    """Slot of a byte string."""
    w, seed = _Ints, seed & ((1 << 64) - 1)
    x = [(START + len(data)) & MASK] * 3
    if seed:
        x = _mix(w, [w.add(x[0], seed >> 32), w.add(x[1], seed & MASK), x[2]])
    whole = max(0, (len(data)) // 12)
    for i in range(whole):
        x = _mix(w, [w.add(v, int.from_bytes(data[12 * i + 4 * k : 12 * i + 4 * k + 4], "little")) for k, v in enumerate(x)])
    x = [w.add(v, t) for v, t in zip(x, _tail(data[12 * whole :]))]
    _, b, c = _final(w, x)
    return _signed(b, c)


def _tail(rest: bytes) -> list[int]:
    """The last bytes as three words; the last word's low byte is the length's place."""
    return [int.from_bytes(rest[:4], "little"), int.from_bytes(rest[4:8], "little"), int.from_bytes(rest[8:], "little") << 8 & MASK]


def slot_of_word(word: int, seed: int) -> int:
    """Slot of one unsigned 32-bit word."""
    w, seed = _Ints, seed & ((1 << 64) - 1)
    x = [(START + 4) & MASK] * 3
    if seed:
        x = _mix(w, [w.add(x[0], seed >> 32), w.add(x[1], seed & MASK), x[2]])
    _, b, c = _final(w, [w.add(x[0], word & MASK), x[1], x[2]])
    return _signed(b, c)


def folded(value: int) -> int:
    """A 64-bit integer as the word that all integer widths share."""
    low, high = value & MASK, value >> 32 & MASK
    return low ^ (high if value >= 0 else ~high & MASK)


def numeric_parts(value: Decimal) -> tuple[list[int], int]:
    """Base-10000 digits without zeros at either end, and the power of 10000 of the first."""
    sign, digits, exponent = value.as_tuple()
    text = "".join(map(str, digits))
    fraction = max(0, -exponent)
    text = text + "0" * max(0, exponent)
    whole, part = (text[: len(text) - fraction], text[len(text) - fraction :].rjust(0)) if fraction <= len(text) else ("", text.rjust(fraction, "0"))
    whole = whole.rjust(-(-len(whole) // 4) * 4, "0")
    part = part.ljust(-(-len(part) // 4) * 4, "0")
    groups = [int((whole + part)[i : i + 4]) for i in range(0, len(whole + part), 4)]
    weight = len(whole) // 4 - 1
    while groups and groups[0] == 0:
        groups, weight = groups[1:], weight - 1
    while groups and groups[-1] == 0:
        groups = groups[:-1]
    return groups, weight


def slot_of_numeric(value: Decimal, seed: int) -> int:
    if not value.is_finite():
        return seed
    groups, weight = numeric_parts(value)
    if not groups:
        return seed - 1
    own = slot_of_bytes(b"".join(g.to_bytes(2, "little") for g in groups), seed)
    return _signed(*divmod((own ^ weight) & ((1 << 64) - 1), 1 << 32))


def canonical(kind: str, value: object) -> str:
    """One spelling for equal keys: 007 and 7, upper and lower case uuids, 1.0 and 1.00, padded and unpadded char(n)."""
    text = str(value)
    try:
        if kind in INTEGERS:
            number, bits = int(text.strip()), INTEGERS[kind]
            if not -(1 << bits - 1) <= number < 1 << bits - 1:
                raise KeyError_(f"{text} is out of range for {kind}")
            return str(number)
        if kind == "numeric":
            number = Decimal(text.strip())
            if not number.is_finite():
                return "NaN" if number.is_nan() else ("Infinity" if number > 0 else "-Infinity")
            plain = format(number.normalize() if number else Decimal(0), "f")
            return plain
        if kind == "uuid":
            bare = text.strip().strip("{}").replace("-", "")
            if not re.fullmatch(r"[0-9A-Fa-f]{32}", bare):
                raise KeyError_(f"{text} isn't a uuid")
            return str(uuid.UUID(bare))
        if kind == "date":
            return date.fromisoformat(text.strip()).isoformat()
        if kind in ("timestamp", "timestamptz"):
            return _moment(kind, text).isoformat(sep=" ")
    except (ValueError, InvalidOperation) as e:
        raise e if isinstance(e, KeyError_) else KeyError_(f"{text} isn't of type {kind}") from None
    return text.rstrip(" ") if kind == "bpchar" else text


def _moment(kind: str, text: str) -> datetime:
    at = datetime.fromisoformat(text.strip())
    if kind == "timestamptz":
        return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)
    return at.replace(tzinfo=None)


def slot_of(kind: str, value: object, seed: int) -> int:
    """Slot of one key value."""
    text = canonical(kind, value) if kind != "bytea" else ""
    if kind in INTEGERS:
        return slot_of_word(folded(int(text)), seed)
    if kind == "numeric":
        return slot_of_numeric(Decimal(text), seed)
    if kind == "uuid":
        return slot_of_bytes(uuid.UUID(text).bytes, seed)
    if kind == "bytea":
        return slot_of_bytes(bytes(value), seed)  # type: ignore[arg-type]
    if kind == "date":
        return slot_of_word((date.fromisoformat(text).toordinal() - date(2000, 1, 1).toordinal()) & MASK, seed)
    if kind in ("timestamp", "timestamptz"):
        at = _moment(kind, text).replace(tzinfo=timezone.utc) - datetime(2000, 1, 1, tzinfo=timezone.utc)
        return slot_of_word(folded((at.days * 86400 + at.seconds) * 1000000 + at.microseconds), seed)
    return slot_of_bytes(text.encode(), seed)


# -- Columns ---------------------------------------------------------------------------------------------------------------


def _assembled(b: Column, c: Column) -> Column:
    """Two words as a signed 64-bit number, without overflow on the way."""
    high = F.when(b >= F.lit(1 << 31), b - F.lit(1 << 32)).otherwise(b)
    return high * F.lit(1 << 32) + c


def _stirred_start(seed: int) -> list[int]:
    start, number = (START + 4) & MASK, seed & ((1 << 64) - 1)
    return _mix(_Ints, [_Ints.add(start, number >> 32), _Ints.add(start, number & MASK), start]) if number else [start] * 3


def word_slot(word: Column, seed: int | Column) -> Column:
    """Slot of a Column of unsigned 32-bit words; the three words are carried through higher-order functions, as each round
    uses them several times and one flat expression would grow beyond any bound, not least when a filter on it is pushed down."""
    word = word.cast("long").bitwiseAND(F.lit(MASK))
    there = word.isNotNull()
    if isinstance(seed, int):
        a, b, c = _stirred_start(seed)
        end = F.struct(_Columns.add(F.lit(a).cast("long"), word).alias("a"), F.lit(b).cast("long").alias("b"), F.lit(c).cast("long").alias("c"))
    else:
        there &= seed.isNotNull()
        start = F.lit((START + 4) & MASK).cast("long")
        plain = F.struct(*(start.alias(n) for n in _NAMES))
        high, low = F.shiftrightunsigned(seed, 32).bitwiseAND(F.lit(MASK)), seed.bitwiseAND(F.lit(MASK))
        stirred = F.struct(_Columns.add(start, high).alias("a"), _Columns.add(start, low).alias("b"), start.alias("c"))
        for i, k in enumerate(MIX):
            stirred = _step(stirred, _one_mix, i, k)
        end = _step(F.when(seed == 0, plain).otherwise(stirred), lambda s: F.struct(_Columns.add(s["a"], word).alias("a"), s["b"].alias("b"), s["c"].alias("c")))
    for i, k in enumerate(FINAL):
        end = _step(end, _one_final, i, k)
    return F.when(there, _step(end, lambda s: _assembled(s["b"], s["c"])))


def word_of(kind: str, key: Column) -> Column | None:
    """The 32-bit word of a key of a type that has one."""
    if kind in INTEGERS:
        return _folded(key.cast("long"))
    if kind == "date":
        return F.datediff(key.cast("date"), F.lit("2000-01-01").cast("date")).cast("long").bitwiseAND(F.lit(MASK))
    if kind in ("timestamp", "timestamptz"):  # the session's time zone is UTC
        return _folded(F.unix_micros(key.cast("timestamp")) - F.lit(EPOCH_MICROS))
    return None


_NAMES = ("a", "b", "c")


def _step(state: Column, f, *args) -> Column:
    """``f`` on ``state``, which is computed once."""
    return F.element_at(F.transform(F.array(state), lambda s: f(s, *args)), 1)


def _one_final(s: Column, i: int, k: int) -> Column:
    x = [s[n] for n in _NAMES]
    own, before = (i + 2) % 3, (i + 1) % 3
    x[own] = _Columns.sub(_Columns.xor(x[own], x[before]), _Columns.rot(x[before], k))
    return F.struct(*(v.alias(n) for v, n in zip(x, _NAMES)))


def _one_mix(s: Column, i: int, k: int) -> Column:
    x = [s[n] for n in _NAMES]
    own, before, after = i % 3, (i + 2) % 3, (i + 1) % 3
    x[own] = _Columns.xor(_Columns.sub(x[own], x[before]), _Columns.rot(x[before], k))
    x[before] = _Columns.add(x[before], x[after])
    return F.struct(*(v.alias(n) for v, n in zip(x, _NAMES)))


def _folded(v: Column) -> Column:
    low, high = v.bitwiseAND(F.lit(MASK)), F.shiftright(v, 32).bitwiseAND(F.lit(MASK))
    return low.bitwiseXOR(F.when(v >= 0, high).otherwise(F.bitwise_not(high).bitwiseAND(F.lit(MASK))))


def _bytes_slots(data: pd.Series, seeds: np.ndarray) -> np.ndarray:
    """Slots of many byte strings at once, grouped by length."""
    out = np.zeros(len(data), np.int64)
    lengths = data.map(len).to_numpy()
    w = _Arrays
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        size = int(size)
        padded = -(-(size + 1) // 12) * 12
        block = np.zeros((len(at), padded), np.uint8)
        if size:
            block[:, :size] = np.frombuffer(b"".join(data.iloc[at]), np.uint8).reshape(len(at), size)
        whole = size // 12
        rest = size - 12 * whole
        if rest > 8:  # the last word leaves its low byte free
            block[:, 12 * whole + 9 : 12 * whole + 12] = block[:, 12 * whole + 8 : 12 * whole + 11].copy()
            block[:, 12 * whole + 8] = 0
        words = block.view("<u4").astype(np.uint32)
        seed = seeds[at]
        x = [np.full(len(at), (START + size) & MASK, np.uint32) for _ in range(3)]
        stirred = _mix(w, [x[0] + (seed >> np.uint64(32)).astype(np.uint32), x[1] + (seed & np.uint64(MASK)).astype(np.uint32), x[2]])
        x = [np.where(seed != 0, s, v) for s, v in zip(stirred, x)]
        for i in range(whole):
            x = _mix(w, [v + words[:, 3 * i + k] for k, v in enumerate(x)])
        x = [v + words[:, 3 * whole + k] for k, v in enumerate(x)]
        _, b, c = _final(w, x)
        out[at] = (b.astype(np.uint64) << np.uint64(32) | c.astype(np.uint64)).view(np.int64)
    return out


@pandas_udf(LongType())
def _binary_slot(data: pd.Series, seed: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(data), dtype="Int64")
    there = data.notna().to_numpy() & seed.notna().to_numpy()
    if there.any():
        out[there] = _bytes_slots(data[there].map(bytes), seed[there].to_numpy(np.int64).view(np.uint64))
    return out


@pandas_udf(LongType())
def _numeric_slot(text: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or pd.isna(s) else slot_of_numeric(Decimal(t), int(s)) for t, s in zip(text, seed)], dtype="Int64")


def slot(kind: str, key: Column, seed: int | Column) -> Column:
    """Slot of a key Column; null keys have no slot."""
    kind = key_type(kind)
    word = word_of(kind, key)
    if word is not None:
        return word_slot(word, seed)
    by = F.lit(seed).cast("long") if isinstance(seed, int) else seed
    if kind == "numeric":
        return _numeric_slot(key.cast("string"), by)
    if kind == "bytea":
        return _binary_slot(key.cast("binary"), by)
    if kind == "uuid":
        return _binary_slot(F.unhex(F.regexp_replace(F.trim(key), "[{}-]", "")), by)
    return _binary_slot(F.encode(F.rtrim(key) if kind == "bpchar" else key, "UTF-8"), by)


def second_slot(kind: str, second: Column, first_slot: Column) -> Column:
    """Slot of a second key: its hash is seeded with the first key's slot, so one first key spreads over all slots."""
    return slot(kind, second, first_slot)


def second_slot_of(kind: str, second: object, first_slot: int) -> int:
    return slot_of(kind, second, first_slot)
