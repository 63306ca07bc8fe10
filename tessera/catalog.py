"""Placement catalog: nodes (shard owners), key spaces, relations; immutable, one snapshot an epoch.

A *sharded* table's rows belong to the owner of their key's slot; *reference* tables are whole everywhere (joined by
broadcast); *global* tables, and all that aren't listed, are plain. Tables of one key space are colocated on their keys.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tessera.functions import slots

LEAST, MOST = -(1 << 63), (1 << 63) - 1
DEFAULT_CHUNKS, MOST_CHUNKS = 64, 4096
STRATEGIES = ("hash", "range", "list", "schema")


class CatalogError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    id: int
    name: str
    home: bool = False
    state: str = "active"  # joining, active, draining, removed


@dataclass(frozen=True)
class Range:
    lo: int
    hi: int
    node: int


@dataclass(frozen=True)
class Pin:
    value: str
    node: int


@dataclass(frozen=True)
class Chunk:
    no: int
    lo: int
    hi: int


def even_ranges(count: int, nodes: list[int]) -> tuple[Range, ...]:
    """``count`` ranges of one width over all slots, dealt to the nodes in turn; the last takes what division leaves."""
    if count < 1 or not nodes:
        raise CatalogError("a key space needs at least one range and one node")
    width = ((1 << 64) - 1) // count
    return tuple(Range(LEAST + i * width, MOST if i == count - 1 else LEAST + (i + 1) * width - 1, nodes[i % len(nodes)]) for i in range(count))


def even_chunks(count: int = DEFAULT_CHUNKS) -> tuple[Chunk, ...]:
    if count & (count - 1) or not 1 <= count <= MOST_CHUNKS:
        raise CatalogError(f"chunks are a power of two, {MOST_CHUNKS} at most")
    width = (1 << 64) // count
    return tuple(Chunk(i, LEAST + i * width, LEAST + (i + 1) * width - 1) for i in range(count))


def halved(chunk: Chunk, number: int) -> tuple[Chunk, Chunk]:
    """A chunk's halves; the upper one takes a new number."""
    if chunk.lo == chunk.hi:
        raise CatalogError(f"chunk {chunk.no} is one slot")
    middle = chunk.lo + (chunk.hi - chunk.lo) // 2
    return Chunk(chunk.no, chunk.lo, middle), Chunk(number, middle + 1, chunk.hi)


@dataclass(frozen=True)
class Keyspace:
    name: str
    key_type: str
    seed: int
    ranges: tuple[Range, ...]
    pins: tuple[Pin, ...] = ()
    chunks: tuple[Chunk, ...] = ()
    second_type: str | None = None
    strategy: str = "hash"

    def slot(self, value: object, second: object = None) -> int:
        own = slots.slot_of(self.key_type, value, self.seed)
        return own if second is None or not self.second_type else slots.second_slot_of(self.second_type, second, own)

    def owner_of_slot(self, slot: int) -> int:
        ordered = sorted(self.ranges, key=lambda r: r.lo)
        return ordered[bisect_right([r.lo for r in ordered], slot) - 1].node

    def owner(self, value: object, second: object = None) -> int:
        text = slots.canonical(self.key_type, value) if self.key_type != "bytea" else None
        for p in self.pins:
            if p.value == text:
                return p.node
        return self.owner_of_slot(self.slot(value, second))

    def chunk_of_slot(self, slot: int) -> int:
        ordered = sorted(self.chunks, key=lambda c: c.lo)
        if not ordered:
            raise CatalogError(f"key space {self.name} has no chunks")
        return ordered[bisect_right([c.lo for c in ordered], slot) - 1].no

    # Columns

    def slot_column(self, key: Column, second: Column | None = None) -> Column:
        own = slots.slot(self.key_type, key, self.seed)
        return own if second is None or not self.second_type else slots.second_slot(self.second_type, second, own)

    def canonical_column(self, key: Column) -> Column:
        if self.key_type == "uuid":
            bare = F.lower(F.regexp_replace(F.trim(key), "[{}-]", ""))
            return F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
        return F.rtrim(key) if self.key_type == "bpchar" else key.cast("string")

    def owner_of(self, slot: Column, key: Column) -> Column:
        """Owner of each key, given its slot: pins first, then a balanced search through the ranges; null keys have none."""
        out = slots._step(slot, lambda s: _ladder(s, sorted((r.lo, r.node) for r in self.ranges)))
        for p in reversed(self.pins):
            out = F.when(self.canonical_column(key) == p.value, F.lit(p.node)).otherwise(out)
        return F.when(key.isNotNull(), out)

    def chunk_of(self, slot: Column) -> Column:
        ordered = sorted((c.lo, c.no) for c in self.chunks)
        size = len(ordered)
        if size > 1 and not size & (size - 1) and ordered == [(c.lo, c.no) for c in even_chunks(size)]:
            # equal chunks are the slot's high bits
            return F.shiftrightunsigned(slot.bitwiseXOR(F.lit(LEAST)), 65 - size.bit_length()).cast("int")
        return slots._step(slot, lambda s: _ladder(s, ordered))

    def with_slot(self, df, key: Column, second: Column | None = None):
        """``df`` with the column ``slot``."""
        return df.withColumn("slot", self.slot_column(key, second))

    def owner_column(self, key: Column, second: Column | None = None) -> Column:
        return self.owner_of(self.slot_column(key, second), key)

    def chunk_column(self, key: Column, second: Column | None = None) -> Column:
        return self.chunk_of(self.slot_column(key, second))

    def owns_column(self, node: int, key: Column, second: Column | None = None) -> Column:
        """Whether ``node`` owns each row: its ranges and pins, without what others have pinned."""
        mine_of = lambda s: reduce(or_, (s.between(r.lo, r.hi) for r in self.ranges if r.node == node), F.lit(False))
        own = slots._step(self.slot_column(key, second), mine_of)
        mine, others = ([p.value for p in self.pins if (p.node == node) == x] for x in (True, False))
        form = self.canonical_column(key)
        if others:
            own = own & ~form.isin(*others)
        if mine:
            own = own | form.isin(*mine)
        return F.coalesce(own, F.lit(False))


def _ladder(slot: Column, bounds: list[tuple[int, int]]) -> Column:
    """Value of the last bound at or below ``slot``, by halving."""
    if len(bounds) == 1:
        return F.lit(bounds[0][1])
    middle = len(bounds) // 2
    return F.when(slot < F.lit(bounds[middle][0]), _ladder(slot, bounds[:middle])).otherwise(_ladder(slot, bounds[middle:]))


@dataclass(frozen=True)
class Relation:
    name: str
    kind: str  # sharded, reference, global
    keyspace: str | None = None
    key: str | None = None
    second_key: str | None = None


@dataclass(frozen=True)
class Catalog:
    epoch: int = 0
    nodes: tuple[Node, ...] = ()
    keyspaces: dict[str, Keyspace] = field(default_factory=dict)
    relations: dict[str, Relation] = field(default_factory=dict)

    def relation(self, name: str) -> Relation:
        return self.relations.get(name.lower(), Relation(name.lower(), "global"))

    @property
    def home(self) -> int:
        return next((n.id for n in self.nodes if n.home), self.nodes[0].id if self.nodes else 0)

    def owner(self, keyspace: str, value: object, second: object = None) -> int:
        if keyspace not in self.keyspaces:
            raise CatalogError(f"no key space {keyspace}")
        return self.keyspaces[keyspace].owner(value, second)

    def colocated(self, a: str, b: str) -> bool:
        x, y = self.relation(a), self.relation(b)
        return x.kind == y.kind == "sharded" and x.keyspace == y.keyspace

    def changed(self, **parts) -> Catalog:
        """The next epoch's catalog, validated."""
        new = replace(self, epoch=self.epoch + 1, **parts)
        new.validate()
        return new

    def validate(self) -> None:
        ids = [n.id for n in self.nodes]
        if len(set(ids)) != len(ids) or len({n.name for n in self.nodes}) != len(ids):
            raise CatalogError("two nodes share an id or a name")
        if sum(n.home for n in self.nodes) > 1:
            raise CatalogError("more than one home node")
        live = {n.id for n in self.nodes if n.state != "removed"}
        for ks in self.keyspaces.values():
            slots.key_type(ks.key_type)
            if ks.strategy not in STRATEGIES:
                raise CatalogError(f"{ks.name}: no strategy {ks.strategy}")
            if ks.strategy != "hash":
                raise CatalogError(f"{ks.name}: only hash placement is supported, not {ks.strategy}")
            ordered = sorted(ks.ranges, key=lambda r: r.lo)
            edges = [LEAST, *(r.hi + 1 for r in ordered)]
            if not ordered or [r.lo for r in ordered] != edges[:-1] or edges[-1] != MOST + 1:
                raise CatalogError(f"{ks.name}: ranges must cover every slot once")
            for owner in [*(r.node for r in ordered), *(p.node for p in ks.pins)]:
                if owner not in live:
                    raise CatalogError(f"{ks.name}: node {owner} isn't there")
            forms = [slots.canonical(ks.key_type, p.value) for p in ks.pins] if ks.key_type != "bytea" else []
            if ks.pins and (ks.key_type == "bytea" or len(set(forms)) != len(forms) or any(f != p.value for f, p in zip(forms, ks.pins))):
                raise CatalogError(f"{ks.name}: pins are distinct, in canonical form, and not of binary keys")
            if ks.second_type:
                slots.key_type(ks.second_type)
            chunks = sorted(ks.chunks, key=lambda c: c.lo)
            if chunks and ([c.lo for c in chunks] != [LEAST, *(c.hi + 1 for c in chunks)][:-1] or chunks[-1].hi != MOST or len({c.no for c in chunks}) != len(chunks)):
                raise CatalogError(f"{ks.name}: chunks must cover every slot once, each with its own number")
        for r in self.relations.values():
            if r.kind not in ("sharded", "reference", "global"):
                raise CatalogError(f"{r.name}: no kind {r.kind}")
            if r.kind == "sharded" and (r.keyspace not in self.keyspaces or not r.key):
                raise CatalogError(f"{r.name}: a sharded table has a key space and a key column")
            if r.kind == "sharded" and r.second_key and not self.keyspaces[r.keyspace].second_type:
                raise CatalogError(f"{r.name}: its key space has no second key")

    # on disk: a file an epoch; writing one that exists fails, so two writers can't both win

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Catalog:
        d = json.loads(text)
        spaces = {k: Keyspace(**(v | {"ranges": tuple(Range(**r) for r in v["ranges"]), "pins": tuple(Pin(**p) for p in v["pins"]), "chunks": tuple(Chunk(**c) for c in v["chunks"])})) for k, v in d["keyspaces"].items()}
        out = Catalog(d["epoch"], tuple(Node(**n) for n in d["nodes"]), spaces, {k: Relation(**v) for k, v in d["relations"].items()})
        out.validate()
        return out

    def save(self, spark: SparkSession, folder: str) -> None:
        self.validate()
        fs, path = _filesystem(spark, folder)
        fs.mkdirs(path(folder))
        target = path(f"{folder}/epoch-{self.epoch:012d}.json")
        if fs.exists(target):
            raise CatalogError(f"epoch {self.epoch} is taken: load the catalog again and repeat the change")
        draft = path(f"{folder}/.draft-{self.epoch}-{id(self)}")
        out = fs.create(draft, True)
        out.write(bytearray(self.to_json().encode()))
        out.close()
        if not fs.rename(draft, target):
            fs.delete(draft, False)
            raise CatalogError(f"epoch {self.epoch} is taken: load the catalog again and repeat the change")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> Catalog:
        fs, path = _filesystem(spark, folder)
        names = sorted(s.getPath().getName() for s in fs.listStatus(path(folder)) if s.getPath().getName().startswith("epoch-"))
        if not names:
            raise CatalogError(f"no catalog in {folder}")
        return Catalog.from_json("".join(r["value"] for r in spark.read.text(f"{folder}/{names[-1]}").collect()))


def _filesystem(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path
