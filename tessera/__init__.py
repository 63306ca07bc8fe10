"""An analytics engine on Spark for data that is split by distribution keys."""

from tessera.catalog import Catalog, Keyspace, Node, Pin, Range, Relation
from tessera.plans.engine import Engine

__all__ = ["Catalog", "Engine", "Keyspace", "Node", "Pin", "Range", "Relation"]
