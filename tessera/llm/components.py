"""Connected components of a table of links, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of ``links`` (two long columns); a component's root is one of its nodes.

    Each round every node joins its least neighbour, or itself where it is less, and links are carried over to what their
    ends joined; links within one node go. Node numbers should be in random order (hashes): each round then leaves a
    fraction of the nodes, whatever the shape. Every round is a written table; hot nodes are pre-aggregated and their joins
    are plain equi joins that adaptive execution can split.
    """
    links = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "links")
    nodes = written(links.select(F.col("u").alias("node")).union(links.select("v")).distinct().select("node", F.col("node").alias("root")), "nodes")
    while not links.isEmpty():
        both = links.union(links.select(F.col("v"), F.col("u")))
        parent = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("p"))
        parent = written(parent, "parents")
        # two steps up at once
        up = parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("pp")), "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        up = written(up, "parents")
        nodes = written(nodes.join(up.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
        moved = links.join(up, "u").select(F.col("p").alias("u"), "v").join(up.select(F.col("u").alias("v"), F.col("p").alias("q")), "v").select("u", F.col("q").alias("v"))
        links = written(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    return nodes
