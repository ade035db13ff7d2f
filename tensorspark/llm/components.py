"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorspark.llm.common import through_files


def _smallest(edges: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select(
        "node", F.least("node", "near").alias("parent")
    )


def _jump(parents: DataFrame) -> DataFrame:
    """Follows parents of parents until every node points to a root."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        jumped = parents.join(above, "parent").select(
            "node", F.col("next").alias("parent"), (F.col("next") != F.col("parent")).alias("moved")
        )
        jumped = through_files(jumped, "parents")
        parents = jumped.select("node", "parent")
        if jumped.where("moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (longs ``a``, ``b``); root is the smallest.

    Each round hooks every root to its smallest neighbour, halves chains until they are
    stars, and contracts the links; rounds grow with the logarithm of the number of nodes.
    Every step is a join or a combined aggregate, and is written to the shared folder.
    """
    parents = _jump(through_files(_smallest(edges), "parents"))
    while True:
        root = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        rest = edges.join(root, "a").join(root.toDF("b", "rb"), "b").where("ra != rb")
        rest = through_files(
            rest.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links"
        )
        if rest.isEmpty():
            return parents.select("node", F.col("parent").alias("root"))
        roots = _jump(through_files(_smallest(rest), "parents"))
        roots = roots.select(F.col("node").alias("parent"), F.col("parent").alias("higher"))
        joined = parents.join(roots, "parent", "left")
        parents = through_files(
            joined.select("node", F.coalesce("higher", "parent").alias("parent")), "parents"
        )
