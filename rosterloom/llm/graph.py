"""Connected components of a graph given as a table of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.llm.tables import kept_as
from rosterloom.workspace import work_folder


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b); component is the smallest node.

    In each round every node goes over to its smallest neighbour, that one's choice included,
    and links are rewritten to the nodes gone over to; links within one node vanish. The
    smallest nodes of components stay, and what is left shrinks by half or more in each round.
    Each round is a table in the shared folder. A node with many links is no problem: minima
    are partly aggregated, and joins to it are split by Spark.
    """
    spark = links.sparkSession
    folder = work_folder(spark, "components")
    kind = links.schema["a"].dataType.simpleString()
    left = kept_as(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .distinct(), f"{folder}/links-0")
    moves, turn = [], 0
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least"))
        first = kept_as(near.select("node", F.least("node", "least").alias("to")), f"{folder}/first-{turn}")
        then = first.select(F.col("node").alias("to"), F.col("to").alias("then"))
        move = kept_as(first.join(then, "to").select("node", F.col("then").alias("to")), f"{folder}/moves-{turn}")
        moves.append(move)
        a, b = (move.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        moved = left.join(a, "a").join(b, "b").filter("to_a <> to_b").select(
            F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        turn += 1
        left = kept_as(moved, f"{folder}/links-{turn}")
    if not moves:
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    found = moves[-1].select("node", F.col("to").alias("component"))
    for n, move in reversed(list(enumerate(moves[:-1]))):
        later = found.select(F.col("node").alias("to"), "component")
        here = move.join(later, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
        found = kept_as(here, f"{folder}/found-{n}")
    return found
