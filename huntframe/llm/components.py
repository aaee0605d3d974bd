"""Connected components of a graph given as rows, in rounds of joins; nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huntframe.llm.storage import delete, written_at


def _apart(edges: DataFrame) -> DataFrame:
    """Each edge between two nodes once, whichever way it is given."""
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """``node, label`` of all nodes of ``a, b`` edges: the smallest node that each one reaches. Nodes are whole numbers.

    Each round moves every node to the one of least hash among itself and its neighbours, and the edges with their nodes. What was connected
    stays so, nodes that nothing moves to are gone, and edges that now join a node to itself or repeat another are dropped: a
    round works on what is left of the graph, which shrinks by about half or more, and hashes keep chains of rising numbers
    from being walked step by step. In the end the moves are followed from the last round back to the first.
    Least hashes are combined before the shuffle; a hot node's edges are split by the adaptive join.
    """
    spark, moves = edges.sparkSession, []
    left, path = written_at(_apart(edges), f"{label}-edges")
    while True:
        both = left.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(left.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = both.groupBy("node").agg(F.min_by("near", F.xxhash64("near")).alias("near"))
        to = F.when(F.xxhash64("near") < F.xxhash64("node"), F.col("near")).otherwise(F.col("node"))
        moves.append(written_at(least.select("node", to.alias("to")), f"{label}-moves"))
        step = moves[-1][0]
        ends = left.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        fewer, newer = written_at(_apart(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))), f"{label}-edges")
        delete(spark, path)
        left, path = fewer, newer
        if not left.limit(1).count():
            break
    delete(spark, path)
    ends, path = moves.pop()
    while moves:
        step, before = moves.pop()
        last = ends.select(F.col("node").alias("to"), F.col("to").alias("end"))
        after, newer = written_at(step.join(last, "to", "left").select("node", F.coalesce("end", "to").alias("to")), f"{label}-moves")
        delete(spark, path)
        delete(spark, before)
        ends, path = after, newer
    named, newer = written_at(ends.join(ends.groupBy("to").agg(F.min("node").alias("label")), "to").select("node", "label"), label)
    delete(spark, path)
    return named
