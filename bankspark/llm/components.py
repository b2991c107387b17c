"""Connected components of a graph of any size, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from bankspark.llm.store import stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; nodes share a root if links connect them.

    Each round moves every node to its smallest neighbour's smallest neighbour and keeps the links between
    the places moved to, of which there are far fewer. Neighbours meet in a minimum that combines before the
    shuffle, so a node with very many links is no burden. A written table ends each round.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), folder, "links-0")
    moves, k = [], 0
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        nearest = stored(nearest, folder, f"nearest-{k}")
        step = nearest.select(F.col("a").alias("to"), F.col("to").alias("further"))
        move = stored(nearest.join(step, "to").select("a", F.col("further").alias("to")), folder, f"move-{k}")
        moves.append(move)
        k += 1
        links = stored(
            links.join(move, "a").select(F.col("to").alias("c"), F.col("b").alias("a"))
            .join(move, "a").select(F.least("c", "to").alias("a"), F.greatest("c", "to").alias("b"))
            .filter("a <> b").distinct(),
            folder, f"links-{k}",
        )
    if not moves:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves[0].select(F.col("a").alias("node"), F.col("to").alias("root"))
    for move in moves[1:]:
        after = move.select(F.col("a").alias("root"), F.col("to").alias("further"))
        roots = roots.join(after, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return stored(roots, folder, "roots")
