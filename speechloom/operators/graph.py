"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """links (a, b), of one type, to (node, root): every linked node once, root the least node of its component.

    In each round every node points to the least of its neighbours and itself, and then to what that one points to; links
    become those between what their ends point to. A round's links are written, so a lost executor costs one round; their
    number never grows, and nodes of very many links cost no join on them: both joins are on the map's unique side, which
    adaptive execution splits on the other. Links of a node to itself, and repeated ones, change nothing; an empty table
    gives an empty one.
    """
    both = lambda x: x.union(x.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = written(both(now).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        hop = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        # Pointers jump until each ends at a node that points to itself; they only ever point down.
        while True:
            far = written(roots.join(hop, F.col("root") == F.col("_n")).select("node", F.col("_r").alias("root"), (F.col("_r") < F.col("root")).alias("_moved")), "roots")
            moved = not far.where("_moved").isEmpty()
            roots = far.drop("_moved")
            if not moved:
                break
            hop = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        ends = now.join(hop.withColumnsRenamed({"_n": "a", "_r": "ra"}), "a").join(hop.withColumnsRenamed({"_n": "b", "_r": "rb"}), "b")
        now = written(ends.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct(), "links")
        if now.isEmpty():
            return roots
        lower = both(now).groupBy(F.col("a").alias("_n")).agg(F.least(F.min("b"), F.first("a")).alias("_r"))
        roots = written(roots.join(lower, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "roots")
