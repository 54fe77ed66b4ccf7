"""Connected components by random-mate contraction.

In each round every vertex draws a coin from a hash of its id and the round. A vertex with tails
collapses into its smallest neighbour with heads, edges are relabelled to the survivors, loops and
repeated edges go. About a quarter or more of the vertices vanish per round, whatever the shape of
the graph, so long chains and stars take the same few rounds. When no edge is left, the collapsed
vertices are unwound: each points to the vertex it went into, and pointers are doubled until all
end at a root. Rounds are joins and grouped aggregates over stored tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.storage import materialize, release


def _heads(vertex: Column, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), vertex).bitwiseAND(F.lit(1)) == 1


def contract(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Rows (vertex, root) of all vertices that have an edge to another; roots are vertices too.

    ``edges``: columns u and v of one sortable type, in any direction, repeated, with loops or with
    nulls (which link nothing). Vertices without an edge to another vertex aren't listed.
    """
    whole = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    ordered = whole.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left, collapsed = materialize(ordered, "edges"), []
    for turn in range(max_rounds):
        if left.isEmpty():
            break
        current = left
        u, v = _heads(F.col("u"), turn), _heads(F.col("v"), turn)
        pairs = left.select(F.when(u & ~v, F.struct(F.col("v").alias("vertex"), F.col("u").alias("parent"))).when(v & ~u, F.struct(F.col("u").alias("vertex"), F.col("v").alias("parent"))).alias("p"))
        mates = materialize(pairs.where("p IS NOT NULL").groupBy("p.vertex").agg(F.min("p.parent").alias("parent")), "mates")
        collapsed.append(mates)
        for end in ("u", "v"):
            renamed = mates.select(F.col("vertex").alias(end), "parent")
            other = "v" if end == "u" else "u"
            left = left.join(renamed, end, "left").select(F.coalesce("parent", end).alias(end), other)
        left = left.where(F.col("u") != F.col("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        left = materialize(left, "edges")
        release(current)
    else:
        raise RuntimeError("the contraction didn't end")
    if not collapsed:
        return ordered.select(F.col("u").alias("vertex"), F.col("v").alias("root")).limit(0)
    pointers = collapsed[0]
    for more in collapsed[1:]:
        pointers = pointers.unionAll(more)
    for _ in range(max(1, (len(collapsed) - 1).bit_length())):
        ahead = pointers.select(F.col("vertex").alias("parent"), F.col("parent").alias("further"))
        last, pointers = pointers, materialize(pointers.join(ahead, "parent", "left").select("vertex", F.coalesce("further", "parent").alias("parent")), "pointers")
        release(last)
    roots = pointers.select(F.col("parent").alias("vertex"), F.col("parent").alias("root")).distinct()
    return pointers.select("vertex", F.col("parent").alias("root")).unionAll(roots)
