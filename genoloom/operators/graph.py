"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.operators.lineage import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def _hang(edges: DataFrame, keep_self: bool) -> DataFrame:
    """Rows (src, dst): every node of ``src``'s star is hung on the star's smallest member.

    The minimum is a partial aggregate, so a hub with very many edges is not gathered in one task;
    the join back is a plain equi-join that adaptive execution may split.
    """
    low = edges.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    joined = edges.join(low, "src")
    if keep_self:  # small star: the centre itself hangs on the minimum too
        hung = joined.select(F.col("dst").alias("a"), F.col("low").alias("b")).union(
            low.select(F.col("src").alias("a"), F.col("low").alias("b"))
        )
    else:  # large star: only the larger neighbours move
        hung = joined.filter("dst > src").select(F.col("dst").alias("a"), F.col("low").alias("b"))
    return hung.filter("a <> b").distinct().select(F.col("a").alias("src"), F.col("b").alias("dst"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    Edges are undirected; nulls and self loops are ignored, repeats count once, an empty table gives an
    empty result. Each round is written to the shared folder, and rounds stop when the edge set no longer
    changes (logarithmic in the component size).
    """
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).filter("s is not null and d is not null and s <> d")
    current = written(
        pairs.select(F.greatest("s", "d").alias("src"), F.least("s", "d").alias("dst")).distinct(), "edges"
    )
    before = _state(current)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = current.union(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        large = _hang(both, keep_self=False)
        small = _hang(large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")), keep_self=True)
        current = written(small, "edges")
        after = _state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = current.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return nodes.union(current.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
