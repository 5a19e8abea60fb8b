"""Connected components and other graph closures over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltline.session import cut


#: Up to FEW edges, all those of one node may meet in one task; up to HUB in the small stars, where few nodes have many.
FEW, HUB = 1 << 14, 1 << 18


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component): each node of an edge with the least node it reaches.

    Alternating large-star and small-star rounds: every round rewires edges towards the least
    neighbour, so the edge set shrinks to one star per component in about log(n) rounds. Only edges
    move, with map-side minima; nothing is gathered in one place. Each round is cut by a checkpoint.
    Edges with a null end are ignored, loops keep their node, repeated edges count once. No edges: no rows.
    """
    # what the edges are made of is computed once
    all_edges = cut(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    lone = all_edges.where("u = v").select("u", "v").distinct()
    now = cut(all_edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(max_rounds):
        # a hub's rows can be split if the aggregate is cut off from the join, which then has plain exchanges on both
        # sides; few edges make no hub worth the additional jobs
        held = cut if state[0] > HUB else lambda df: df
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = (cut if state[0] > FEW else held)(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = held(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # large holds (greater, lesser) rows only: the small star of u is over its lesser neighbours
        least = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        now = cut(small)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = stars.unionByName(roots)
    return found.unionByName(lone.select(F.col("u").alias("node"), F.col("v").alias("component")).join(found, "node", "left_anti"))
