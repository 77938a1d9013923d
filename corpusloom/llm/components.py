"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialise

#: Parts that the edges of one node are dealt into.
SALTS = 8


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the least of them and the node itself.

    The large star moves neighbours above the node, the small star those below it. The least neighbour is a
    pre-aggregated minimum and is joined back by node and salt, so a hub's neighbours are never gathered in
    one place.
    """
    both = edges if not large else edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_least"))
    spread = least.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS))
    joined = both.join(spread, (F.col("u") == F.col("_u")) & (salt == F.col("_salt")))
    joined = joined.withColumn("_least", F.least("u", "_least"))
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("_least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_least").alias("v")).union(least.select("_u", "_least"))
    return out.where("u > v").distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for each node of an edge table (u, v), root being the component's least node.

    Every round's edges are written to the shared folder, which also cuts lineage. Rounds are logarithmic in
    the longest path. Loops and nulls are ignored, repeated edges count once; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialise(edges.distinct(), name)
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v", "v").distinct()
            )
        before, now = mark, materialise(star(star(now, large=True), large=False), name)
