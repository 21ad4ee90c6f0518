"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to smaller neighbours until every component is a star around its smallest node. All
steps are joins and aggregations; no list of links or nodes reaches the driver, and each round's links are written to the
shared folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b. Returns node and root (the smallest node reachable) for all but the roots.

    Cases: a link from a node to itself or with a null end links nothing; repeated links count once; no links, no rows.
    """
    rows = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now, before = materialize(rows.distinct(), "links"), None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")).first()
        if state == before or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(now)
        now = after
