"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from telemark.session import settle


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``links`` (a long, b long) -> (id, component): the smallest id reachable from every id in a link.

    Links with a null end are ignored, an id linked only with itself gets no row, and repeats
    change nothing. Each step is an aggregate and a join over the links and ends in a table under
    ``spark.checkpoint.dir``, so plans stay short and nothing but counts, observed while tables
    are written, reaches the driver. The steps end when every link points at the root of a star;
    a star's hub is a hot key that the minimum aggregates map-side and the adaptive skew join splits.
    """
    some = Observation()
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges.observe(some, F.count(F.lit(1)).alias("n")), "links")
    for _ in range(most_rounds if some.get["n"] else 0):
        # every u with the smallest link of its v; a v that is no u has larger links only
        ends, met = Observation(), Observation()
        low = edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        low = low.observe(ends, F.max("n").alias("most")).select("v", "m")
        large = edges.join(low, "v", "left").observe(met, F.max(F.col("m").isNotNull()).alias("any"))
        large = settle(large.select("u", F.coalesce("m", "v").alias("v")), "links")
        if ends.get["most"] == 1 and not met.get["any"]:
            break
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    else:
        if some.get["n"]:
            raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
