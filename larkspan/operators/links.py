"""What hangs together: the smallest member of each component of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.tables import dropped, materialize


def linked(links: DataFrame) -> DataFrame:
    """(node, smallest) for every node of the links (a, b) that isn't the smallest of its component.

    Each round hangs the larger neighbours of a node on its smallest one, then the smaller ones, both by a minimum that is
    folded in each task before the shuffle. The rounds needed grow with the logarithm of the number of links; a round that
    changes nothing is the last. Null ends and links of a node to itself join nothing.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = ways.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = larger.groupBy("u").agg(F.min("v").alias("m"))
        both = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        after = materialize(larger.join(least, "u").select(both).select("e.u", "e.v").filter("u <> v").distinct(), "links")
        # The same rows have the same sum, and a sum of 38 digits of other rows would have to agree by chance.
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        dropped(now)
        now = after
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("smallest"))
        before = state
