"""Connected components of links between documents, with DataFrame joins and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, staged


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) of all ids in links (a, b).

    A label is an id of the same component. Each round, an id and the id that is its label both take the smallest label of
    the id's neighbours, so a smaller label reaches a whole settled region at once; then each takes the label of its label.
    Rounds go on until no label moves: then neighbours have equal labels. Sums per id are made before the shuffle, so a hub
    with very many links is no single task."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    moved = True
    while moved:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        seen = labels.join(near, "id").withColumn("least", F.least("component", "near"))
        own = seen.select("id", "least", F.col("component").alias("old"))
        hooked = own.unionByName(seen.select(F.col("component").alias("id"), "least", F.lit(None).cast("long").alias("old")))
        hooked = staged(hooked.groupBy("id").agg(F.min("least").alias("component"), F.max("old").alias("old")), "hooked")
        jump = hooked.select(F.col("id").alias("component"), F.col("component").alias("far"))
        new = staged(hooked.join(jump, "component").select("id", F.least("component", "far").alias("component"), "old"), "labels")
        moved = not new.where(F.col("component") != F.col("old")).isEmpty()
        drop_staged(labels)
        drop_staged(hooked)
        labels = new.select("id", "component")
        labels._staged_path = new._staged_path
    drop_staged(both)
    return labels
