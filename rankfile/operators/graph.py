"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): connected components, each labelled by its smallest id. nodes(id), edges(a, b).

    Hash-min with a jump to the label's label in each round, so a path of length n takes about log n rounds. The
    rounds go on to the fixed point; each is written to the shared folder, and nothing is collected but whether a
    label changed.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("hop"), F.col("label").alias("old"))
        jump = labels.select(F.col("id").alias("hop"), F.col("label").alias("next"))
        new = written(new.join(jump, "hop", "left").select("id", F.least("hop", F.coalesce("next", "hop")).alias("label"), "old"), "labels")
        labels = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return labels
