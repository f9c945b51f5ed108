"""Connected components of a graph whose links are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lecturelab.llm.common import drop_path, scratch_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `label` for every node that has a link; `label` is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours and then the label that this label had, so
    distances halve. A round is written to the shared folder and the one before it removed; only the number of
    changed labels reaches the driver: its joins are merges, as a broadcast in every round would pass through it. Empty links give an empty result.
    """
    spark = links.sparkSession

    def stored(df: DataFrame, label: str) -> tuple[DataFrame, str]:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    one_way = links.where(F.col(a) != F.col(b)).select(F.col(a).alias("node"), F.col(b).alias("other"))
    edges, edge_path = stored(one_way.union(one_way.select(F.col("other"), F.col("node"))), "links")
    first = edges.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("label"))
    labels, path = stored(first, "labels")
    while True:
        before = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        near = edges.hint("merge").join(before, F.col("other") == F.col("_n")).groupBy("node").agg(F.min("_l").alias("_m"))
        lower = labels.hint("merge").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "_m").alias("to"))
        jumped = lower.hint("merge").join(before, F.col("to") == F.col("_n")).select("node", F.col("_l").alias("label"), (F.col("_l") != F.col("was")).alias("moved"))
        labels, newer = stored(jumped, "labels")
        drop_path(spark, [path])
        path = newer
        if labels.where("moved").limit(1).count() == 0:
            drop_path(spark, [edge_path])
            return labels.select("node", "label")
