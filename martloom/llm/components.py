"""Connected components of a graph given by its links, by alternating star contractions."""

from pyspark.sql import DataFrame, functions as F

from martloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node it reaches.

    ``links`` has columns a and b of one orderable type. Each round hangs a node's larger neighbours below its smallest
    one, then its smaller neighbours likewise; rows per node are only ever reduced to a minimum, so a node of any number of
    links needs no list. The number of rounds grows with the logarithm of the largest component. Loops and repeats are
    ignored; no links give no rows.
    """
    links = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    links = stored(links.distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links = stored(_small_star(_large_star(links)), "links")
        last, mark = mark, _mark(links)
        if mark == last:
            break
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _mark(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    hung = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
