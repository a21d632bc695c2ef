"""Connected components of links between identifiers, by repeated star contraction.

Links are rows (a, b). Each round points every vertex to the smallest neighbour it knows:
first its larger neighbours, then its smaller ones, so that every component ends as a
star around its smallest member. A link's two ends are aggregated before they
are joined, and a vertex with very many links is spread by its neighbours. Rounds are
written to the shared folder and grow with the logarithm of the longest path.
"""

from pyspark.sql import functions as F

from aerolith.session import store

MOST_ROUNDS = 64


def _least(links, by, other):
    """links with the smallest known neighbour of `by`, itself included."""
    least = links.groupBy(by).agg(F.least(F.min(other), F.col(by)).alias("m"))
    return links.join(least, by)


def components(links):
    """Rows (id, component_id) of every vertex of links (a, b), with the smallest member as class."""
    edges = store(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Larger neighbours move to the smallest member of the neighbourhood.
        large = _least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Then the smaller ones, and the vertex itself.
        near = _least(large, "a", "b")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            near.select("a", F.col("m").alias("b"))).distinct()
        after = store(small, "links")
        if _same(edges, after):
            break
        edges = after
    else:
        raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
    roots = after.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id")
    tops = roots.select(F.col("component_id").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return store(roots.unionByName(tops).distinct(), "components")


def _digest(edges):
    return edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
                     F.bit_xor(F.xxhash64("b", "a")).alias("x")).first()


def _same(before, after):
    return _digest(before) == _digest(after)
