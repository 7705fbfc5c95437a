"""Shortest paths and adjacency over an edge table (src, dst, w), all of it distributed.

Paths are found by relaxing a frontier: the nodes that the last round brought closer send their distance along their edges. Only
what a round gains is written to the shared folder; what is settled stays in the files of earlier rounds, which are gathered into
one every ``GATHER`` rounds. Weights are 0 or more; INF marks no edge, and a path of INF or more is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import fail
from ..plans.order import running
from ..plans.scratch import bounded, written
from .lanes import INF

NO_PATH = (1 << 63) - 1
GATHER = 16


def edges_of(spark: SparkSession, indptr: list[int], indices: list[int], weights: list[int] | None = None) -> DataFrame:
    """The edge table of a compressed sparse row graph."""
    if indptr[-1] != len(indices) or any(a > b for a, b in zip(indptr, indptr[1:])):
        raise fail("graph", "indptr does not rise to the number of edges.", "pass V + 1 bounds of which the last is E.")
    rows = [(v, int(indices[k]), int(weights[k]) if weights is not None else 1, k) for v in range(len(indptr) - 1) for k in range(indptr[v], indptr[v + 1])]
    return spark.createDataFrame(rows, "src long, dst long, w long, pos long")


def _real(edges: DataFrame) -> DataFrame:
    """The edges that are there, their weights checked by one aggregation."""
    real = edges.filter(F.col("w") < INF).select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("w").cast("long"))
    if real.filter("w < 0").limit(1).count():
        raise fail("sssp", "an edge has a negative weight.", "use weights of 0 or more.")
    return real


def _best(rounds: list[DataFrame]) -> DataFrame:
    """The least (distance, hops) of each source and node over the rounds."""
    rows = rounds[0]
    for r in rounds[1:]:
        rows = rows.unionByName(r)
    return rows.groupBy("source", "node").agg(F.min(F.struct("dist", "hops")).alias("b")).select("source", "node", "b.dist", "b.hops")


def _relaxed(real: DataFrame, sources: DataFrame, max_rounds: int | None) -> DataFrame:
    """source, node, dist, hops: least distance, and the least number of edges of a path of that distance."""
    start = sources.select(F.col("source").cast("long")).distinct()
    frontier = written(start.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("dist"), F.lit(0).alias("hops")), "sssp")
    rounds, done = [frontier], 0
    while max_rounds is None or done < max_rounds:
        done += 1
        sent = frontier.join(real, frontier.node == real.src).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), (F.col("hops") + 1).alias("hops"))
        reached = sent.filter(F.col("dist") < INF).groupBy("source", "node").agg(F.min(F.struct("dist", "hops")).alias("new"))
        reached = bounded(reached, "reached")
        rows = rounds[0]
        for r in rounds[1:]:
            rows = rows.unionByName(r)
        known = rows.join(reached.select("source", "node"), ["source", "node"], "left_semi").groupBy("source", "node").agg(F.min(F.struct("dist", "hops")).alias("old"))
        gained = reached.join(known, ["source", "node"], "left").filter(F.col("old").isNull() | (F.col("new") < F.col("old")))
        frontier = written(gained.select("source", "node", "new.dist", "new.hops"), "sssp")
        if frontier.limit(1).count() == 0:
            break
        rounds.append(frontier)
        if len(rounds) > GATHER:
            rounds = [written(_best(rounds), "sssp")]
    return written(_best(rounds), "sssp")


def sssp(edges: DataFrame, sources: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """source, node, dist, pred for each node that a source reaches; one row of ``sources`` (column source) for each search.

    ``pred`` is the least of the predecessors on those shortest paths that have the fewest edges, NULL for the source; so the
    predecessors form a tree, with edges of weight 0 too. Without ``max_rounds`` as many rounds run as those paths have edges.
    """
    real = _real(edges)
    best = _relaxed(real, sources, max_rounds)
    steps = best.select("source", F.col("node").alias("src"), F.col("dist").alias("d"), F.col("hops").alias("h")).join(real, "src")
    steps = steps.select("source", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("dist"), (F.col("h") + 1).alias("hops"), "src")
    least = best.filter("hops > 0").join(steps, ["source", "node", "dist", "hops"]).groupBy("source", "node").agg(F.min("src").alias("pred"))
    return best.select("source", "node", "dist").join(least, ["source", "node"], "left")


class Router:
    """A graph prepared once, its edges checked and written, for any number of routings."""

    def __init__(self, edges: DataFrame):
        self.edges = written(_real(edges), "router")

    def route_many(self, queries: DataFrame) -> DataFrame:
        """query, dist, target, visited: the nearest of each query's targets from the nearest of its sources.

        ``queries`` has rows (query, node, kind) of kind 'source' or 'target'. Of equally near targets the least wins.
        ``visited`` counts the nodes that are settled, nearest first and least first, up to the target; without a path the
        distance is NO_PATH, the target -1, and all reached nodes count.
        """
        sources = queries.filter("kind = 'source'").select("query", F.col("node").cast("long").alias("source"))
        found = _relaxed(self.edges, sources, None)
        near = written(sources.join(found, "source").groupBy("query", "node").agg(F.min("dist").alias("dist")), "route")
        ends = queries.filter("kind = 'target'").select("query", "node").distinct()
        hit = near.join(ends, ["query", "node"]).groupBy("query").agg(F.min(F.struct("dist", "node")).alias("t"))
        rows = near.join(hit, "query", "left").filter(F.col("t").isNull() | (F.struct("dist", "node") <= F.col("t")))
        counts = rows.groupBy("query").agg(F.count("*").alias("visited"), F.first("t").alias("t"))
        every = queries.select("query").distinct().join(counts, "query", "left")
        return every.select("query", F.coalesce("t.dist", F.lit(NO_PATH)).alias("dist"), F.coalesce("t.node", F.lit(-1).cast("long")).alias("target"), F.coalesce("visited", F.lit(0).cast("long")).alias("visited"))


def route(edges: DataFrame, queries: DataFrame) -> DataFrame:
    """One routing; see ``Router.route_many``."""
    return Router(edges).route_many(queries)


def adjacency_slice(edges: DataFrame, query: DataFrame, vertex: str = "vertex") -> DataFrame:
    """The query with begin and end of each vertex's edges when all edges lie in order of src."""
    if query.filter(F.col(vertex) == INF).limit(1).count():
        raise fail("adjacency_slice", f"vertex {INF} is reserved.", "use smaller ids.")
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    known = query.select(F.col(vertex).alias("src")).distinct().join(degree.select("src"), "src", "left_anti").withColumn("degree", F.lit(0).cast("long"))
    ends = running(degree.unionByName(known), {"end": F.col("degree")}, ["src"])
    return query.join(ends.select(F.col("src").alias("__src"), (F.col("end") - F.col("degree")).alias("begin"), "end"), F.col(vertex) == F.col("__src"), "left").drop("__src")


def adjacency_flat(edges: DataFrame, query: DataFrame, vertex: str = "vertex", position: str = "ord") -> DataFrame:
    """The neighbours of each queried vertex, in the order of the query and the edges."""
    return query.join(edges, F.col(vertex) == F.col("src")).select(position, vertex, F.col("dst").alias("neighbour"), F.col("pos").alias("edge"))
