"""The entity graph: adjacency, neighbourhoods, stranded entities, evidence of search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.session import stage


def adjacency(rels: DataFrame) -> DataFrame:
    """Every edge once per end: (node, neighbour, relationship_id); a self-loop comes once."""
    out = rels.select(F.col("source_entity_id").alias("node"), F.col("target_entity_id").alias("neighbour"), "relationship_id")
    back = rels.where("source_entity_id <> target_entity_id").select(F.col("target_entity_id").alias("node"), F.col("source_entity_id").alias("neighbour"), "relationship_id")
    return out.unionByName(back).where("node is not null")


def incident(rels: DataFrame, nodes: DataFrame, node: str = "entity_id") -> DataFrame:
    """The relationships that touch any of the nodes, each once."""
    ids = adjacency(rels).join(nodes.select(F.col(node).alias("node")).distinct(), "node", "left_semi").select("relationship_id").distinct()
    return rels.join(ids, "relationship_id", "left_semi")


def endpoints(rels: DataFrame) -> DataFrame:
    """(entity_id): every entity that some edge names; each side is reduced before the union is."""
    a = rels.select(F.col("source_entity_id").alias("entity_id")).distinct()
    return a.union(rels.select(F.col("target_entity_id")).distinct()).where("entity_id is not null").distinct()


def stranded(entities: DataFrame, rels: DataFrame) -> DataFrame:
    """Entities without any edge; a self-loop is an edge."""
    return entities.join(endpoints(rels), "entity_id", "left_anti")


def connected(entities: DataFrame, rels: DataFrame) -> DataFrame:
    return entities.join(endpoints(rels), "entity_id", "left_semi")


def with_names(rels: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names and types of both ends, null where an end is unknown."""
    out = rels
    for end in ("source", "target"):
        e = entities.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("name").alias(f"{end}_name"), F.col("entity_type").alias(f"{end}_type"))
        out = out.join(e, f"{end}_entity_id", "left")
    return out


def neighbourhood(rels: DataFrame, start: DataFrame, hops: int, s: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Nodes (entity_id, depth) within some hops of the start, and the edges met (relationship_id, hop).

    Each hop lists all edges of the nodes that the hop before reached, so an
    edge comes again from its other end. Hops are limited by the settings. The
    frontier is joined to the adjacency, never collected.
    """
    adj = adjacency(rels)
    seen = stage(start.select("entity_id").distinct().withColumn("depth", F.lit(0)))
    met = None
    for hop in range(1, min(hops, s.max_hops) + 1):
        frontier = seen.where(F.col("depth") == hop - 1).select(F.col("entity_id").alias("node"))
        step = stage(adj.join(frontier, "node"))
        edges = step.select("relationship_id", F.lit(hop).alias("hop"))
        met = edges if met is None else met.unionByName(edges)
        new = step.select(F.col("neighbour").alias("entity_id")).distinct().join(seen.select("entity_id"), "entity_id", "left_anti")
        seen = stage(seen.unionByName(new.withColumn("depth", F.lit(hop))))
    if met is None:
        met = rels.select("relationship_id", F.lit(0).alias("hop")).limit(0)
    return seen, met


def simple_graph(rels: DataFrame) -> DataFrame:
    """(a, b, weight), a < b: directions and parallel edges folded, the weight of the greatest id kept.

    A null or zero weight is 1. Self-loops are kept as a = b.
    """
    pair = rels.where("source_entity_id is not null and target_entity_id is not null").select(
        F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b"), "relationship_id", F.coalesce(F.nullif(F.col("weight"), F.lit(0.0)), F.lit(1.0)).cast("double").alias("w")
    )
    return pair.groupBy("a", "b").agg(F.max_by("w", "relationship_id").alias("weight"))


def _touching(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, relationship_id): the edges that touch any of each query's (query_id, entity_id), each once."""
    return adjacency(rels).join(nodes.select("query_id", F.col("entity_id").alias("node")).distinct(), "node").select("query_id", "relationship_id").distinct()


def entity_context(hits: DataFrame, entities: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each query_id the entities met in its hit chunks that have edges, and the edges that touch them, each once."""
    chunks = hits.select("query_id", F.col("id").alias("_c")).distinct()
    met = entities.select("entity_id", F.explode("source_chunk_ids").alias("_c")).join(chunks, "_c").select("query_id", "entity_id").distinct()
    own = connected(entities, rels).join(met, "entity_id")
    return own, rels.join(_touching(rels, own), "relationship_id")


def evidence(hits: DataFrame, own: DataFrame, edges: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """The edges with ``direct``: whether an end is an entity met in the very first chunks of the same query."""
    top = hits.where(F.col("rank") <= s.direct_chunk_window).select("query_id", F.col("id").alias("_c")).distinct()
    direct = own.select("query_id", "entity_id", F.explode("source_chunk_ids").alias("_c")).join(top, ["query_id", "_c"], "left_semi")
    once = edges.select("relationship_id", "source_entity_id", "target_entity_id").distinct()
    flagged = _touching(once, direct).withColumn("_d", F.lit(True))
    return edges.join(flagged, ["query_id", "relationship_id"], "left").withColumn("direct", F.coalesce("_d", F.lit(False))).drop("_d")
