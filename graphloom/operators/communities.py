"""Communities of the entity graph, level by level, and their summaries.

Deterministic label propagation: in its turn each node takes the label with the
greatest weight among its neighbours (ties to the least label), keeping its own
if nothing is heavier. Each turn another half of the nodes moves, by a hash, so
that neighbours do not swap labels for ever; it ends when none would move. Communities above the size limit are divided on the next
level into connected parts within the limit, by all of their inner edges. Each
node is in one community per level, and levels nest.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import DEFAULTS, Settings
from graphloom.session import stage, unstage
from graphloom.sources.providers import EmbeddingProvider, TextProvider


def _both_ways(graph: DataFrame) -> DataFrame:
    edges = graph.where("a <> b")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def label_propagation(graph: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, label) after the given rounds over (a, b, weight); isolated self-loops keep their own label."""
    nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct()
    labels = nodes.select("node", F.col("node").alias("label"))
    edges = stage(_both_ways(graph))
    for _ in range(rounds):
        before, labels = labels, stage(_spread(edges, labels))
        unstage(before)
    return labels


def settled_labels(graph: DataFrame, most: int = 50) -> DataFrame:
    """(node, label): label propagation in turns until no node would move, ``most`` rounds of two turns at most.

    A move of one node adds to the weight inside labels; neighbours that move at
    once may not, so each turn another half of the nodes moves. What still moves
    after ``most`` rounds moves between labels of about equal weight.
    """
    nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct()
    labels = stage(nodes.select("node", F.col("node").alias("label")))
    edges = stage(_both_ways(graph))
    for turn in range(2 * most):
        step = _spread(edges, labels).withColumnRenamed("label", "new").join(labels, "node")
        mine = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        moved = stage(step.select("node", F.when(mine, F.col("new")).otherwise(F.col("label")).alias("label"), (F.col("new") != F.col("label")).alias("moves")))
        unstage(labels)
        labels = moved
        if moved.where("moves").isEmpty():
            break
    return labels.select("node", "label")


def _spread(edges: DataFrame, labels: DataFrame) -> DataFrame:
    heard = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
    best = heard.groupBy("node").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("new"), F.max("w").alias("w"))
    own = labels.join(heard.withColumnRenamed("w", "own_w"), ["node", "label"], "left")
    chosen = own.join(best, "node", "left")
    keep = F.col("new").isNull() | (F.col("own_w") >= F.col("w"))
    return chosen.select("node", F.when(keep, F.col("label")).otherwise(F.col("new")).alias("label"))


def bounded_parts(graph: DataFrame, most: int) -> DataFrame:
    """(node, label): connected parts of at most ``most`` nodes over (a, b, weight), no two of which could still be joined.

    Every round each part turns to the one it has the greatest mean weight to,
    among those that it fits with. The larger of two that turn to each other
    takes in all that turn to it, the closest first, while there is room. No edge
    is left out; nodes stay alone where all their neighbours' parts are full.
    """
    graph = stage(graph.where("a <> b"))
    labels = stage(graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct().withColumn("label", F.col("node")))
    while True:
        size = stage(labels.groupBy("label").agg(F.count("*").alias("n")))
        at = lambda c, o: labels.select(F.col("node").alias(c), F.col("label").alias(o))
        between = graph.join(at("a", "la"), "a").join(at("b", "lb"), "b").where("la <> lb").groupBy(F.least("la", "lb").alias("x"), F.greatest("la", "lb").alias("y")).agg(F.sum("weight").alias("w"))
        of = lambda c, o: size.select(F.col("label").alias(c), F.col("n").alias(o))
        fit = between.join(of("x", "nx"), "x").join(of("y", "ny"), "y").where(F.col("nx") + F.col("ny") <= most)
        # One order of the pairs for both ends, so that the first pair of all is joined in any case; equal ones are in random order, else chains would be joined one by one.
        rank = F.struct((-F.round(F.col("w") / (F.col("nx") * F.col("ny")), 9)).alias("w"), F.xxhash64("x", "y").alias("h"), "x", "y")
        pairs = stage(fit.select("x", "y", "nx", "ny", rank.alias("rank")))
        if pairs.isEmpty():
            return labels
        sides = pairs.select(F.col("x").alias("own"), F.col("y").alias("to"), F.col("nx").alias("n"), F.col("ny").alias("to_n"), "rank").unionByName(pairs.select(F.col("y").alias("own"), F.col("x").alias("to"), F.col("ny").alias("n"), F.col("nx").alias("to_n"), "rank"))
        turned = stage(sides.groupBy("own").agg(F.min_by(F.struct("to", "n", "to_n", "rank"), "rank").alias("t"), F.count("*").alias("links")).select("own", "t.*", "links"))
        other = turned.select(F.col("own").alias("to"), F.col("to").alias("back"), F.col("links").alias("to_links"))
        larger = lambda n, links, label: F.struct(F.col(n).alias("n"), F.col(links).alias("links"), F.col(label).alias("label"))
        heads = turned.join(other, "to").where((F.col("back") == F.col("own")) & (larger("n", "links", "own") > larger("to_n", "to_links", "to"))).select(F.col("own").alias("to"))
        so_far = F.sum("n").over(Window.partitionBy("to").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        moved = turned.join(heads, "to", "left_semi").withColumn("so_far", so_far).where(F.col("so_far") + F.col("to_n") <= most).select(F.col("own").alias("label"), F.col("to").alias("new"))
        labels = stage(labels.join(moved, "label", "left").select("node", F.coalesce("new", "label").alias("label")))


def communities(graph: DataFrame, rounds: int = 50, levels: int = 3, s: Settings = DEFAULTS) -> DataFrame:
    """(level, cluster, node): level 0 over the whole graph, further levels inside the communities before.

    From level 1 on no community is above the size limit, so two levels hold all.
    """
    inner = stage(graph)
    out, before = None, None
    for level in range(levels):
        if before is None:
            labels = settled_labels(inner, rounds)
        else:
            labels = before.join(bounded_parts(inner, s.max_community_size), "node", "left").select("node", F.coalesce("label", "node").alias("label"))
        labels = stage(labels)
        own = _numbered(labels, level)
        out = own if out is None else out.unionByName(own)
        large = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > s.max_community_size).select("label")
        if large.isEmpty():
            break
        before = stage(labels.join(large, "label", "left_semi").select("node", F.col("label").alias("outer")))
        side = lambda c, o: before.select(F.col("node").alias(c), F.col("outer").alias(o))
        inner = stage(inner.join(side("a", "la"), "a").join(side("b", "lb"), "b").where("la = lb").select("a", "b", "weight"))
    return out


def _numbered(labels: DataFrame, level: int) -> DataFrame:
    """Clusters numbered from 0 by their labels; the numbers are counted over the labels alone."""
    order = labels.select("label").distinct().repartitionByRange("label").sortWithinPartitions("label")
    placed = stage(order.select("label", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    skip = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    parts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("base")).select("part", "base", F.coalesce(F.sum("n").over(skip), F.lit(0)).alias("skip"))
    numbers = placed.join(F.broadcast(parts), "part").select("label", (F.col("skip") + F.col("at") - F.col("base")).alias("cluster"))
    return labels.join(numbers, "label").select(F.lit(level).alias("level"), "cluster", "node")


def community_members(found: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """(community_id, level, entity_ids)."""
    name = F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("_C"), F.col("cluster").cast("string"))
    return found.groupBy(name.alias("community_id"), "level").agg(F.array_sort(F.collect_list("node")).alias("entity_ids"))


def community_prompts(found: DataFrame, entities: DataFrame) -> DataFrame:
    """(community_id, level, entity_ids, prompt): one line per known member for a summariser.

    Line ends inside names and descriptions become blanks.
    """
    line = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("entity_type", F.lit("UNKNOWN")), F.lit("): "), F.coalesce("description", F.lit("")))
    name = F.concat(F.lit("L"), F.col("level").cast("string"), F.lit("_C"), F.col("cluster").cast("string"))
    line = F.regexp_replace(line, "\\s+", " ")
    joined = found.join(entities.select(F.col("entity_id").alias("node"), "name", "entity_type", "description"), "node", "left")
    lines = joined.groupBy(name.alias("community_id"), "level").agg(F.array_sort(F.collect_list("node")).alias("entity_ids"), F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), line))).alias("lines"))
    return lines.select("community_id", "level", "entity_ids", F.array_join("lines", "\n").alias("prompt"))


def extractive_summaries(prompts: DataFrame, members: int = 5) -> DataFrame:
    """Summaries without a model: how many members a community has, and the lines of the first ones."""
    first = F.slice(F.split("prompt", "\n"), 1, members)
    return prompts.select("community_id", "level", "entity_ids", F.concat(F.size("entity_ids").cast("string"), F.lit(" entities: "), F.array_join(first, "; ")).alias("summary"), F.lit(None).cast("array<float>").alias("summary_embedding"))


def model_summaries(prompts: DataFrame, model: TextProvider | None, embedding: EmbeddingProvider | None = None, ask: str = "Summarise what connects these entities in a short paragraph:\n\n", s: Settings = DEFAULTS) -> DataFrame:
    """(community_id, level, entity_ids, summary, summary_embedding): asked of a text model, and embedded.

    Where there is no model, or it fails, the extractive summary stands; without
    an embedding provider the vector is null.
    """
    plain = extractive_summaries(prompts).select("community_id", "level", "entity_ids", F.col("summary").alias("plain"))
    rows = prompts.select("community_id", "prompt").join(plain, "community_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(s.llm_concurrency) as pool:
            for b in batches:
                said = [None] * len(b) if model is None else [reply for reply, _ in pool.map(lambda p: model.complete(ask + p), b["prompt"])]
                b["summary"] = [x if x else plain for x, plain in zip(said, b["plain"])]
                b["summary_embedding"] = embedding.embed(b["summary"].tolist()) if embedding is not None else None
                yield b[["community_id", "level", "entity_ids", "summary", "summary_embedding"]]

    return rows.mapInPandas(run, "community_id string, level int, entity_ids array<string>, summary string, summary_embedding array<float>")
