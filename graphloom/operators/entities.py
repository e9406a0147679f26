"""Mentions to entities, and names to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import OTHER_PRIORITY, TYPE_PRIORITY


def type_priority(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPE_PRIORITY.items() for x in kv])
    return F.coalesce(F.element_at(table, F.upper(c)), F.lit(OTHER_PRIORITY))


def join_descriptions(parts: Column) -> Column:
    """Descriptions in order, one joined to the rest unless it stands in it already."""
    return F.aggregate(parts, F.lit(""), lambda acc, d: F.when(F.coalesce(d, F.lit("")) == "", acc).when(acc == "", d).when(F.contains(acc, d), acc).otherwise(F.concat(acc, F.lit(" | "), d)))


def consolidate(mentions: DataFrame, order: str, key: Column | None = None) -> DataFrame:
    """One entity per name: first id and cleaned name, best type, joined descriptions, united id lists.

    ``order`` is the column that says which mention came first.
    """
    k = F.col("name") if key is None else key
    empty = F.array().cast("array<string>")
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(c).cast("array<string>"), empty)))))
    # By description first: a name met everywhere is spread over many tasks, and its equal descriptions are one.
    parts = mentions.groupBy(k.alias("_key"), F.col("description").alias("d")).agg(
        F.min(order).alias("o"),
        F.min_by(F.struct("entity_id", "name", "canonical_name"), order).alias("first"),
        F.min(F.struct(type_priority(F.col("entity_type")).alias("p"), F.col(order).alias("o"), "entity_type")).alias("kind"),
        united("source_document_ids").alias("source_document_ids"),
        united("source_chunk_ids").alias("source_chunk_ids"),
    )
    whole = parts.groupBy("_key").agg(
        F.min_by("first", "o").alias("first"),
        F.min("kind").alias("kind"),
        F.array_sort(F.collect_list(F.struct("o", "d"))).alias("texts"),
        united("source_document_ids").alias("source_document_ids"),
        united("source_chunk_ids").alias("source_chunk_ids"),
    )
    return whole.select("first.*", "kind.entity_type", join_descriptions(F.transform("texts", lambda x: x["d"])).alias("description"), "source_document_ids", "source_chunk_ids")


def merge_entities(stored: DataFrame, batch: DataFrame, keep_type: bool = False) -> DataFrame:
    """Stored entities with a consolidated batch merged in by lower-cased name.

    Known entities keep their id, get new descriptions and ids; a better type
    wins unless ``keep_type``. Others are added.
    """
    cols = ["entity_id", "name", "canonical_name", "entity_type", "description", "source_document_ids", "source_chunk_ids"]
    a = stored.select(F.lower("name").alias("_k"), F.struct(*cols).alias("a"))
    b = batch.select(F.lower("name").alias("_k"), F.struct(*cols).alias("b"))
    both = a.join(b, "_k", "full_outer")
    empty = F.array().cast("array<string>")
    lists = lambda c: F.array_sort(F.array_union(F.coalesce(F.col(f"a.{c}"), empty), F.coalesce(F.col(f"b.{c}"), empty)))
    better = type_priority(F.col("b.entity_type")) < type_priority(F.col("a.entity_type"))
    kind = F.when(F.col("a").isNull() | (F.lit(not keep_type) & F.col("b").isNotNull() & better), F.col("b.entity_type")).otherwise(F.col("a.entity_type"))
    return both.select(
        F.coalesce("a.entity_id", "b.entity_id").alias("entity_id"),
        F.coalesce("a.name", "b.name").alias("name"),
        F.coalesce("a.canonical_name", "b.canonical_name").alias("canonical_name"),
        kind.alias("entity_type"),
        join_descriptions(F.array("a.description", "b.description")).alias("description"),
        lists("source_document_ids").alias("source_document_ids"),
        lists("source_chunk_ids").alias("source_chunk_ids"),
    )


def match_mentions(mentions: DataFrame, entities: DataFrame, group: str, mention: str = "mention") -> DataFrame:
    """(group, mention, entity_id): each mention's entity in its own group (such as a chunk).

    First by equal lower-cased name; what is left, by one name containing the
    other, the earliest entity winning. Containment is tried within a group
    only, and a group holds the few entities of one extraction. Empty mentions
    match nothing.
    """
    m = mentions.select(group, F.col(mention).alias("mention"), F.lower(F.trim(mention)).alias("_m")).where("_m <> ''").distinct()
    e = entities.select(group, "entity_id", "position", F.lower(F.trim("name")).alias("_e")).where("_e <> ''")
    exact = m.join(e, (m[group] == e[group]) & (m["_m"] == e["_e"])).groupBy(m[group], "mention").agg(F.min_by("entity_id", "position").alias("entity_id"))
    rest = m.join(exact.select(group, "mention"), [group, "mention"], "left_anti")
    near = rest.join(e, group).where(F.contains("_e", F.col("_m")) | F.contains("_m", F.col("_e")))
    return exact.unionByName(near.groupBy(group, "mention").agg(F.min_by("entity_id", "position").alias("entity_id")))


def resolve_endpoints(rels: DataFrame, extracted: DataFrame, stored: DataFrame) -> DataFrame:
    """Relationships whose ends are ids of stored entities.

    An end names an extracted entity; its name leads to the stored id, an
    unknown end stays as it is. Rows with an end that is not stored are dropped.
    """
    by_name = Window.partitionBy(F.lower("name")).orderBy("entity_id")
    first = stored.withColumn("_r", F.row_number().over(by_name)).where("_r = 1").select(F.lower("name").alias("_n"), F.col("entity_id").alias("_to"))
    known = extracted.select(F.col("entity_id").alias("_from"), F.lower("name").alias("_n")).join(first, "_n").groupBy("_from").agg(F.min("_to").alias("_to"))
    ids = stored.select(F.col("entity_id").alias("_id")).distinct()
    out = rels
    for end in ("source_entity_id", "target_entity_id"):
        out = out.join(known, out[end] == known["_from"], "left").withColumn(end, F.coalesce("_to", end)).drop("_from", "_to")
        out = out.join(ids, out[end] == ids["_id"], "left_semi")
    return out
