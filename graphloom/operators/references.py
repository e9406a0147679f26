"""References to records that do not exist.

Method: references are pre-aggregated per key and period (map-side combined), so
a key that a third of all rows name becomes one row per period. Keys above a
share of all references are *heavy*; there can be at most ``1 / heavy_share`` of
them, which bounds what is broadcast. Heavy keys are checked against the living
targets by that broadcast, the others by a shuffled anti-join, and both results
are united.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import lookup_key
from graphloom.session import cut

HEAVY_SHARE = 0.001


@dataclass(frozen=True)
class Reference:
    """``field`` of ``table`` (rows ``table_id``, times ``time``) names rows of ``target``."""

    table: str
    table_id: str
    field: str
    time: str
    target: str
    is_array: bool = False


@dataclass(frozen=True)
class Target:
    """A table that is referred to, with its key, its time and its kind in the deletions."""

    name: str
    key: str
    time: str
    kind: str


def living_keys(df: DataFrame, target: Target, deletions: DataFrame | None) -> DataFrame:
    """(target, key): keys with a row later than their last deletion.

    Null and blank keys are none. A key without any time counts as living only
    if it was never deleted.
    """
    rows = (
        df.select(lookup_key(F.col(target.key)).alias("key"), F.col(target.time).alias("t"))
        .where("key is not null and key <> ''")
        .groupBy("key")
        .agg(F.max("t").alias("t"))
    )
    if deletions is not None:
        gone = (
            deletions.where(F.col("record_kind") == target.kind)
            .select(lookup_key(F.col("record_id")).alias("key"), F.col("deleted_at").alias("d"))
            .groupBy("key")
            .agg(F.max("d").alias("d"))
        )
        rows = rows.join(gone, "key", "left").where("d is null or t > d")
    return rows.select(F.lit(target.name).alias("target"), "key")


def reference_rows(tables: dict[str, DataFrame], refs: list[Reference]) -> DataFrame:
    """(ref_table, ref_id, ref_field, target, key, period), distinct.

    period is the month of the earliest time of ref_id over all its rows. Each
    table is scanned and shuffled once, however many of its fields refer.
    Arrays are exploded; null and blank keys are none. A row whose id is null
    keeps a null ref_id and counts by its own time.
    """
    out = None
    for name in dict.fromkeys(r.table for r in refs):
        own = [r for r in refs if r.table == name]
        first = own[0]
        keys = [
            F.array_distinct(F.transform(F.col(r.field), lookup_key)) if r.is_array else F.array(lookup_key(F.col(r.field)))
            for r in own
        ]
        rid, hashed = F.col(first.table_id).cast("string"), F.xxhash64(*[F.col(r.field) for r in own])
        base = tables[name].select(
            rid.alias("ref_id"),
            F.coalesce(rid, F.concat(F.lit("\x00null"), hashed.cast("string"))).alias("_g"),
            F.col(first.time).alias("_t"),
            *[k.alias(f"_k{i}") for i, k in enumerate(keys)],
        )
        same = [f"_k{i}" for i in range(len(own))]
        # One shuffle by id serves both the removal of repeated rows and the earliest time.
        once = base.repartition(F.col("_g")).groupBy("_g", "ref_id", *same).agg(F.min("_t").alias("_t"))
        once = once.withColumn("_t", F.min("_t").over(Window.partitionBy("_g")))
        fields = F.array(*[F.struct(F.lit(r.field).alias("ref_field"), F.lit(r.target).alias("target"), F.col(f"_k{i}").alias("keys")) for i, r in enumerate(own)])
        long = (
            once.select(F.lit(name).alias("ref_table"), "ref_id", "_t", F.explode(fields).alias("f"))
            .select("ref_table", "ref_id", "f.ref_field", "f.target", F.explode("f.keys").alias("key"), F.date_format("_t", "yyyy-MM").alias("period"))
            .where("key is not null and key <> ''")
        )
        out = long if out is None else out.unionByName(long)
    return out


def split_heavy(counts: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(target, key) of the keys that hold more than ``heavy_share`` of all references.

    By arithmetic there are fewer than ``1 / heavy_share`` of them.
    """
    by_key = counts.groupBy("target", "key").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return by_key.where(F.col("n") > F.lit(total * heavy_share)).select("target", "key")


def orphan_key_periods(counts: DataFrame, living: DataFrame, heavy: DataFrame) -> DataFrame:
    """The rows of ``counts`` (ref_table, ref_field, target, key, period, n) whose key is not living."""
    on = ["target", "key"]
    few = F.broadcast(heavy)
    heavy_living = living.join(few, on, "left_semi").distinct()
    lost_heavy = counts.join(few, on, "left_semi").join(F.broadcast(heavy_living), on, "left_anti")
    lost_light = counts.join(few, on, "left_anti").join(living, on, "left_anti")
    return lost_heavy.unionByName(lost_light)


def orphan_counts(tables: dict[str, DataFrame], refs: list[Reference], targets: list[Target], deletions: DataFrame | None, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(ref_table, ref_field, period, orphan_refs, orphan_keys) of the references without a living record."""
    _, counts, living, heavy = _parts(tables, refs, targets, deletions, heavy_share)
    return (
        orphan_key_periods(counts, living, heavy)
        .groupBy("ref_table", "ref_field", "period")
        .agg(F.sum("n").alias("orphan_refs"), F.count("*").alias("orphan_keys"))
    )


def orphan_references(tables: dict[str, DataFrame], refs: list[Reference], targets: list[Target], deletions: DataFrame | None, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(ref_table, ref_id, ref_field, missing_key, period), one row per reference without a living record.

    Empty tables give no rows; repeated rows count once; extra columns are ignored.
    """
    rows, counts, living, heavy = _parts(tables, refs, targets, deletions, heavy_share)
    on = ["target", "key"]
    lost = orphan_key_periods(counts, living, heavy).select("target", "key").distinct()
    few = F.broadcast(heavy)
    lost_heavy = lost.join(few, on, "left_semi")
    found = rows.join(few, on, "left_semi").join(F.broadcast(lost_heavy), on, "left_semi")
    found = found.unionByName(rows.join(few, on, "left_anti").join(lost.join(few, on, "left_anti"), on, "left_semi"))
    return found.select("ref_table", "ref_id", "ref_field", F.col("key").alias("missing_key"), "period")


def _parts(tables, refs, targets, deletions, heavy_share):
    rows = cut(reference_rows(tables, refs))
    counts = rows.groupBy("ref_table", "ref_field", "target", "key", "period").agg(F.count("*").alias("n"))
    living = None
    for t in targets:
        own = living_keys(tables[t.name], t, deletions)
        living = own if living is None else living.unionByName(own)
    return rows, counts, living, split_heavy(counts, heavy_share)
