"""One ranking from several differently scaled scores (reciprocal rank fusion).

Within a group each score is turned into positions (1 + the number of greater
scores); only positions are combined, so no score's range can rule. Null and
NaN scores have no position. A group whose size passes ``hot_rows`` is never
ranked in one task: its distinct scores are counted, cut into value bands at
approximate quantiles, and positions are band offset + position in the band.
The sum of 1 / (k + position) over the scores makes the one ranking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

RRF_K = 60
HOT_ROWS = 200_000
BANDS = 256


def _number(c: str) -> Column:
    return F.when(~F.isnan(F.col(c)), F.col(c).cast("double"))


def _hot_positions(hot: DataFrame, group: str, score: str, bands: int) -> DataFrame:
    """(group, score, pos, n) of the distinct scores of large groups, without a task per group."""
    values = hot.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count("*").alias("c"))
    cuts = values.groupBy(group).agg(F.percentile_approx(score, F.array(*[F.lit(i / bands) for i in range(1, bands)]), 10 * bands).alias("cuts"))
    placed = values.join(cuts, group).withColumn("band", F.size(F.filter("cuts", lambda x: x > F.col(score)))).drop("cuts")
    totals = placed.groupBy(group, "band").agg(F.sum("c").alias("t"))
    above = Window.partitionBy(group).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(group, "band", F.coalesce(F.sum("t").over(above), F.lit(0)).alias("skip"), F.sum("t").over(Window.partitionBy(group)).alias("n"))
    inside = Window.partitionBy(group, "band").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(totals, [group, "band"]).select(group, score, (1 + F.col("skip") + F.coalesce(F.sum("c").over(inside), F.lit(0))).alias("pos"), "n")


def positions(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int = HOT_ROWS, bands: int = BANDS) -> DataFrame:
    """(group, item, <score>, <score>_pos, <score>_n for each score), each (group, item) once.

    Of repeated rows of an item the greatest score of each column is taken. Null
    groups and null items form groups and items like any other.
    """
    return _positions(df, group, item, scores, hot_rows, bands)[0]


def _positions(df: DataFrame, group: str, item: str, scores: list[str], hot_rows: int, bands: int) -> tuple[DataFrame, bool]:
    """The positions, and whether any group is hot."""
    once = df.groupBy(group, item).agg(*[F.max(_number(s)).alias(s) for s in scores])
    whole = Window.partitionBy(group)
    sizes = once.groupBy(group).agg(F.count("*").alias("_size")).where(F.col("_size") > hot_rows)
    some_hot = not sizes.isEmpty()
    ranked = once
    if some_hot:  # one row per hot group, at most rows / hot_rows; Spark picks the join by its size
        marked = cut(once.join(sizes.select(F.col(group).alias("_hot_group"), "_size"), F.col(group).eqNullSafe(F.col("_hot_group")), "left"))
        ranked, hot = (marked.where(c).select(*once.columns) for c in (F.col("_size").isNull(), F.col("_size").isNotNull()))
    cols = [F.col(group), F.col(item)]
    for s in scores:
        pos = F.when(F.col(s).isNotNull(), F.rank().over(whole.orderBy(F.col(s).desc_nulls_last())))
        cols += [F.col(s), pos.cast("long").alias(f"{s}_pos"), F.count(s).over(whole).alias(f"{s}_n")]
    ranked = ranked.select(*cols)
    if some_hot:
        # A key that is never null takes the group's place in the joins.
        wide = hot.withColumn("_gk", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
        keyed = wide
        for s in scores:
            p = _hot_positions(keyed, "_gk", s, bands).select("_gk", s, F.col("pos").alias(f"{s}_pos"))
            n = keyed.groupBy("_gk").agg(F.count(s).alias(f"{s}_n"))
            wide = wide.join(p, ["_gk", s], "left").join(n, "_gk")
        ranked = ranked.unionByName(wide.select(*ranked.columns))
    return ranked, some_hot


def rrf_score(scores: list[str], k: int = RRF_K) -> Column:
    """The sum of 1 / (k + position) over the scores that an item has."""
    total = F.lit(0.0)
    for s in scores:
        total = total + F.coalesce(1.0 / (k + F.col(f"{s}_pos")), F.lit(0.0))
    return total


def fuse_rankings(df: DataFrame, group: str, item: str, scores: list[str], k: int = RRF_K, hot_rows: int = HOT_ROWS, bands: int = BANDS) -> DataFrame:
    """:func:`positions` with ``rrf`` (0 for an item without any score) and ``rank``, 1 + the number of greater sums.

    Sums are compared to nine decimals; equal ones share a rank.
    """
    ranked, some_hot = _positions(df, group, item, scores, hot_rows, bands)
    fused = ranked.withColumn("rrf", F.round(rrf_score(scores, k), 9))
    above = F.rank().over(Window.partitionBy(group).orderBy(F.desc("rrf"))).cast("long")
    if not some_hot:
        return fused.withColumn("rank", above)
    sizes = fused.groupBy(group).agg(F.count("*").alias("_size"))
    hot = sizes.where(F.col("_size") > hot_rows).select(F.col(group).alias("_hot_group"), F.lit(True).alias("_hot"))
    marked = cut(fused.join(hot, F.col(group).eqNullSafe(F.col("_hot_group")), "left"))
    cold = marked.where("_hot is null").select(*fused.columns).withColumn("rank", above)
    keyed = marked.where("_hot").withColumn("_gk", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("null")))
    place = _hot_positions(keyed, "_gk", "rrf", bands).select("_gk", "rrf", F.col("pos").cast("long").alias("rank"))
    return cold.unionByName(keyed.join(place, ["_gk", "rrf"]).select(*cold.columns))


def strong_everywhere(fused: DataFrame, scores: list[str], share: int = 4, k: int = RRF_K) -> DataFrame:
    """Items in the first ceil(n / share) positions of every score that has any number in the group.

    The fused score selects: an item that is strong on all scores has at least the sum
    of the last positions allowed. The sum also lets in items that are first on one
    score and weak on another, so the positions are checked after it.
    """
    ok, any_score, least = F.lit(True), F.lit(False), F.lit(0.0)
    for s in scores:
        n = F.col(f"{s}_n")
        last = F.ceil(n / share)
        least = least + F.when(n > 0, 1.0 / (k + last)).otherwise(0.0)
        ok = ok & ((n == 0) | F.coalesce(F.col(f"{s}_pos") <= last, F.lit(False)))
        any_score = any_score | (n > 0)
    return fused.where(F.col("rrf") >= least - 1e-8).where(ok & any_score)
