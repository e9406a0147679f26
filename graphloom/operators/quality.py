"""Text quality: four measures, one verdict."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.config import DEFAULTS, Settings
from graphloom.functions.text import malformed_ratio, whitespace_density


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    p = counts / counts.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def _repetition(text: str) -> float:
    bare = "".join(text.split())
    if not bare:
        return 0.0
    counts = np.unique(np.frombuffer(bare.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    return float(counts.max() / counts.sum())


@F.pandas_udf(T.StructType([T.StructField("repetition", T.DoubleType()), T.StructField("entropy", T.DoubleType())]))
def _characters(texts: pd.Series) -> pd.DataFrame:
    known = texts.fillna("")
    return pd.DataFrame({"repetition": known.map(_repetition), "entropy": known.map(_entropy)})


def quality_metrics(df: DataFrame, text: str) -> DataFrame:
    """``df`` with repetition, entropy, malformed and whitespace.

    A histogram of characters by explode and groupBy would shuffle every
    character; it is counted per Arrow batch instead. Null counts as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        df.withColumn("_c", _characters(t))
        .withColumn("repetition", F.col("_c.repetition"))
        .withColumn("entropy", F.col("_c.entropy"))
        .withColumn("malformed", malformed_ratio(t))
        .withColumn("whitespace", whitespace_density(t))
        .drop("_c")
    )


def verdict(s: Settings = DEFAULTS) -> Column:
    """The first failing measure as a reason, null if the text is accepted."""

    def says(what: str, c: str, sign: str, bound: float) -> Column:
        return F.concat(F.lit(f"{what}: "), F.format_string("%.2f", F.col(c)), F.lit(f" {sign} {bound}"))

    return (
        F.when(F.col("repetition") > s.max_repetition, says("Repetition too high", "repetition", ">", s.max_repetition))
        .when(F.col("entropy") < s.min_entropy, says("Entropy too low", "entropy", "<", s.min_entropy))
        .when(F.col("entropy") > s.max_entropy, says("Entropy too high", "entropy", ">", s.max_entropy))
        .when(F.col("malformed") > s.max_malformed, says("Malformed text", "malformed", ">", s.max_malformed))
        .when(F.col("whitespace") > s.max_whitespace, says("Whitespace too dense", "whitespace", ">", s.max_whitespace))
    )


def judge(df: DataFrame, text: str, s: Settings = DEFAULTS) -> DataFrame:
    """``df`` with ``reason``; null for accepted rows."""
    return quality_metrics(df, text).withColumn("reason", verdict(s)).drop("repetition", "entropy", "malformed", "whitespace")


def quality_score(reply: Column) -> Column:
    """The first number of a scorer's reply, kept within 0 and 1; 1 if there is none."""
    found = F.regexp_extract(reply, r"[-+]?\d*\.\d+|\d+", 0)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nullif(found, F.lit("")).try_cast("double"))), F.lit(1.0))
