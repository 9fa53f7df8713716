"""Windows over the rows of a query: top-k, ranks, shares, first rows, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import hash01


def top_k(df: DataFrame, by: Sequence[str], score: str, tie: str, k: int, *, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group by score descending, then ``tie``; Spark prunes groups before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    out = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    return out.withColumn(rank, F.col("__rn").cast("long")).drop("__rn") if rank else out.drop("__rn")


def relative(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """For each column its share of the group's largest value (divisor 1 if that is not positive) and its rank, equal values
    sharing the smallest; null and NaN have neither."""
    group = Window.partitionBy(by)
    extra: dict[str, Column] = {}
    for c in columns:
        v = F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c))
        top = F.max(v).over(group)
        extra[f"{c}_rel"] = v / F.when(top > 0, top).otherwise(F.lit(1.0))
        extra[f"{c}_rank"] = rank_of(v, by)
    return df.withColumns(extra)


def rank_of(value: Column, by: str) -> Column:
    """RANK() in descending order; null where the value is null, and nulls do not shift others."""
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(by).orderBy(value.desc_nulls_last())).cast("long"))


def row_shares(df: DataFrame, by: Sequence[str], value: str, *, least: float = 1e-9, out: str = "share") -> DataFrame:
    """``value`` divided by its sum per group (at least ``least``)."""
    return df.withColumn(out, F.col(value) / F.greatest(F.sum(value).over(Window.partitionBy(*by)), F.lit(least)))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys are a group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def sample_exact(df: DataFrame, key: str, n: int, salt: str) -> DataFrame:
    """``n`` rows (all if fewer) in the repeatable random order of a salted hash of ``key``."""
    return df.orderBy(hash01(F.col(key).cast("string"), salt), F.col(key)).limit(n)


def ordered_distinct(item: Column, position: Column) -> Column:
    """Aggregate: distinct items in the order of their first position."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), item.alias("i")))), lambda x: x["i"]))
