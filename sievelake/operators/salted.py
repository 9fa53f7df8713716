"""Per-key aggregation that stays balanced when a few keys hold most rows.

Stage 0 finds the heavy keys with a bounded frequent-items sketch, stage 1
aggregates by (key, salt), where only heavy keys get more than one salt, and
stage 2 merges the partial results by key. Every aggregate is split into a
partial and a merging form, so no row is dropped, capped or sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Entries the sketch may hold; with it the size of what comes to the driver is bounded.
SKETCH_ITEMS = 8192
KINDS = ("count", "sum", "avg", "min", "max", "count_distinct")


def heavy_hashes(df: DataFrame, keys: Sequence[str], heavy_share: float) -> list[int]:
    """Hashes of the keys that hold at least about ``heavy_share`` of the rows.

    A frequent-items sketch over all rows: one map-side pass, a merge of
    sketches of at most SKETCH_ITEMS entries, and at most 1 / heavy_share hashes
    on the driver. A key missed or added here changes the balance only.
    """
    most = max(1, min(SKETCH_ITEMS // 2, int(2 / heavy_share)))
    row = df.select(F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("h")).agg(
        F.expr(f"approx_top_k(h, {most}, {SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    least = heavy_share * (row["n"] or 0)
    return [x["item"] for x in row["top"] or [] if x["count"] >= least and row["n"]]


def _parts(out: str, kind: str, value: Column | None) -> tuple[list[Column], Column]:
    """Partial aggregates of stage 1 and the merging expression of stage 2."""
    p = f"__{out}"
    if kind == "count":
        return [F.count(F.lit(1) if value is None else value).alias(p)], F.sum(p)
    if kind == "sum":
        return [F.sum(value).alias(p)], F.sum(p)
    if kind == "avg":
        return [F.sum(value).alias(p), F.count(value).alias(f"{p}_n")], F.sum(p) / F.when(F.sum(f"{p}_n") > 0, F.sum(f"{p}_n"))
    if kind in ("min", "max"):
        f = getattr(F, kind)
        return [f(value).alias(p)], f(p)
    if kind == "count_distinct":
        return [F.countDistinct(value).alias(p)], F.sum(p)
    raise ValueError(f"{kind}: known are {', '.join(KINDS)}")


def salted_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Mapping[str, tuple[str, str | None]],
    *,
    salts: int = 64,
    heavy_share: float = 0.002,
    seed: int = 11,
) -> DataFrame:
    """``aggs`` (output name -> (kind, column)) per key, balanced under key skew.

    Kinds: count (column None counts rows), sum, avg, min, max, count_distinct
    (one column at most). A null key is a group of its own; null values are left out as in SQL;
    an empty input gives no rows; columns outside ``keys`` and ``aggs`` are
    never read. Heavy keys are salted at random (seeded, so a lost executor
    recomputes the same salts); with a count_distinct the salt is a hash of
    the counted value, so that each value meets one salt and partial counts add up.
    """
    distinct = {c for kind, c in aggs.values() if kind == "count_distinct"}
    if len(distinct) > 1:
        raise ValueError("one count_distinct column at most")
    clash = [k for k in keys if k in aggs]
    if clash:
        raise ValueError(f"aggregates may not have a key's name: {clash}")
    used = list(dict.fromkeys([*keys, *(c for _, c in aggs.values() if c)]))
    base = df.select(*[F.col(f"`{c}`") for c in used])
    heavy = heavy_hashes(base, keys, heavy_share)
    spread = F.xxhash64(F.col(f"`{distinct.pop()}`")) if distinct else (F.rand(seed) * (1 << 30)).cast("long")
    is_heavy = F.xxhash64(*[F.col(f"`{k}`") for k in keys]).isin(heavy) if heavy else F.lit(False)
    salted = base.withColumn("__salt", F.when(is_heavy, F.pmod(spread, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
    partial, merge = [], []
    for out, (kind, column) in aggs.items():
        p, m = _parts(out, kind, None if column is None else F.col(f"`{column}`"))
        partial += p
        merge.append(m.alias(out))
    by = [F.col(f"`{k}`") for k in keys]
    return salted.groupBy(*by, "__salt").agg(*partial).groupBy(*by).agg(*merge)


def with_share(df: DataFrame, count: str, share: str) -> DataFrame:
    """Adds each row's part of the total of ``count``; the total is one value, read by a scalar subquery."""
    total = df.groupBy().agg(F.sum(count).alias("t"))
    return df.withColumn(share, F.col(count) / total.scalar())


def salted_top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, salts: int = 64, heavy_share: float = 0.002, seed: int = 11
) -> DataFrame:
    """First ``n`` rows per key in ``order`` (which must be total to be repeatable), in two salted stages."""
    heavy = heavy_hashes(df, keys, heavy_share)
    by = [F.col(f"`{k}`") for k in keys]
    is_heavy = F.xxhash64(*by).isin(heavy) if heavy else F.lit(False)
    salted = df.withColumn("__salt", F.when(is_heavy, (F.rand(seed) * salts).cast("int")).otherwise(F.lit(0)))
    first = salted.withColumn("__rn", F.row_number().over(Window.partitionBy(*by, "__salt").orderBy(*order))).where(F.col("__rn") <= n)
    last = first.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n)
    return last.drop("__salt", "__rn")
