"""Top N items of every group by simultaneous bisection of cutoffs.

Rows are ordered by a code of score, then identifier. For all groups at once, the interval of codes that holds the N-th row is cut
into FANOUT parts between the least and the largest code that occur in it, rows of each part are counted (combined before the shuffle, so
a group of any size costs a few counters a task), and the interval shrinks to the part with the N-th row: by score while scores differ,
by identifier among equal ones, until the group has exactly N rows above its cutoff. Rows are never sorted or gathered by group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.staging import drop_staged, stage

FANOUT = 1024
#: Cutoffs of so many groups (under 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 200_000


def _small(df: DataFrame, count: int) -> DataFrame:
    return F.broadcast(df) if count <= BROADCAST_GROUPS else df.hint("merge")


def _part() -> Column:
    """The part of its group's interval a row is in, better rows in higher parts.

    Every expression rises with the score (falls with the identifier) whatever its rounding, and tells the interval's two ends apart, so an interval always shrinks.
    Halves keep differences within the range of the type.
    """
    v, lo, hi = F.col("v"), F.col("v_lo"), F.col("v_hi")
    step = (hi * 0.5 - lo * 0.5) / FANOUT
    by_score = (
        F.when(hi == float("inf"), (v == hi).cast("long"))
        .when(lo == float("-inf"), (v > lo).cast("long"))
        .when(step > 0, F.least(F.floor((v * 0.5 - lo * 0.5) / step), F.lit(FANOUT - 1)))
        .otherwise((v > lo).cast("long"))
    )
    half = lambda c: F.shiftright(F.col(c), 1)
    wide = half("id_hi") - half("id_lo")
    by_id = F.when(wide > 0, -F.expr(f"(shiftright(id, 1) - shiftright(id_lo, 1)) div ((shiftright(id_hi, 1) - shiftright(id_lo, 1)) div {FANOUT} + 1)")).otherwise(-(F.col("id") - F.col("id_lo")))
    return F.when(lo < hi, by_score).otherwise(by_id)


_STATE = ("above", "v_lo", "v_hi", "id_lo", "id_hi")


def _extent() -> list[Column]:
    return [F.count(F.lit(1)).alias("held"), F.min("v").alias("v_lo"), F.max("v").alias("v_hi"), F.min("id").alias("id_lo"), F.max("id").alias("id_hi")]


def _inside(rows: DataFrame, state: DataFrame, count: int) -> DataFrame:
    """Rows within their group's interval, with its bounds."""
    at = _small(state.select(F.col("g").alias("sg"), *_STATE), count)
    same = F.col("g").eqNullSafe(F.col("sg")) & F.col("v").between(F.col("v_lo"), F.col("v_hi")) & ((F.col("v_lo") < F.col("v_hi")) | F.col("id").between(F.col("id_lo"), F.col("id_hi")))
    return rows.join(at, same).drop("sg")


def _cutoffs(rows: DataFrame, need: int) -> tuple[DataFrame | None, int]:
    """((g, v_lo, last), their number): of each group with over ``need`` rows the lowest score that is taken and, where some of its rows are not, the last identifier."""
    state = stage(rows.groupBy("g").agg(*_extent()).where(F.col("held") > need).withColumn("above", F.lit(0).cast("long")), "bisect")
    done, alive, total, opened = None, rows, 0, state.count()
    while opened:
        counts = _inside(alive, state, opened).groupBy("g", _part().alias("part")).agg(F.max("above").alias("before"), *_extent())
        better = F.sum("held").over(Window.partitionBy("g").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("above", F.col("before") + F.coalesce(better, F.lit(0)))
        now = stage(counts.where((F.col("above") < need) & (F.col("above") + F.col("held") >= need)).drop("before", "part"), "bisect")
        drop_staged(state)
        whole = F.col("above") + F.col("held") == need
        last = F.when(F.col("v_lo") == F.col("v_hi"), F.col("id_hi"))
        closed = now.where(whole).select("g", "v_lo", last.alias("last"))
        done = closed if done is None else done.unionByName(closed)
        state, before = now.where(~whole), opened
        opened = state.count()
        total += before - opened
        if opened and alive is rows:
            # from here on only the rows of open intervals are read
            alive = stage(_inside(rows, state, opened).select("g", "id", "v"), "open-rows")
    return done, total


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The first ``n`` items of each group by score descending, then item ascending: (group, item, score).

    Rows with a null or NaN score or a null item are left out; a null group is a group of its own; a repeated (group, item)
    counts once with its highest score; infinities are ordinary scores; -0.0 equals 0.0. Groups of at most ``n`` items come whole; an empty table
    gives no rows. Other columns are never read. ``item`` must be of an integer type.
    """
    kind = df.schema[item].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError("item must be an integer column")
    s = F.col(f"`{score}`").cast("double")
    once = (
        df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").cast("long").alias("id"), (s + F.lit(0.0)).alias("v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v") & F.col("id").isNotNull())
        .groupBy("g", "id").agg(F.max("v").alias("v"))
    )
    rows = stage(once, "topn")
    limit, count = _cutoffs(rows, n)
    if limit is not None:
        taken = F.col("v_lo").isNull() | (F.col("v") > F.col("v_lo")) | ((F.col("v") == F.col("v_lo")) & (F.col("last").isNull() | (F.col("id") <= F.col("last"))))
        rows = rows.join(_small(limit.withColumnRenamed("g", "cg"), count), F.col("g").eqNullSafe(F.col("cg")), "left").where(taken)
    return rows.select(F.col("g").alias(group), F.col("id").cast(kind).alias(item), F.col("v").alias(score))
