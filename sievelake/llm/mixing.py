"""Mixing sources to target weights, with capped repeats and reported shares.

The unit is a distinct text of a source, so that copies of a text don't add to its uses. Sizes are measured by block: a text's hash
puts it into one of at most ``blocks`` blocks of its source. The plan (how often each block is used) is made of block totals on
the driver; it has at most PLAN_ROWS rows. A multivariate-hypergeometric splitting tree parts the
exact numbers of drawn blocks among the output shards, permutations choose which blocks they are and their order in the shard, and texts are shuffled
within their block. A text's place is the sum of the blocks before it and its place in the block, so no task ever holds a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.staging import stage

#: Most sources a mixture may name; with ``blocks`` it bounds the plan.
MAX_SOURCES = 256
#: Most rows of a plan, one for each use of a block (under 100 bytes each where it is broadcast). Many sources or repeats get fewer blocks.
PLAN_ROWS, LEAST_BLOCKS = 400_000, 8


def block_of(key: Column, blocks: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(blocks)).cast("int")


def block_count(targets: dict[str, tuple[float, int]], blocks: int) -> int:
    """``blocks``, or as many as keep the plan within PLAN_ROWS."""
    uses = sum(max(r, 1) for _, r in targets.values())
    most = PLAN_ROWS // max(uses, 1)
    if most < LEAST_BLOCKS:
        raise ValueError(f"{uses} repeats of all sources together; a plan of {PLAN_ROWS} uses needs at most {PLAN_ROWS // LEAST_BLOCKS}")
    return min(blocks, most)


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) whole numbers that sum to ``quotas``: each node of a binary tree draws, without replacement,
    its left half's share of the blocks that reached it, so all ways to deal the blocks are equally likely."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    total = int(quotas.sum())
    take = total * left // shards + int(rng.random() < total * left / shards % 1.0)
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals") if total else quotas
    return np.vstack([split_quotas(drawn, left, rng), split_quotas(quotas - drawn, shards - left, rng)])


def plan_mixture(block_sizes: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], shards: int, seed: int) -> tuple[list[tuple], list[tuple]]:
    """Which blocks are used, how often and where: rows (source, block, repeat, shard) and a report row per target.

    The mixture is the largest in which no source needs more than its max_repeats. Targets of sources without any token can't be met: the others share
    their weight in proportion, and the report says so. A source's last, partial repeat is made of whole blocks, chosen in random order to come
    nearest its quota.
    """
    usable = {s: (w, r) for s, (w, r) in targets.items() if w > 0 and r > 0 and sum(block_sizes.get(s, {}).values()) > 0}
    weight = sum(w for w, _ in usable.values())
    size = {s: sum(block_sizes[s].values()) for s in usable}
    budget = min((size[s] * r / (w / weight) for s, (w, r) in usable.items()), default=0.0)
    rng = np.random.default_rng(seed)
    names, drawn, used = sorted(usable), {}, {}
    for s in names:
        quota = budget * usable[s][0] / weight
        whole = min(int((quota + 0.5) // size[s]), usable[s][1])
        order = [(r, b) for r in range(1, whole + 1) for b in rng.permutation(sorted(block_sizes[s])).tolist()]
        got = whole * size[s]
        if whole < usable[s][1]:
            for b in rng.permutation(sorted(block_sizes[s])).tolist():
                more = block_sizes[s][b]
                if abs(got + more - quota) < abs(got - quota):
                    order.append((whole + 1, b))
                    got += more
        drawn[s], used[s] = order, got
    quotas = np.array([len(drawn[s]) for s in names], np.int64)
    parts = split_quotas(quotas, shards, rng) if names else np.zeros((shards, 0), np.int64)
    rows = []
    for j, s in enumerate(names):
        order, start = rng.permutation(len(drawn[s])), 0
        for shard, count in enumerate(parts[:, j].tolist()):
            rows += [(s, drawn[s][i][1], drawn[s][i][0], shard) for i in order[start : start + count].tolist()]
            start += count
    total = sum(used.values())
    report = []
    for s, (w, most) in sorted(targets.items()):
        have = sum(block_sizes.get(s, {}).values())
        reached = used.get(s, 0) / total if total else 0.0
        report.append((s, float(w), float(w / weight) if s in usable else 0.0, reached, used.get(s, 0), have, used.get(s, 0) / have if have else 0.0, int(most)))
    return rows, report


REPORT = "source string, target_share double, planned_share double, actual_share double, tokens long, available_tokens long, mean_repeats double, max_repeats int"


def mix(df: DataFrame, key: str, source: str, text: str, size: str, targets: DataFrame, *, shards: int = 16, blocks: int = 4096, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(mixture, report). mixture: (key, source, size, repeat_no, shard, pos), a row for each use of a text; report: shares by source.

    ``text`` is a column that tells texts apart (a digest of the text). Each distinct text of a source is one unit, named by the smallest key among its copies, and is used at most
    max_repeats times; pos counts from 1 in each shard. ``targets`` has source, target_share, max_repeats (a fixed small
    list; null or repeated sources in it are an error). Records of sources without a target or of a null source are not used; null texts are one text;
    texts of size 0 or null size come along with their block (null as 0). An empty table gives an empty mixture and a report of zeros.
    """
    rows = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    names = [r["source"] for r in rows]
    if len(rows) > MAX_SOURCES or None in names or len(set(names)) < len(names):
        raise ValueError("targets must be few, named and distinct")
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows}
    blocks, spark = block_count(wanted, blocks), df.sparkSession
    base = df.select(F.col(f"`{key}`").alias("k"), F.col(f"`{source}`").alias("s"), F.col(f"`{text}`").alias("t"), F.coalesce(F.col(f"`{size}`"), F.lit(0)).cast("long").alias("z"))
    # copies are combined in the tasks before they are shuffled, so a text with any number of them is no load
    units = base.where(F.col("s").isin(names) if names else F.lit(False)).groupBy("s", "t").agg(F.min("k").alias("k"), F.max("z").alias("z"))
    units = stage(units.withColumn("block", block_of(F.col("t"), blocks, seed)).select("k", "s", "z", "block"), "mix-units")
    sizes: dict[str, dict[int, int]] = {}
    counts: dict[tuple[str, int], int] = {}
    for r in units.groupBy("s", "block").agg(F.sum("z").alias("z"), F.count(F.lit(1)).alias("n")).collect():  # at most sources x blocks rows
        sizes.setdefault(r["s"], {})[r["block"]] = r["z"]
        counts[r["s"], r["block"]] = r["n"]
    chosen, report = plan_mixture(sizes, wanted, shards, seed)
    rng, placed, before = np.random.default_rng(seed + 1), [], [0] * shards
    for i in rng.permutation(len(chosen)).tolist():
        s, b, repeat, shard = chosen[i]
        placed.append((s, b, repeat, shard, before[shard]))
        before[shard] += counts[s, b]
    plan = spark.createDataFrame(placed, "ps string, pb int, repeat_no int, shard int, before long")
    mixed = units.join(F.broadcast(plan), (F.col("s") == F.col("ps")) & (F.col("block") == F.col("pb")))
    order = Window.partitionBy("s", "block", "repeat_no").orderBy(F.xxhash64(F.lit(seed + 1), "k", "repeat_no"), "k")
    mixture = mixed.select(F.col("k").alias(key), F.col("s").alias(source), F.col("z").alias(size), "repeat_no", "shard", (F.col("before") + F.row_number().over(order)).alias("pos"))
    return mixture, spark.createDataFrame(report, REPORT)
