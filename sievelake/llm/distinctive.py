"""How distinctive each term is of its record: log-likelihood ratios over the whole collection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.staging import stage

#: A term in more than one of FREQUENT records is frequent. A record of m distinct terms counts for m in the sum of all document
#: frequencies, so there are at most FREQUENT times m (on average) such terms, however large the collection.
FREQUENT = 500
#: Frequent terms that are broadcast (under 100 bytes each). Where very long records make more of them, the most frequent ones are.
BROADCAST_STATS = 200_000


def words(texts: Sequence[Column], *, least: int = 4) -> Column:
    """Runs [0-9a-zа-я]+ of the texts joined by a blank, lower case, ё as е, of ``least`` or more characters, not starting with a digit."""
    joined = F.replace(F.lower(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])), F.lit("ё"), F.lit("е"))
    return F.filter(F.regexp_extract_all(joined, F.lit("[0-9a-zа-я]+"), F.lit(0)), lambda w: (F.length(w) >= least) & ~w.rlike("^[0-9]"))


def log_likelihood(n: Column, length: Column, cf: Column, total: Column) -> Column:
    """Signed G2 of the table (term / other) x (record / rest); negative where the term is rarer in the record."""
    rest = total - length
    cells = [(n, length, cf), (cf - n, rest, cf), (length - n, length, total - cf), (rest - cf + n, rest, total - cf)]
    g = F.lit(0.0)
    for seen, row, col in cells:
        expected = row.cast("double") * col / total
        g = g + F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    return F.when(n * total >= length * cf, 2 * g).otherwise(-2 * g)


def term_scores(df: DataFrame, key: str, texts: Sequence[str], *, df_range: tuple[int, int] | None = None, least: int = 4) -> DataFrame:
    """(key, term, n, df, n_records, llr): each term of each record against the rest of the collection.

    n: occurrences in the record, df: records with the term, n_records: distinct keys, llr: signed log-likelihood ratio.
    Rows of a repeated key are one record (any of them; their texts should be equal); null keys are left out; null texts are ''; records
    without terms give no rows but count in n_records. ``df_range`` keeps the terms of so many records only; statistics are of all data.

    One shuffle brings a key's rows together; counting terms within a record needs none. Statistics by term are combined before their
    shuffle. Frequent terms, of which there is a bounded number, get them by broadcast, so that no term is hot in the join of the others.
    """
    once = df.select(F.col(f"`{key}`").alias("k"), words([F.col(f"`{t}`") for t in texts], least=least).alias("w")).where(F.col("k").isNotNull())
    once = once.groupBy("k").agg(F.max("w").alias("w"))
    pairs = once.select("k", F.size("w").cast("long").alias("length"), F.explode("w").alias("term")).groupBy("k", "length", "term").agg(F.count(F.lit(1)).alias("n"))
    size = df.select(F.col(f"`{key}`").alias("k")).where(F.col("k").isNotNull()).groupBy("k").agg(F.lit(1)).groupBy().agg(F.count(F.lit(1)).alias("n_records")).first()
    n_records = size["n_records"]
    stats = stage(pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf")), "term-stats")
    total = stats.groupBy().agg(F.sum("cf").alias("t"))
    cut = max(n_records // FREQUENT, 12)
    if stats.where(F.col("df") > cut).count() > BROADCAST_STATS:
        cut = stats.select("df").orderBy(F.desc("df")).limit(BROADCAST_STATS).groupBy().agg(F.min("df").alias("m")).first()["m"]
    frequent = F.broadcast(stats.where(F.col("df") > cut).withColumnRenamed("term", "ft"))
    marked = pairs.join(frequent, F.col("term") == F.col("ft"), "left")
    rare_stats = stats.where(F.col("df") <= cut)
    if df_range is not None:
        rare_stats = rare_stats.where(F.col("df").between(*df_range))
    rare = marked.where(F.col("ft").isNull()).select("k", "length", "term", "n").join(rare_stats.hint("shuffle_hash"), "term")
    columns = ["k", "term", "n", "df", "cf", "length"]
    scored = rare.select(*columns)
    if df_range is None or df_range[1] > cut:
        common = marked.where(F.col("ft").isNotNull())
        scored = scored.unionByName((common if df_range is None else common.where(F.col("df").between(*df_range))).select(*columns))
    llr = log_likelihood(F.col("n"), F.col("length"), F.col("cf"), F.col("t"))
    return scored.withColumn("t", total.scalar()).select(F.col("k").alias(key), "term", "n", "df", F.lit(n_records).cast("long").alias("n_records"), llr.alias("llr"))
