"""Inverted index in long form: term counts, BM25 and TF-IDF weights, sparse products and their top-k.

A sparse matrix is a table (row, term, value). Texts are cut into terms once: term counts are staged, then frequencies, weights and products
read them. The postings of the queries' terms are hashed by item once, so the sum over a query's terms needs no
further shuffle: the query side is broadcast after its size was counted, and only each task's best rows travel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.blocks import spread
from sievelake.operators.windows import top_k
from sievelake.staging import stage

#: Query terms that may be broadcast (under 100 bytes each).
BROADCAST_TERMS = 400_000


def small_side(df: DataFrame, limit: int = BROADCAST_TERMS) -> DataFrame:
    """``df`` to be broadcast if it has at most ``limit`` rows, else to be joined by merge. It is staged, so that counting it does not run its plan twice."""
    held = df if hasattr(df, "_staged") else stage(df, "side")
    return F.broadcast(held) if held.count() <= limit else held.hint("merge")


def term_counts(docs: DataFrame, doc: str, terms: Column | str) -> DataFrame:
    """(doc, term, tf, dl): counts of each document, which keeps the partitioning by ``doc``. dl counts repetitions."""
    base = docs.select(F.col(doc), F.coalesce(F.col(terms) if isinstance(terms, str) else terms, F.expr("cast(array() as array<string>)")).alias("__t"))
    return base.select(doc, F.size("__t").cast("long").alias("dl"), F.explode("__t").alias("term")).groupBy(doc, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def collection_stats(docs: DataFrame, terms: Column | str) -> DataFrame:
    """One row (n_docs, avgdl); documents without terms count. avgdl of an empty or blank collection is 1."""
    size = F.greatest(F.size(F.col(terms) if isinstance(terms, str) else terms), F.lit(0))
    avg = F.avg(size.cast("double"))
    return docs.groupBy().agg(F.count(F.lit(1)).alias("n_docs"), F.when(avg > 0, avg).otherwise(F.lit(1.0)).alias("avgdl"))


def bm25_idf(df: Column, n_docs: Column) -> Column:
    """ln(1 + (N - df + 0.5) / (df + 0.5)), never negative."""
    return F.log(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))


def bm25_weight(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float, b: float) -> Column:
    return idf * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / avgdl))


@dataclass
class Bm25Index:
    """Term counts of a field with what its weights need. k1 1.2; b 0.5 for titles, 0.75 for longer fields."""

    counts: DataFrame
    stats: DataFrame
    doc: str
    k1: float = 1.2
    b: float = 0.75
    rows: DataFrame | None = None
    docs: DataFrame | None = None

    @classmethod
    def build(cls, docs: DataFrame, doc: str, terms: Column | str, *, k1: float = 1.2, b: float = 0.75) -> Bm25Index:
        return cls(term_counts(docs, doc, terms), collection_stats(docs, terms), doc, k1, b, docs=docs.select(doc))

    def staged(self) -> Bm25Index:
        """The index with its counts written once, a row for each document: ``rows`` (doc, dl, terms, tfs)."""
        rows = self.counts.groupBy(self.doc, "dl").agg(F.collect_list(F.struct("term", "tf")).alias("v"))
        rows = stage(rows.select(self.doc, "dl", F.col("v.term").alias("terms"), F.col("v.tf").alias("tfs")), "postings")
        counts = rows.select(self.doc, "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("v")).select(self.doc, "dl", F.col("v.terms").alias("term"), F.col("v.tfs").alias("tf"))
        # lengths are those of the rows just written, so that no text is cut into terms again
        total = rows.groupBy().agg(F.coalesce(F.sum("dl"), F.lit(0)).cast("double").alias("__all"))
        stats = self.docs.groupBy().agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(total)
        stats = stats.select("n_docs", F.when(F.col("__all") > 0, F.col("__all") / F.col("n_docs")).otherwise(F.lit(1.0)).alias("avgdl"))
        return Bm25Index(counts, stage(stats, "stats"), self.doc, self.k1, self.b, rows, self.docs)

    def idf(self, wanted: DataFrame | None = None) -> DataFrame:
        """(term, df, idf), of the ``wanted`` terms only if given; df stays exact, for it is counted over all documents."""
        counts = self.counts if wanted is None else self.counts.join(wanted.select("term"), "term", "left_semi")
        df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return df.select("term", "df", bm25_idf(F.col("df"), self.stats.select("n_docs").scalar()).alias("idf"))

    def postings(self, wanted: DataFrame | None = None) -> DataFrame:
        """(doc, term, idf, weight)."""
        idf = self.idf(wanted)
        side = small_side(idf.select("term", "idf")) if wanted is not None else idf.select("term", "idf")
        avgdl = self.stats.select("avgdl").scalar()
        return self.counts.join(side, "term").select(self.doc, "term", "idf", bm25_weight(F.col("tf"), F.col("dl"), avgdl, F.col("idf"), self.k1, self.b).alias("weight"))

    def scores(self, queries: DataFrame, query: str, *, value: str | None = None) -> DataFrame:
        """(query, doc, score, matched_idf) for all pairs with a common term. ``queries`` has (query, term), distinct, or (query, term, ``value``).

        The queries' terms prune the postings before anything moves; those left are hashed by document, and sums by (query, doc) find their rows in one place.
        """
        q = stage(queries.select(query, "term", (F.lit(1.0) if value is None else F.col(value)).alias("qv")), "query-terms")
        wanted = small_side(q.select("term").distinct())
        weighted = spread(self.postings(wanted), self.doc)
        pairs = weighted.join(small_side(q), "term")
        return pairs.groupBy(query, self.doc).agg(F.sum(F.col("qv") * F.col("weight")).alias("score"), F.sum("idf").alias("matched_idf"))


def query_terms(queries: DataFrame, query: str, terms: Column | str) -> DataFrame:
    """(query, term), each term of a query once."""
    return queries.select(query, F.explode(F.array_distinct(F.col(terms) if isinstance(terms, str) else terms)).alias("term"))


def sparse_topk(scores: DataFrame, query: str, item: str, score: str, k: int, *, decimals: int = 6, rank: str | None = None) -> DataFrame:
    """Best ``k`` per query; scores are rounded first, so that the order of summation cannot flip ties, which go to the smaller item."""
    return top_k(scores.withColumn(score, F.round(score, decimals)), [query], score, item, k, rank=rank)


def tfidf(docs: DataFrame, doc: str, terms: Column | str, *, min_df: int = 2, vocabulary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((doc, term, weight), vocabulary): 1 + ln tf, smooth idf ln((1 + n) / (1 + df)) + 1, length 1 per document.

    Terms in fewer than ``min_df`` documents are dropped before the length is taken. With a ``vocabulary`` (term, idf) of an earlier call its terms and idf are used.
    """
    counts = stage(term_counts(spread(docs, doc), doc, terms), "grams")
    if vocabulary is None:
        n = docs.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
        vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
        vocabulary = stage(vocabulary.select("term", (F.log((n + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")), "vocabulary")
    raw = counts.join(small_side(vocabulary), "term").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.withColumn("__length", length).select(doc, "term", (F.col("w") / F.col("__length")).alias("weight")), vocabulary


def sparse_product(left: DataFrame, right: DataFrame, row: str, col: str, *, left_value: str = "value", right_value: str = "weight") -> DataFrame:
    """(row, col, value): rows of ``left`` (row, term, value) times columns of ``right`` (term, col, weight)."""
    return left.join(right, "term").groupBy(row, col).agg(F.sum(F.col(left_value) * F.col(right_value)).alias("value"))


def covered_idf(matched: Column, total: Column) -> Column:
    """Share of a query's idf that a document covers."""
    return matched / F.greatest(total, F.lit(1e-6))
