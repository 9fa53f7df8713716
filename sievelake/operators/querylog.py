"""What the search log says about a query: similar queries, their items' title terms, categories and clicks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.text import char_ngrams
from sievelake.operators.blocks import sparse_neighbours
from sievelake.operators.index import tfidf
from sievelake.operators.windows import first_by, row_shares, top_k
from sievelake.staging import stage

#: Query texts compared in one block (about 100 n-grams of 20 bytes each).
TEXT_BLOCK = 8_192
NEIGHBOURS, MIN_SIM, PROFILE_TERMS, TRANSLATIONS, EXACT = 30, 0.25, 30, 50, 0.99


def log_texts(log: DataFrame, text: str = "qn") -> DataFrame:
    return log.select(text).distinct()


def neighbours(queries: DataFrame, log: DataFrame, query: str = "qi", text: str = "qn", *, k: int = NEIGHBOURS, min_sim: float = MIN_SIM, decimals: int = 6) -> DataFrame:
    """(query, qn, sim): the k most similar log texts of each query by TF-IDF of character n-grams, similarity at least ``min_sim``.

    The same text asked by several queries is compared once. Vectors meet as blocks of queries in broadcast with the texts where they are: no n-gram is a join key,
    so none is hot, and only the best of each task travel.
    """
    known = log_texts(log).withColumnRenamed("qn", "log_text")
    weights, vocabulary = tfidf(known, "log_text", char_ngrams(F.col("log_text")))
    asked = stage(queries.select(F.col(text).alias("asked")).distinct(), "asked")
    mine, _ = tfidf(asked, "asked", char_ngrams(F.col("asked")), vocabulary=vocabulary)
    rows = lambda df, key: df.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("v")).select(key, F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))
    found = sparse_neighbours(rows(mine, "asked"), rows(weights, "log_text"), "asked", "log_text", k, least=min_sim, size=TEXT_BLOCK, decimals=decimals)
    best = top_k(found, ["asked"], "sim", "log_text", k)
    return queries.select(query, F.col(text).alias("asked")).join(best, "asked").select(query, F.col("log_text").alias("qn"), "sim")


def click_shares(log: DataFrame) -> DataFrame:
    """(qn, item_id, n, share): clicks of a text on each item and their share of the text's clicks."""
    return row_shares(log.groupBy("qn", "item_id").agg(F.count(F.lit(1)).alias("n")), ["qn"], "n", least=1.0)


def text_profiles(shares: DataFrame, title_terms: DataFrame) -> DataFrame:
    """(qn, term, value): share of a text's clicks on items whose title has the term. ``title_terms`` (item_id, term), distinct."""
    return shares.join(title_terms, "item_id").groupBy("qn", "term").agg(F.sum("share").alias("value"))


def text_microcats(shares: DataFrame, items: DataFrame) -> DataFrame:
    """(qn, item_microcat_id, value)."""
    return shares.join(items.select("item_id", "item_microcat_id"), "item_id").groupBy("qn", "item_microcat_id").agg(F.sum("share").alias("value"))


def translations(log: DataFrame, profiles: DataFrame, position: str, stems: str = "q_terms", *, k: int = TRANSLATIONS, decimals: int = 6) -> DataFrame:
    """(source, term, value): title terms a query term stands for, P(w|t) ln max(P(w|t) / P(w), 1), the k best per query term.

    Only query terms of at least two texts count. P(w) is a mean over all texts, those without profile too. A text's terms are those of its first row.
    """
    first = first_by(log, ["qn"], [F.asc(position)])
    texts = first.select("qn", F.explode(F.array_distinct(stems)).alias("source"))
    frequent = texts.groupBy("source").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= 2)
    n_all = log_texts(log).groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    overall = profiles.groupBy("term").agg((F.sum("value") / n_all + 1e-6).alias("p_w"))
    joint = texts.join(frequent, "source").join(profiles, "qn").groupBy("source", "n_texts", "term").agg((F.sum("value")).alias("s"))
    p = joint.join(overall, "term").withColumn("p", F.col("s") / F.col("n_texts"))
    lifted = p.withColumn("value", F.round(F.col("p") * F.log(F.greatest(F.col("p") / F.col("p_w"), F.lit(1.0))), decimals)).where(F.col("value") > 0)
    return top_k(lifted.select("source", "term", "value"), ["source"], "value", "term", k)


def through_neighbours(near: DataFrame, table: DataFrame, key: str, query: str = "qi") -> DataFrame:
    """(query, key, value): sim^2-weighted sum of the neighbours' values."""
    return near.join(table, "qn").groupBy(query, key).agg(F.sum(F.col("sim") * F.col("sim") * F.col("value")).alias("value"))


def query_profiles(near: DataFrame, profiles: DataFrame, query: str = "qi", k: int = PROFILE_TERMS, decimals: int = 6) -> DataFrame:
    """(query, term, value): shares first, then the k largest, which are not brought to sum 1 again."""
    shares = row_shares(through_neighbours(near, profiles, "term", query), [query], "value")
    return top_k(shares.select(query, "term", F.round("share", decimals).alias("value")), [query], "value", "term", k)


def query_translations(terms: DataFrame, table: DataFrame, query: str = "qi", k: int = PROFILE_TERMS, decimals: int = 6) -> DataFrame:
    """(query, term, value) for a query's own terms (query, term)."""
    own = terms.withColumnRenamed("term", "source")
    shares = row_shares(own.join(table, "source").groupBy(query, "term").agg(F.sum("value").alias("value")), [query], "value")
    return top_k(shares.select(query, "term", F.round("share", decimals).alias("value")), [query], "value", "term", k)


def query_microcats(near: DataFrame, microcats: DataFrame, query: str = "qi") -> DataFrame:
    """(query, item_microcat_id, pmc), summing to 1 per query."""
    return row_shares(through_neighbours(near, microcats, "item_microcat_id", query), [query], "value").select(query, "item_microcat_id", F.col("share").alias("pmc"))


def query_history(near: DataFrame, clicks: DataFrame, query: str = "qi") -> DataFrame:
    """(query, item_id, hist_nb, hist_exact): clicks of the neighbours on corpus items, weighted by sim^2, and of equal texts, unweighted."""
    sim = F.col("sim")
    return near.join(clicks, "qn").groupBy(query, "item_id").agg(F.sum(sim * sim * F.col("n")).alias("hist_nb"), F.sum(F.when(sim > EXACT, F.col("n")).otherwise(0)).alias("hist_exact"))


def item_history(log: DataFrame, corpus: DataFrame) -> DataFrame:
    """(item_id, n_clicks) for every corpus item."""
    clicks = log.groupBy("item_id").agg(F.count(F.lit(1)).alias("__n"))
    return corpus.select("item_id").join(clicks, "item_id", "left").select("item_id", F.coalesce("__n", F.lit(0)).alias("n_clicks"))


def neighbour_strength(queries: DataFrame, near: DataFrame, query: str = "qi") -> DataFrame:
    """(query, q_nb_max, q_nb_cnt), 0 for queries without neighbours."""
    agg = near.groupBy(query).agg(F.max("sim").alias("__m"), F.count(F.lit(1)).alias("__c"))
    return queries.select(query).join(agg, query, "left").select(query, F.coalesce("__m", F.lit(0.0)).alias("q_nb_max"), F.coalesce("__c", F.lit(0)).alias("q_nb_cnt"))
