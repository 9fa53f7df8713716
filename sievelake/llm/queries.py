"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.llm.distinctive import term_scores
from sievelake.llm.mixing import mix
from sievelake.llm.neighbours import KnnParams, nearest_neighbours, neighbour_pairs
from sievelake.llm.private import find_private, redact
from sievelake.llm.sentences import split_sentences
from sievelake.llm.tokenizer import encode_corpus
from sievelake.llm.topn import top_n
from sievelake.sources.tables import table
from sievelake.staging import stage

#: Folder of the public vocabularies; a parameter of the cluster, never copied here.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return f"{TOKENIZERS}/byte_bpe_50k.tiktoken", public_tokenizers.PATTERN


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 5 most similar others of every item with a similarity of 0.8 or more."""
    return nearest_neighbours(table(spark, sf, "emb_items_full", ["item_id", "embedding"]), "item_id", "embedding", KnnParams())


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_pairs(p2_neighbours(spark, sf))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts and identities in the items' descriptions."""
    items = table(spark, sf, "benchmark_items", ["item_id", "item_description_raw"])
    return find_private(items, "item_id", "item_description_raw").select("item_id", "kind", "found_text").distinct()


def p3_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions with typed placeholders, once an item."""
    items = table(spark, sf, "benchmark_items", ["item_id", "item_description_raw"])
    return redact(items, "item_description_raw").select("item_id", "redacted").dropDuplicates(["item_id"])


def p4_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihood ratio of every term of every item."""
    items = table(spark, sf, "benchmark_items", ["item_id", "item_title_raw", "item_description_raw"])
    return term_scores(items, "item_id", ["item_title_raw", "item_description_raw"]).withColumn("llr", F.round("llr", 4) + F.lit(0.0))


def p4_distinctive(spark: SparkSession, sf: str) -> DataFrame:
    """The at most 3 terms of each item with the highest positive log-likelihood ratio (ties: smaller term)."""
    best = Window.partitionBy("item_id").orderBy(F.desc("llr"), F.asc("term"))
    return p4_scores(spark, sf).where("llr > 0").withColumn("rn", F.row_number().over(best)).where("rn <= 3").select("item_id", "term", "llr")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The at most 3 best terms of each item among those of 2 to 12 items.

    The terms and their counts come from the operator, but this result's fixed score, n ln(N/df), ranks them. It leaves out what the likelihood ratio
    weighs: the length of the record and how often the term occurs in others; so the ratio itself is not needed here and Catalyst prunes it. The
    ranking by the ratio is ``p4_distinctive``.
    """
    items = table(spark, sf, "benchmark_items", ["item_id", "item_title_raw", "item_description_raw"])
    scored = term_scores(items, "item_id", ["item_title_raw", "item_description_raw"], df_range=(2, 12))
    weight = F.round(F.col("n") * F.log(F.col("n_records") / F.col("df")), 6)
    best = Window.partitionBy("item_id").orderBy(F.desc("w"), F.asc("term"))
    return scored.withColumn("w", weight).withColumn("rn", F.row_number().over(best)).where("rn <= 3").select("item_id", "term")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best candidates of each query."""
    return top_n(table(spark, sf, "candidates", ["qi", "ci", "score"]), "qi", "ci", "score", 50).select("qi", "ci")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as token ids."""
    return encode_corpus(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text", *vocabulary())


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf, "documents", ["doc_id", "source", "text"])
    targets = table(spark, sf, "mix_targets")
    # texts of sources without a target take no part, so they are not encoded
    wanted = docs.join(F.broadcast(targets.select("source")), "source", "left_semi")
    digest = F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")
    sizes = encode_corpus(wanted.select(F.struct("doc_id", "source", digest).alias("k"), "text"), "k", "text", *vocabulary(), ids="n_tokens", counts_only=True)
    return mix(sizes.select("k.doc_id", "k.source", "k.text_md5", "n_tokens"), "doc_id", "source", "text_md5", "n_tokens", targets)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Every use of a document in the mixture, with its shard and place."""
    return _mixture(spark, sf)[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target, planned and reached share of each source."""
    return _mixture(spark, sf)[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every document."""
    return split_sentences(table(spark, sf, "documents", ["doc_id", "text"]), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_scores": p4_scores, "p4_distinctive": p4_distinctive, "p6_found": p6_found,
    "p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p10_found": p10_found,
}

_TERMS = """
WITH one AS (SELECT item_id, max(lower(coalesce(item_title_raw, '') || ' ' || coalesce(item_description_raw, ''))) t FROM benchmark_items WHERE item_id IS NOT NULL GROUP BY 1),
w AS (SELECT item_id, unnest(regexp_extract_all(replace(t, 'ё', 'е'), '[0-9a-zа-я]+')) term FROM one),
n AS (SELECT item_id, term, count(*) n FROM w WHERE length(term) >= 4 AND NOT regexp_matches(term, '^[0-9]') GROUP BY 1, 2),
s AS (SELECT term, count(*) df, sum(n) cf FROM n GROUP BY 1),
len AS (SELECT item_id, sum(n) L FROM n GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM one) n_records, (SELECT sum(n) FROM n) T)
"""
_LLR = """SELECT item_id, term, n, df, n_records, round(CASE WHEN n * T >= L * cf THEN 2 ELSE -2 END * (
    n * ln(n / (L::DOUBLE * cf / T)) + CASE WHEN cf > n THEN (cf - n) * ln((cf - n) / ((T - L)::DOUBLE * cf / T)) ELSE 0 END
  + CASE WHEN L > n THEN (L - n) * ln((L - n) / (L::DOUBLE * (T - cf) / T)) ELSE 0 END
  + CASE WHEN T - L - cf + n > 0 THEN (T - L - cf + n) * ln((T - L - cf + n) / ((T - L)::DOUBLE * (T - cf) / T)) ELSE 0 END), 4) + 0.0 AS llr
FROM n JOIN s USING (term) JOIN len USING (item_id), tot"""
SQL = {
    "p2_found": """
WITH v AS (SELECT item_id, min(embedding::DOUBLE[]) e FROM emb_items_full WHERE len(embedding) = 128
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
s AS (SELECT a.item_id a, b.item_id b, round(list_cosine_similarity(a.e, b.e), 6) s FROM v a JOIN v b ON a.item_id <> b.item_id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) rn FROM s WHERE s >= 0.8)
SELECT DISTINCT least(a, b) AS item_a, greatest(a, b) AS item_b FROM r WHERE rn <= 5""",
    "p4_scores": _TERMS + "SELECT item_id, term, n, df, n_records, llr FROM (" + _LLR + ")",
    "p4_distinctive": _TERMS + "SELECT item_id, term, llr FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY llr DESC, term) rn FROM (" + _LLR + ") WHERE llr > 0) WHERE rn <= 3",
    "p4_found": _TERMS + """SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY round(n * ln(n_records / df), 6) DESC, term) rn
FROM n JOIN s USING (term), tot WHERE df BETWEEN 2 AND 12) WHERE rn <= 3""",
    "p6_found": """SELECT qi, ci FROM (SELECT qi, ci, row_number() OVER (PARTITION BY qi ORDER BY s DESC, ci) rn
FROM (SELECT qi, ci, max(score) s FROM candidates WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)) WHERE rn <= 50""",
}
