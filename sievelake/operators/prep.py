"""From raw tables to the item table, the training pairs and the prepared queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import clean_params, stem_text
from sievelake.operators.windows import first_by

#: Fixed names of the input schema.
ITEM_COLS = [
    "item_id", "item_title_raw", "item_description_raw", "item_infm_params_text", "item_category_id", "item_microcat_id", "item_price", "item_rating",
    "item_rating_reviews_count", "item_location_id", "item_latitude", "item_longitude", "item_is_phone_hidden", "item_is_message_forbidden",
]
SEARCH_COLS = ["search_query", "search_location_id", "search_is_delivery_search", "search_infm_params_text", "search_category"]


def one_per_item(items: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row per item_id: the smallest value of each column (repeated rows differ in price at most). Combined before its one shuffle."""
    known, rest = items.where(F.col("item_id").isNotNull()), [c for c in (columns or items.columns) if c != "item_id"]
    return known.groupBy("item_id").agg(*[F.min(c).alias(c) for c in rest]) if rest else known.select("item_id").distinct()


def items_union(corpus: DataFrame, log: DataFrame, position: Sequence[Column]) -> DataFrame:
    """Corpus items, then each logged item the corpus lacks by its first row; the column in_bench tells them apart."""
    bench = corpus.withColumn("in_bench", F.lit(True))
    known = corpus.select("item_id").distinct()
    extra = first_by(log.join(known, "item_id", "left_anti"), ["item_id"], position)
    return bench.unionByName(extra.select(*corpus.columns).withColumn("in_bench", F.lit(False)))


def with_stems(items: DataFrame, *, max_chars: int | None = None) -> DataFrame:
    """Stemmed title, cleaned parameters and description (whole, or its first ``max_chars`` characters; the published job takes 1,000); the raw description is dropped."""
    out = items.withColumns(
        {"t_title": stem_text(F.col("item_title_raw")), "t_params": stem_text(clean_params(F.col("item_infm_params_text"))), "t_desc": stem_text(F.col("item_description_raw"), max_chars=max_chars)}
    )
    return out.withColumns({c: F.col(c).cast("double") for c in ("item_price", "item_latitude", "item_longitude")}).drop("item_description_raw")


def train_pairs(log: DataFrame, *extra: str) -> DataFrame:
    """Search columns, item and stems of the query, a row per log row. Stems are made once per distinct text."""
    texts = log.select("search_query").distinct().withColumn("q_stem", stem_text(F.col("search_query")))
    right = texts.withColumnRenamed("search_query", "__q")
    pairs = log.select(*SEARCH_COLS, "item_id", *extra).join(right, F.col("search_query").eqNullSafe(F.col("__q")), "left").drop("__q")
    return pairs


def prepare_queries(queries: DataFrame) -> DataFrame:
    return queries.withColumn("q_stem", stem_text(F.col("search_query")))
