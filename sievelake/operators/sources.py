"""The seven candidate sources and their union with flags.

Each source is a score by (query, item) plus the location prior and the filter bonus, cut to its best K. Two prepared tables
serve all of them: queries as (query, s_loc, wants, n_cons) and items as (item_id, item_loc, item_microcat_id, reviews, codes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.operators.blocks import CELLS, Best, query_blocks
from sievelake.operators.filters import fraction, item_codes, query_codes
from sievelake.operators.index import Bm25Index, small_side
from sievelake.operators.location import LOWEST, Prior
from sievelake.operators.search import best
from sievelake.operators.windows import top_k
from sievelake.staging import stage

#: Sizes of the sources, weights of location, similarity, filter and reviews.
K = {"all": 200, "title": 100, "prof": 100, "tr": 100, "hist": 50, "mc": 50, "emb": 100}
LAMBDA, ALPHA, FILTER, REVIEWS = 2.0, 40.0, 0.5, 0.1
#: Query vectors of one block (10 MB at 128 values); rows of the prior that travel with a block, beyond which it is halved.
QUERY_BLOCK, PRIOR_ROWS = 10_000, 2_000_000
#: Items that a task reads; cells of (query, item) from which a further task pays.
ITEM_PART, TASK_CELLS = 4_000_000, 20_000_000


def query_side(queries: DataFrame, wanted: DataFrame | None, query: str = "qi") -> DataFrame:
    """(query, s_loc, wants, n_cons) of queries with search_location_id; ``wanted`` from ``filters.query_values``."""
    out = queries.select(query, F.col("search_location_id").cast("long").alias("s_loc"))
    if wanted is None:
        return out.select("*", F.lit(None).cast("array<string>").alias("wants"), F.lit(None).cast("long").alias("n_cons"))
    return out.join(small_side(query_codes(wanted, query)), query, "left")


def item_side(items: DataFrame, values: DataFrame | None) -> DataFrame:
    """(item_id, item_loc, item_microcat_id, reviews, codes) of items with item_location_id; ``values`` from ``filters.item_values``."""
    out = items.select("item_id", F.col("item_location_id").cast("long").alias("item_loc"), "item_microcat_id", "reviews")
    if values is None:
        return out.withColumn("codes", F.lit(None).cast("array<string>"))
    return out.join(item_codes(values, "item_id"), "item_id", "left")


def with_context(pairs: DataFrame, queries: DataFrame, items: DataFrame, prior: Prior, query: str = "qi") -> DataFrame:
    """``pairs`` (query, item_id, ...) with s_loc, item_loc, loc_p, loc_same, loc_dist, loc_logp and fb (0 without a match), all computed for these pairs only."""
    out = pairs.join(small_side(queries), query).join(items.select("item_id", "item_loc", "codes"), "item_id")
    out = out.withColumn("fb", fraction(F.col("wants"), F.col("n_cons"), F.col("codes"))).drop("wants", "n_cons", "codes")
    return prior.attach(out)


def cut(pairs: DataFrame, score: Column, name: str, query: str = "qi", k: int | None = None, decimals: int = 6) -> DataFrame:
    """Best K of a source: (query, item_id, source)."""
    return top_k(pairs.withColumn("__s", F.round(score, decimals)), [query], "__s", "item_id", k or K[name]).select(query, "item_id", F.lit(name).alias("source"))


def text_search(index: Bm25Index, terms: DataFrame, name: str, queries: DataFrame, items: DataFrame, near: DataFrame, *, value: str | None = None, filtered: bool = True, query: str = "qi") -> DataFrame:
    """all, title, prof, tr: text score, prior and filter of all pairs with a common term, without their table: scores are cut to the best K where they are added up."""
    found = best(index, terms, query, K[name], value=value, asked=queries, items=items, near=near, filtered=filtered, location=LAMBDA, share=FILTER)
    return found.select(query, "item_id", F.lit(name).alias("source"))


def history_source(pairs: DataFrame, query: str = "qi") -> DataFrame:
    """hist: ``pairs`` with hist_nb and loc_logp; the prior counts once, the filter not at all."""
    return cut(pairs, F.log(F.col("hist_nb") + 1e-3) + F.col("loc_logp"), "hist", query)


def _located(items: DataFrame, near: DataFrame, by: list[str], k: int) -> DataFrame:
    """(s_loc, by, item_id, reviews, loc_logp): of each search location and group, the best ``k`` items that are near."""
    groups = top_k(items.where(F.col("item_loc").isNotNull()), [*by, "item_loc"], "reviews", "item_id", k)
    rows = groups.join(small_side(near.select("s_loc", "item_loc", "loc_logp")), "item_loc")
    rows = rows.withColumn("__base", LAMBDA * F.col("loc_logp") + REVIEWS * F.col("reviews"))
    return top_k(rows, ["s_loc", *by], "__base", "item_id", k).select("s_loc", *by, "item_id", "reviews", "loc_logp")


def _anywhere(items: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, item_id, reviews, loc_logp) of the best ``k`` items of each group at the floor, which every item reaches from anywhere."""
    return top_k(items, by, "reviews", "item_id", k).select(*by, "item_id", "reviews", F.lit(LOWEST).alias("loc_logp"))


def _best_overall(asked: DataFrame, items: DataFrame, near: DataFrame, k: int, query: str) -> DataFrame:
    """(query, item_id, reviews, loc_logp, ...): per query the best ``k`` items near its location and the best ``k`` of all at the floor."""
    world = items.orderBy(F.desc("reviews"), "item_id").limit(k).groupBy().agg(F.collect_list(F.struct("item_id", "reviews")).alias("w")).scalar()
    far = asked.withColumn("__w", F.explode(world)).select("*", "__w.item_id", "__w.reviews", F.lit(LOWEST).alias("loc_logp")).drop("__w")
    return asked.join(small_side(_located(items, near, [], k)), "s_loc").select(*far.columns).unionByName(far)


def microcat_source(queries: DataFrame, pmc: DataFrame, items: DataFrame, near: DataFrame, query: str = "qi", k: int | None = None) -> DataFrame:
    """mc: the best items by category share, location, reviews and filter, for queries with any share.

    The score sees an item only through category, location, reviews and filter values, and rises with reviews. So four kinds of rows hold the
    best 50 of every query: the best 50 of each (search location, category) for the query's own categories, the best 50 of each (search location, set of filter
    values, category) for sets that hold a wanted value, and the best 50 of the location whatever their category, each from near
    and, at the prior's floor, from anywhere. A row's true score is never below one of these, so the largest per item counts.
    """
    k = k or K["mc"]
    asked = stage(queries.join(pmc.select(query).distinct(), query, "left_semi"), "mc-queries")
    slim = items.select("item_id", "item_loc", "item_microcat_id", "reviews", "codes")
    own = pmc.select(query, F.col("item_microcat_id").alias("__mc"), "pmc")
    by_mc, by_set = ["item_microcat_id"], ["item_microcat_id", "codes"]
    on_mc = F.col("item_microcat_id") == F.col("__mc")
    wishes = asked.select(query, "s_loc", "wants", "n_cons", F.explode("wants").alias("wish"))
    coded = slim.where(F.size("codes") > 0)
    opened = lambda df: small_side(df.withColumn("wish", F.explode("codes")))
    shares = asked.join(own, query)
    near_mc, far_mc = small_side(_located(slim, near, by_mc, k).withColumnRenamed("s_loc", "__at")), small_side(_anywhere(slim, by_mc, k))
    near_set, far_set = opened(_located(coded, near, by_set, k)), opened(_anywhere(coded, by_set, k))
    none = F.lit(None).cast("array<string>")
    columns = [query, "item_id", "item_microcat_id", "reviews", "loc_logp", "wants", "n_cons", "codes"]
    rows = shares.join(near_mc, on_mc & (F.col("s_loc") == F.col("__at"))).withColumn("codes", none).select(*columns)
    rows = rows.unionByName(shares.join(far_mc, on_mc).withColumn("codes", none).select(*columns))
    rows = rows.unionByName(_best_overall(asked, slim, near, k, query).withColumn("item_microcat_id", F.lit(None).cast(dict(slim.dtypes)["item_microcat_id"])).withColumn("codes", none).select(*columns))
    rows = rows.unionByName(wishes.join(near_set, ["s_loc", "wish"]).select(*columns)).unionByName(wishes.join(far_set, "wish").select(*columns))
    rows = rows.join(small_side(own.withColumnRenamed(query, "__q")), (F.col(query) == F.col("__q")) & on_mc, "left")
    score = F.log(F.coalesce("pmc", F.lit(0.0)) + 1e-3) + LAMBDA * F.col("loc_logp") + REVIEWS * F.col("reviews") + FILTER * fraction(F.col("wants"), F.col("n_cons"), F.col("codes"))
    once = rows.select(query, "item_id", F.round(score, 6).alias("__s")).groupBy(query, "item_id").agg(F.max("__s").alias("__s"))
    return top_k(once, [query], "__s", "item_id", k).select(query, "item_id", F.lit("mc").alias("source"))


def popular_source(queries: DataFrame, items: DataFrame, near: DataFrame, query: str = "qi", k: int = 50) -> DataFrame:
    """Fallback for queries no other source answers: near items with many reviews."""
    rows = _best_overall(queries.select(query, "s_loc"), items.select("item_id", "item_loc", "reviews"), near, k, query)
    once = rows.withColumn("__s", F.round(LAMBDA * F.col("loc_logp") + REVIEWS * F.col("reviews"), 6)).groupBy(query, "item_id").agg(F.max("__s").alias("__s"))
    return top_k(once, [query], "__s", "item_id", k).select(query, "item_id", F.lit("mc").alias("source"))


def vector_scores(
    queries: DataFrame, items: DataFrame, query: str, item: str, vector: str, k: int, *, near: DataFrame | None = None, filtered: bool = False, decimals: int = 6, alpha: float = 1.0, size: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """(query, item, sim, total, sim_max): the k best items of each query by ``alpha`` times the cosine in double, plus, with ``near``, the weighted prior
    of (s_loc, item_loc) and, if ``filtered``, the weighted share of matched filter values (wants and n_cons of queries, codes of items).

    A stated set of queries against all items: a task has a block of queries and reads the items, of a great many a part, so that it returns k rows a query
    and the maximum over its items, whatever the number of tasks. Items are staged once and not shuffled for it.
    Vectors of another length than most queries' of the block, null, NaN or zero ones take no part.
    """
    spark, found = items.sparkSession, []
    extra_q = (["s_loc"] if near is not None else []) + (["wants", "n_cons"] if filtered else [])
    extra_i = (["item_loc"] if near is not None else []) + (["codes"] if filtered else [])
    q_type, i_type = dict(queries.dtypes)[query], dict(items.dtypes)[item]
    schema = f"{query} {q_type}, {item} {i_type}, sim double, total double, task_max double"
    table = None if near is None else stage(near.select("s_loc", "item_loc", "loc_logp"), "near-prior")
    asked = stage(queries.select(query, vector, *extra_q).where(F.col(vector).isNotNull()), "vector-queries")
    held = stage(items.select(item, vector, *extra_i), "vector-items")
    n_queries, n_items = asked.count(), held.count()
    parts = parts or max(1, -(-n_items // ITEM_PART))
    tasks = min(2 * spark.sparkContext.defaultParallelism, max(1, n_queries * n_items // TASK_CELLS))
    size = size or max(1, min(QUERY_BLOCK, -(-n_queries * parts // tasks)))
    side = held.coalesce(parts)

    def search(block: pa.Table) -> None:
        prior = None
        if table is not None:
            asked = spark.createDataFrame([(x,) for x in pc.unique(block["s_loc"]).to_pylist() if x is not None], "s_loc long")
            rows = table.join(F.broadcast(asked), "s_loc")
            if rows.count() > PRIOR_ROWS and block.num_rows > 1:
                half = block.num_rows // 2
                search(block.slice(0, half))
                search(block.slice(half))
                return
            prior = rows.toArrow()
        shared = spark.sparkContext.broadcast((block, prior))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q = _QueryBlock.of(*shared.value, filtered)
            best, top = Best(len(q.ids), k), np.full(len(q.ids), -np.inf)
            for batch in batches:
                rows, x = _unit_rows(batch.column(1), q.x.shape[1])
                step = max(1, CELLS // max(len(q.ids), 1))
                for at in range(0, len(rows) if len(q.ids) else 0, step):
                    mine = pa.array(rows[at : at + step])
                    sim = np.round(q.x @ x[at : at + step].T, decimals)
                    np.maximum(top, sim.max(1), out=top)
                    total = sim * alpha
                    total += q.bonus(*[batch.column(j).take(mine) for j in range(2, batch.num_columns)])
                    best.add(np.round(total, decimals, out=total), batch.column(0).take(mine), sim)
            rows = best.cut()
            if rows.num_rows:
                at = rows["q"].to_numpy()
                yield from pa.table({query: q.ids.take(pa.array(at)), item: rows["name"], "sim": rows["x"], "total": rows["s"], "task_max": top[at]}).to_batches(max_chunksize=500_000)

        found.append(side.mapInArrow(run, schema))

    for block in query_blocks(asked, query, size):
        search(block)
    # parts of one partition each would be zipped to a single task by the union, were they all of one partitioning
    out = found[0].repartition(2, query) if parts == 1 and len(found) > 1 else found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    if parts == 1:
        return out.withColumnRenamed("task_max", "sim_max")
    out = out.withColumn("sim_max", F.max("task_max").over(Window.partitionBy(query)))
    return top_k(out, [query], "total", item, k).select(query, item, "sim", "total", "sim_max")


class _QueryBlock:
    """Unit vectors of a block with what its bonus needs: the rows of the prior from its locations, and who wants which filter value."""

    @classmethod
    def of(cls, block: pa.Table, prior: pa.Table | None, filtered: bool) -> _QueryBlock:
        self = cls()
        vectors = block.column(1).combine_chunks() if block.num_rows else pa.array([], pa.list_(pa.float32()))
        sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
        width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        rows, self.x = _unit_rows(vectors, width)
        kept = block.take(pa.array(rows)) if len(rows) else block.slice(0, 0)
        self.ids, self.prior, self.wish = kept.column(0).combine_chunks(), None, None
        if prior is not None:
            places, at = np.unique(np.asarray(pc.fill_null(kept["s_loc"], -(1 << 62)), np.int64), return_inverse=True)
            s, i, p = (prior[c].to_numpy() for c in ("s_loc", "item_loc", "loc_logp"))
            j = np.searchsorted(places, s)
            known = (j < len(places)) & (places[np.minimum(j, len(places) - 1)] == s) if len(places) else np.zeros(len(s), bool)
            columns, col = np.unique(i, return_inverse=True)
            order = np.lexsort((j[known], col[known]))
            self.prior = (at, len(places), columns, np.concatenate([[0], np.cumsum(np.bincount(col[known], minlength=len(columns)))]), j[known][order], p[known][order])
        if filtered:
            n_cons = np.asarray(pc.fill_null(kept["n_cons"], 1), float)
            wants = kept["wants"].combine_chunks()
            sizes = np.asarray(pc.fill_null(pc.list_value_length(wants), 0))
            code = pc.dictionary_encode(wants.flatten())
            row, c = np.repeat(np.arange(len(sizes)), sizes), np.asarray(code.indices, np.int64)
            order = np.argsort(c, kind="stable")
            start = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(code.dictionary)))]).astype(np.int64)
            self.wish = (code.dictionary, start, row[order], n_cons)
        return self

    def bonus(self, *columns: pa.Array) -> np.ndarray | float:
        """(queries, items): the weighted prior and filter share."""
        out, columns = 0.0, list(columns)
        if self.prior is not None:
            at, n_places, known, start, j, p = self.prior
            loc = np.asarray(pc.fill_null(columns.pop(0), -(1 << 62)), np.int64)
            places, inverse = np.unique(loc, return_inverse=True)
            table = np.full((n_places, len(places)), LOWEST)
            for m, place in enumerate(places):  # distinct item locations of the slice
                c = np.searchsorted(known, place)
                if c < len(known) and known[c] == place:
                    table[j[start[c] : start[c + 1]], m] = p[start[c] : start[c + 1]]
            out = out + LAMBDA * table[at][:, inverse]
        if self.wish is not None:
            names, start, row, n_cons = self.wish
            codes = columns.pop(0)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(codes), 0))
            c, d = np.asarray(pc.fill_null(pc.index_in(codes.flatten(), value_set=names), -1), np.int64), np.repeat(np.arange(len(sizes)), sizes)
            match = np.zeros((len(n_cons), len(sizes)))
            for a in np.unique(c[c >= 0]):  # filter values that both sides have
                match[np.ix_(row[start[a] : start[a + 1]], d[c == a])] += 1
            out = out + FILTER * match / n_cons[:, None]
        return out


def _unit_rows(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors in double) of the usable rows with ``width`` values."""
    rows = np.flatnonzero(np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == width)
    if not len(rows) or not width:
        return np.zeros(0, np.int64), np.zeros((0, width))
    x = np.asarray(pc.fill_null(column.take(pa.array(rows)).flatten(), float("nan")), float).reshape(-1, width)
    n = np.sqrt((x * x).sum(1))
    ok = np.isfinite(n) & (n > 0)
    return rows[ok], x[ok] / n[ok, None]


def union_sources(sources: list[DataFrame], query: str = "qi", item: str = "item_id") -> DataFrame:
    """(query, item, src_all ... src_emb): each candidate once, with a flag per source."""
    if not sources:
        raise ValueError("no sources")
    rows = sources[0]
    for s in sources[1:]:
        rows = rows.unionByName(s)
    flags = [F.max((F.col("source") == name).cast("byte")).alias(f"src_{name}") for name in K]
    return rows.groupBy(query, item).agg(*flags)
