"""A stated set of queries against all rows: blocks of queries in broadcast, the best rows of each task, nothing else travels.

Queries are read block by block from a staged table, so the driver and each worker hold one block of a documented size
at a time, however many queries there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.staging import stage

#: Cells of a score matrix that a worker holds at a time; bounds its memory only.
CELLS = 2_000_000
#: Best rows a worker holds before it cuts them to the k best of each query.
HELD = 2_000_000
#: The least number, which all scores but minus infinity reach.
LEAST = np.finfo(float).min


def width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed over all tasks by ``keys``. Rows multiply in the join that follows, so partitions must not be merged by their size before it."""
    return df.repartition(width(df.sparkSession), *keys)


def query_blocks(queries: DataFrame, key: str, size: int) -> Iterator[pa.Table]:
    """The rows of ``queries`` as Arrow tables of about ``size`` rows each, by a hash of ``key``; at least one table."""
    held = stage(queries, "block-queries")
    blocks = max(1, -(-held.count() // size))
    if blocks > 1:
        held = stage(held.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), "blocks", partition_by=["__block"])
    for b in range(blocks):
        yield (held.where(F.col("__block") == b).drop("__block") if blocks > 1 else held).toArrow()


class Best:
    """The k best rows of each query among those added: by score descending, then name ascending."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.parts, self.size = k, np.full(queries, -np.inf), [], 0

    def add(self, score: np.ndarray, names: pa.Array, extra: np.ndarray | None = None, least: float = -np.inf) -> None:
        """``score`` (queries, names); ``extra``, of the same shape, travels with it. Rows below ``least`` are left out."""
        n = score.shape[1]
        floor = np.maximum(np.maximum(self.floor, least), LEAST)[:, None]
        good = score >= floor
        if n > self.k and np.count_nonzero(good) > len(score) * self.k // 2:  # of few rows all are kept until the next cut
            good = score >= np.maximum(floor, np.partition(score, n - self.k, axis=1)[:, [n - self.k]])
        q, d = np.nonzero(good)
        if len(q):
            self.parts.append(pa.table({"q": pa.array(q), "s": pa.array(score[q, d]), "name": names.take(pa.array(d)), "x": pa.array(score[q, d] if extra is None else extra[q, d])}))
            self.size += len(q)
            if self.size > HELD:
                self.cut()

    def cut(self) -> pa.Table:
        if not self.parts:
            return pa.table({"q": pa.array([], pa.int64()), "s": pa.array([], pa.float64()), "name": pa.array([], pa.null()), "x": pa.array([], pa.float64())})
        rows = pa.concat_tables(self.parts).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("q", "ascending"), ("s", "descending"), ("name", "ascending")]))
        q = rows["q"].to_numpy()
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(rank == self.k - 1)
        self.floor[q[last]] = rows["s"].to_numpy()[last]
        rows = rows.filter(pa.array(rank < self.k))
        self.parts, self.size = [rows], rows.num_rows
        return rows


@dataclass
class SparseRows:
    """Rows of a sparse matrix by column: for each term the queries that have it, and their values.

    Terms of more than a quarter of the queries make a dense matrix (at most four times the mean number of terms of a query), the others postings.
    """

    n: int
    terms: pa.Array
    start: np.ndarray
    row: np.ndarray
    value: np.ndarray
    dense: np.ndarray
    dense_at: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array, weights: pa.Array) -> SparseRows:
        """``lists``: terms of each query; ``weights``: their values."""
        n, sizes = len(lists), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        flat, w = pc.dictionary_encode(lists.flatten()), np.asarray(weights.flatten(), float)
        code, row = np.asarray(flat.indices, np.int64), np.repeat(np.arange(n), sizes)
        count = np.bincount(code, minlength=len(flat.dictionary)) if len(code) else np.zeros(len(flat.dictionary), np.int64)
        common = np.flatnonzero(count > max(n // 4, 8))
        dense_at = np.full(len(count), -1)
        dense_at[common] = np.arange(len(common))
        dense = np.zeros((n, len(common)))
        much = dense_at[code] >= 0
        dense[row[much], dense_at[code[much]]] = w[much]
        code, row, w = code[~much], row[~much], w[~much]
        order = np.argsort(code, kind="stable")
        start = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(count)))])
        return cls(n, flat.dictionary, start, row[order], w[order], dense, dense_at)

    def products(self, lists: pa.Array, weights: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, products) for slices of rows given as terms and values: the inner products of all queries with each of them, as (queries, rows)."""
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        code = np.asarray(pc.fill_null(pc.index_in(lists.flatten(), value_set=self.terms), -1), np.int64)
        w, doc = np.asarray(weights.flatten(), float), np.repeat(np.arange(len(sizes)), sizes)
        step = max(1, CELLS // max(self.n, 1))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        for at in range(0, len(sizes), step):
            m = min(step, len(sizes) - at)
            part = slice(ends[at], ends[at + m])
            c, v, d = code[part], w[part], doc[part] - at
            c, v, d = c[c >= 0], v[c >= 0], d[c >= 0]
            much = self.dense_at[c] >= 0
            y = np.zeros((m, self.dense.shape[1]))
            np.add.at(y, (d[much], self.dense_at[c[much]]), v[much])
            out = self.dense @ y.T
            c, v, d = c[~much], v[~much], d[~much]
            length = self.start[c + 1] - self.start[c]
            total = int(length.sum())
            if total:
                place = np.arange(total) + np.repeat(self.start[c] - np.cumsum(length) + length, length)
                cell = self.row[place] * m + np.repeat(d, length)
                out += np.bincount(cell, self.value[place] * np.repeat(v, length), self.n * m).reshape(self.n, m)
            yield at, out


def sparse_neighbours(queries: DataFrame, docs: DataFrame, query: str, doc: str, k: int, *, least: float, size: int, decimals: int = 6, terms: str = "terms", weights: str = "weights") -> DataFrame:
    """(query, doc, sim): the k best docs of each query by inner product of at least ``least``; both sides have arrays of terms and values."""
    spark, out = docs.sparkSession, None
    q_type, d_type = dict(queries.dtypes)[query], dict(docs.dtypes)[doc]
    docs = spread(docs, doc)
    for block in query_blocks(queries.select(query, terms, weights), query, size):
        shared = spark.sparkContext.broadcast((block.column(0).combine_chunks(), SparseRows.of(block.column(1).combine_chunks(), block.column(2).combine_chunks())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, rows = shared.value
            best = Best(len(ids), k)
            for batch in batches:
                for at, product in rows.products(batch.column(1), batch.column(2)):
                    best.add(np.round(product, decimals), batch.column(0).slice(at, product.shape[1]), least=least)
            found = best.cut()
            if found.num_rows:
                yield from pa.table({query: ids.take(found["q"].combine_chunks()), doc: found["name"], "sim": found["s"]}).to_batches()

        part = docs.select(doc, terms, weights).mapInArrow(run, f"{query} {q_type}, {doc} {d_type}, sim double")
        out = part if out is None else out.unionByName(part)
    return out
