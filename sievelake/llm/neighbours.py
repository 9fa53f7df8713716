"""The k most similar vectors of every vector, by randomly rotated one-bit codes.

Cells grow with the collection: coarse centroids are fitted on a bounded sample, and each coarse cell fits its own share of fine centroids where its
sample is. A vector goes to its nearest fine cell, and a copy to further cells that are almost as near, so that neighbours meet although a border parts them; cells
with many vectors are searched as blocks of queries times blocks of data. In a cell, the residual of every vector is
rotated at random and reduced to the signs of its coordinates with two correction scalars. Inner products are estimated from the packed bits by bit counts; an
error bound makes an interval of each estimate, and only vectors whose interval reaches the k-th best are compared exactly.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.staging import stage


@dataclass(frozen=True)
class KnnParams:
    """k neighbours; at least ``min_similarity``; ``margin`` and ``max_cells``: copies to cells at most so much less similar than the nearest.

    All vectors are indexed. There are as many fine cells as vectors divided by ``cell_size``, or a ``root_share`` of the root of the number of vectors if that is more (at most
    ``max_centroids``), and about as many coarse ones as the root of that. Coarse centroids are fitted on about ``sample`` vectors; fine ones, and the estimate of the cells' sizes, on about ``per_cell`` a cell, at
    least ``least_sample``. ``probes`` coarse cells are looked at to find a vector's cells. A cell estimated at over ``block`` vectors is searched in blocks of about that many.
    ``error`` scales the bound of the estimate: 1.9 misses about one true neighbour in thousands, 3.0 practically none.
    """

    dim: int = 128
    k: int = 5
    min_similarity: float = 0.8
    sample: int = 20_000
    rounds: int = 6
    cell_size: int = 400
    root_share: float = 0.25
    max_centroids: int = 65_536
    per_cell: int = 64
    least_sample: int = 8_000
    probes: int = 12
    margin: float = 0.12
    max_cells: int = 4
    error: float = 3.0
    decimals: int = 6
    block: int = 4096
    seed: int = 7


#: Estimates a worker holds at a time; bounds its memory only.
CELLS_AT_ONCE = 500_000
#: Bits of a quantised query coordinate.
QUERY_BITS = 4


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(x: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means on unit vectors; cells of over four times the mean are divided."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(count, len(x)), replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.bincount(near, minlength=len(c))
        crowded = np.flatnonzero(size > 4 * max(1.0, len(x) / len(c)))
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c).astype(np.float32)
        free = np.flatnonzero(size == 0)
        for cell, slot in zip(crowded, free):
            c[slot] = x[rng.choice(np.flatnonzero(near == cell))]
    return np.ascontiguousarray(c)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def valid_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, vectors as stored) of the rows with ``dim`` finite values, not all zero."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length in double; scaled first, so that tiny or huge values neither vanish nor overflow."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    gap = -signs.shape[1] % 64
    return np.packbits(np.pad(signs, ((0, 0), (0, gap))), axis=1).view(np.uint64)


@dataclass
class BitCodes:
    """One-bit codes of vectors relative to a centre: packed signs, length of the residual, alignment of residual and code, signs set."""

    bits: np.ndarray
    length: np.ndarray
    align: np.ndarray
    ones: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> BitCodes:
        r = (x - centre).astype(np.float32) @ turn
        length = np.linalg.norm(r, axis=1)
        align = np.abs(r).sum(1) / np.maximum(length, 1e-12) / np.sqrt(r.shape[1])
        return cls(_packed(r > 0), length, align, (r > 0).sum(1).astype(np.float32))

    def estimate(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of unit queries with the coded unit vectors, and the bound of the error.

        With |q| = |x| = 1: q.x = 1 - (|q-c|^2 + |x-c|^2 - 2 (q-c).(x-c)) / 2. The product of residuals is estimated as (code . rotated query) / align, an
        unbiased estimate whose error is about sqrt(1/align^2 - 1) / sqrt(dim - 1). The rotated query is rounded to QUERY_BITS bits a coordinate, and
        its product with a code is a sum of bit counts of its bit planes and the code; rounding adds an error of about a step / sqrt(12).
        """
        dim = len(centre)
        r = (q - centre).astype(np.float32) @ turn
        low = r.min(1, keepdims=True)
        step = np.maximum(r.max(1, keepdims=True) - low, 1e-12) / ((1 << QUERY_BITS) - 1)
        level = np.rint((r - low) / step).astype(np.uint8)
        count = np.zeros((len(q), len(self.bits)), np.uint16)
        for j in range(QUERY_BITS):
            plane = _packed((level >> j & 1).astype(bool))
            for w in range(plane.shape[1]):
                count += np.bitwise_count(plane[:, w, None] & self.bits[None, :, w]).astype(np.uint16) << np.uint16(j)
        on = low * self.ones[None, :] + step * count  # sum of the query's coordinates where the sign is set
        whole = low[:, 0] * dim + step[:, 0] * level.sum(1, dtype=np.int64)
        scale = (self.length / np.maximum(self.align, 1e-6) / np.sqrt(dim)).astype(np.float32)
        dot = (2 * on - whole[:, None]) * scale
        own = (r * r).sum(1)
        est = 1 - (own[:, None] + (self.length**2)[None, :]) / 2 + dot
        spread = self.length * np.sqrt(np.maximum(1 / np.maximum(self.align, 1e-6) ** 2 - 1, 0)) * error / np.sqrt(max(dim - 1, 1))
        rounding = step[:, 0] * (error / np.sqrt(12.0) * np.sqrt(dim))
        return est, np.sqrt(own)[:, None] * spread[None, :] + rounding[:, None] * scale[None, :] + 1e-5


def search_cell(x: np.ndarray, ids: list[list[str]], queries: np.ndarray, data: np.ndarray, centre: np.ndarray, turn: np.ndarray, p: KnnParams) -> Iterator[tuple[int, list[tuple[float, str]]]]:
    """For each class (row) of ``queries``: its first k + 1 ids among ``data``, in order of similarity and id, its own among them.

    ``x`` unit vectors in double, one row per class of equal vectors; ids: the k + 2 smallest of each class.
    """
    codes = BitCodes.of(x[data], centre, turn)
    least = p.min_similarity - 10.0**-p.decimals
    step = max(16, CELLS_AT_ONCE // max(len(data), 1))
    for at in range(0, len(queries), step):
        rows = queries[at : at + step]
        est, bound = codes.estimate(x[rows], centre, turn, p.error)
        low = est - bound
        # k + 1 classes hold k ids beside the row's own: what can't reach the (k+1)-th lower bound is out
        floor = np.full(len(rows), least)
        if low.shape[1] > p.k + 1:
            floor = np.maximum(floor, np.partition(low, -(p.k + 1), axis=1)[:, -(p.k + 1)])
        qi, di = np.nonzero(est + bound >= floor[:, None] - 2 * 10.0**-p.decimals)
        di = data[di]
        exact = np.empty(len(qi))
        for s in range(0, len(qi), 20_000):
            exact[s : s + 20_000] = np.einsum("ij,ij->i", x[rows[qi[s : s + 20_000]]], x[di[s : s + 20_000]])
        exact = np.round(exact, p.decimals)
        keep = exact >= p.min_similarity
        qi, di, exact = qi[keep], di[keep], exact[keep]
        order = np.lexsort((-exact, qi))
        qi, di, exact = qi[order], di[order], exact[order]
        starts = np.searchsorted(qi, np.arange(len(rows) + 1))
        for j, row in enumerate(rows):
            a, b = starts[j], starts[j + 1]
            own = di[a:b] == row
            need, last = p.k + 1, None
            found = [(1.0, i) for i in ids[row]]
            for d, s in zip(di[a:b][~own], exact[a:b][~own]):
                if len(found) >= need and last is not None and s < last:
                    break
                found = found + [(float(s), i) for i in ids[d]]
                last = s
            found.sort(key=lambda t: (-t[0], t[1]))
            yield int(row), found[:need]


@dataclass
class Cells:
    """Coarse centroids, the fine ones of each in a row of their own, and into how many blocks each fine cell's vectors are dealt."""

    coarse: np.ndarray
    start: np.ndarray
    fine: np.ndarray
    blocks: np.ndarray

    def near(self, x: np.ndarray, p: KnnParams) -> tuple[np.ndarray, np.ndarray]:
        """(fine cells, similarities), ``max_cells`` for each unit vector, the nearest first; cell -1 where there are fewer."""
        m, probes = p.max_cells, min(p.probes, len(self.coarse))
        at = x @ self.coarse.T
        chosen = np.argpartition(at, -probes, axis=1)[:, -probes:]
        cell, value = np.full((len(x), probes * m), -1), np.full((len(x), probes * m), -np.inf, np.float32)
        for c in np.unique(chosen):
            row, slot = np.nonzero(chosen == c)
            a, b = self.start[c], self.start[c + 1]
            if a == b:
                continue
            s = x[row] @ self.fine[a:b].T
            k = min(m, b - a)
            j = np.argpartition(s, -k, axis=1)[:, -k:]
            to = slot[:, None] * m + np.arange(k)
            cell[row[:, None], to], value[row[:, None], to] = a + j, np.take_along_axis(s, j, 1)
        order = np.argsort(-value, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(cell, order, 1), np.take_along_axis(value, order, 1)


def fit_cells(rows: DataFrame, total: int, p: KnnParams) -> Cells | None:
    """Cells of the vectors in (item, vec); None if there is no valid one. What comes to the driver is bounded by ``sample`` and ``max_centroids``."""
    spark = rows.sparkSession
    picked = lambda n: rows.where(F.pmod(F.xxhash64("item", F.lit(p.seed)), F.lit(1_000_003)) < int(min(1.0, n / max(total, 1)) * 1_000_003))  # noqa: E731 - by hash, so that a lost task picks the same
    count = int(min(p.max_centroids, max(1.0, total / p.cell_size, p.root_share * total**0.5)))
    some = picked(p.sample).select("vec").toArrow().column(0).combine_chunks()
    x = valid_vectors(some, p.dim)[1] if len(some) else np.zeros((0, p.dim), np.float32)
    if not len(x):
        return None
    coarse = fit_centroids(unit(x).astype(np.float32), int(np.ceil(count**0.5)), p.rounds, p.seed)
    wanted = max(p.per_cell * count, p.least_sample)
    share = min(1.0, wanted / max(total, 1))
    shared = spark.sparkContext.broadcast(coarse)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = valid_vectors(batch.column(0), p.dim)[1]
            if len(v):
                u = unit(v).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(_nearest(u, shared.value).astype(np.int32)), pa.array([r.tobytes() for r in u], pa.binary())], names=["c", "u"])

    def refine(key: tuple, table: pa.Table) -> pa.Table:
        u = np.frombuffer(b"".join(table.column("u").to_pylist()), np.float32).reshape(-1, p.dim)
        u = u[np.lexsort(u.T[:3])]
        f = fit_centroids(u, max(1, round(count * len(u) / (share * total))), p.rounds, p.seed + key[0].as_py())
        size = np.bincount(_nearest(u, f), minlength=len(f))
        return pa.table({"c": pa.array([key[0].as_py()] * len(f), pa.int32()), "f": pa.array([r.tobytes() for r in f], pa.binary()), "n": pa.array(size, pa.int64())})

    found = picked(wanted).select("vec").mapInArrow(assign, "c int, u binary").groupBy("c").applyInArrow(refine, "c int, f binary, n long").toArrow()
    if not found.num_rows:
        found = pa.table({"c": pa.array([0], pa.int32()), "f": pa.array([coarse[0].tobytes()]), "n": pa.array([total], pa.int64())})
    c, n = found["c"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(c, kind="stable")
    fine = np.frombuffer(b"".join(found["f"].to_pylist()), np.float32).reshape(-1, p.dim)[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(c, minlength=len(coarse)))])
    return Cells(coarse, start, fine, np.maximum(1, np.ceil(n[order] / share / p.block)).astype(np.int64))


_ROUTED = "cell int, q_block int, d_block int, as_query boolean, as_data boolean, ids array<string>, vec binary"
_FOUND = "fp binary, cls binary, big boolean, own array<string>, found array<struct<s:double,i:string>>"


def nearest_neighbours(df: DataFrame, item: str, vector: str, params: KnnParams = KnnParams()) -> DataFrame:
    """(item, neighbour, similarity): the k most similar other items of each item, similarity at least ``min_similarity``.

    Similarity: cosine in double, rounded; equal ones by smaller neighbour. Rows whose vector is null, of another length, not finite or all
    zero, or whose item is null, are left out; repeated rows of an item count once (with different valid vectors: the one with the smallest hash). Equal vectors are one class: they are collapsed where they are read,
    so that a group of copies of any size reaches its cell as a few rows, and its members are joined to the class's result at the end.
    """
    p, spark = params, df.sparkSession
    rows = df.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{vector}`").cast("array<float>").alias("vec")).where(F.col("item").isNotNull() & (F.size("vec") == p.dim))
    # items whose valid rows differ: only hashes move, and the exceptions are joined away
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    marks = rows.where(valid).select("item", F.xxhash64("vec").alias("h")).groupBy("item").agg(F.min("h").alias("keep"), F.max("h").alias("top"))
    marks = stage(marks, "vector-hashes")
    twice = marks.where(F.col("keep") != F.col("top")).select(F.col("item").alias("ti"), "keep")
    n_twice, total = twice.count(), marks.count()
    if n_twice:
        twice = F.broadcast(twice) if n_twice <= 100_000 else twice
        rows = rows.join(twice, F.col("item") == F.col("ti"), "left").where(F.col("keep").isNull() | (F.xxhash64("vec") == F.col("keep"))).select("item", "vec")
    schema = "item string, neighbour string, similarity double"
    cells = fit_cells(rows, total, p)
    if cells is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((cells, rotation(p.dim, p.seed)))  # at most max_centroids vectors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value[0]
        for batch in batches:
            at, raw = valid_vectors(batch.column(1), p.dim)
            if not len(at):
                continue
            groups: dict[bytes, list[str]] = {}
            names = batch.column(0).take(pa.array(at)).to_pylist()
            first: list[int] = []
            for i, name in enumerate(names):
                have = groups.get(key := raw[i].tobytes())
                if have is None:
                    groups[key] = [name]
                    first.append(i)
                else:
                    have.append(name)
            ids, vecs = [sorted(set(g))[: p.k + 2] for g in groups.values()], list(groups)
            cell, value = c.near(unit(raw[first]).astype(np.float32), p)
            r, j = np.nonzero((value >= value[:, :1] - p.margin) & (cell >= 0))
            cell, home = cell[r, j], j == 0
            n = c.blocks[cell]
            mine = np.array([zlib.crc32(v) for v in vecs], np.int64)[r] % n
            # in a cell of n blocks a vector meets, as data, the queries of all, and as a query the data of all
            data = np.repeat(np.arange(len(r)), n)
            turn_ = np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)
            other = np.flatnonzero(home[data] & (turn_ != mine[data]))
            k = np.concatenate([data, data[other]])
            q_block, d_block = np.concatenate([turn_, mine[data[other]]]), np.concatenate([mine[data], turn_[other]])
            as_data = np.arange(len(k)) < len(data)
            as_query = home[k] & (q_block == mine[k])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(cell[k].astype(np.int32)), pa.array(q_block.astype(np.int32)), pa.array(d_block.astype(np.int32)), pa.array(as_query), pa.array(as_data),
                    pa.array([ids[i] for i in r[k]], pa.list_(pa.string())), pa.array([vecs[i] for i in r[k]], pa.binary()),
                ],
                names=["cell", "q_block", "d_block", "as_query", "as_data", "ids", "vec"],
            )

    def search(key: tuple, table: pa.Table) -> pa.Table:
        c, turn = shared.value
        classes: dict[bytes, list] = {}
        for q, d, ids, vec in zip(*(table.column(x).to_pylist() for x in ("as_query", "as_data", "ids", "vec"))):
            have = classes.setdefault(vec, [False, False, []])
            have[0] |= q
            have[1] |= d
            have[2] += ids
        ids = [sorted(set(i))[: p.k + 2] for _, _, i in classes.values()]
        x = unit(np.frombuffer(b"".join(classes), np.float32).reshape(-1, p.dim))
        flags = np.array([v[:2] for v in classes.values()], bool)
        keys, out = list(classes), ([], [], [], [], [])
        for row, found in search_cell(x, ids, np.flatnonzero(flags[:, 0]), np.flatnonzero(flags[:, 1]), c.fine[key[0].as_py()].astype(np.float64), turn, p):
            big = len(ids[row]) > p.k + 1
            if len(found) < 2:
                continue
            name = hashlib.blake2b(keys[row], digest_size=16).digest()
            for column, v in zip(out, (keys[row] if big else None, name, big, ids[row][: p.k + 1], [{"s": s, "i": i} for s, i in found])):
                column.append(v)
        types = [pa.binary(), pa.binary(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("s", pa.float64()), ("i", pa.string())]))]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=["fp", "cls", "big", "own", "found"])

    result = rows.mapInArrow(route, _ROUTED).groupBy("cell", "q_block", "d_block").applyInArrow(search, _FOUND)
    if (cells.blocks > 1).any():
        # a class of a divided cell was compared block by block: the best of all blocks are its neighbours
        parts = F.array_distinct(F.flatten(F.collect_list("found")))
        ranked = F.transform(F.array_sort(F.transform(parts, lambda f: F.struct((-f["s"]).alias("d"), f["i"].alias("i")))), lambda f: F.struct((-f["d"]).alias("s"), f["i"].alias("i")))
        result = result.groupBy("cls").agg(F.first("fp").alias("fp"), F.max("big").alias("big"), F.max("own").alias("own"), F.slice(ranked, 1, p.k + 1).alias("found"))

    def expand(df: DataFrame) -> DataFrame:
        others = F.slice(F.filter("found", lambda f: f["i"] != F.col("item")), 1, p.k)
        return df.select("item", F.explode(others).alias("f")).select("item", F.col("f.i").alias("neighbour"), F.col("f.s").alias("similarity"))

    out = expand(result.select(F.explode("own").alias("item"), "found"))
    # more items than a class carries share a vector: by its hash, a false alarm costs a join only
    if marks.groupBy("keep").count().where(F.col("count") > p.k + 1).limit(1).count():
        # members beyond those the class carries: their vectors' bytes are the class's name
        big = result.where("big").select(F.col("fp"), "own", "found")

        def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, raw = valid_vectors(batch.column(1), p.dim)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in raw], pa.binary())], names=["item", "name"])

        members = rows.mapInArrow(name, "item string, name binary").select("item", F.sha2("name", 256).alias("name"))
        rest = members.join(big.withColumn("name", F.sha2("fp", 256)), "name").where(~F.array_contains("own", F.col("item")))
        out = out.unionByName(expand(rest.select("item", "found").distinct()))
    return out


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(item_a, item_b), item_a < item_b, once for each pair of which one is among the neighbours of the other."""
    return found.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()
