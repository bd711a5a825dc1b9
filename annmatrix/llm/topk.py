"""Exact top-k inner products by a Voronoi join: pivots, per-group bounds, only what is in reach copied, local solving."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, saved

#: Data rows of a piece that is solved at once; larger groups are cut, smaller ones share a piece.
BLOCK = 8192
#: Queries that meet a piece at once.
QUERY_BLOCK = 4096
#: Queries whose scores against a piece are held at once.
STRIPE = 256
#: Sums of products up to here are exact in double precision.
EXACT = float(1 << 53)
#: Pivots of a table of any size at most: their vectors are in the driver's memory.
MOST_PIVOTS = 20_000
#: Rounding of distances, as a share of the greatest norm, that bounds allow for.
SLACK = 1e-6
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def quantized(vectors: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the vectors that take part, and their components as whole doubles (the greatest double where scaling leaves the range)."""
    kept, out = [], []
    most = np.finfo(np.float64).max
    for i, v in enumerate(vectors.to_pylist()):
        if v is None or any(x is None for x in v):
            continue
        x = np.asarray(v, np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(scale * x), -most, most)
            kept.append(i)
            out.append(x)
    return np.array(kept, np.int64), out


def matrix(cells: list[bytes], width: int) -> np.ndarray:
    """Vectors of a width; shorter ones count as ending in zeros."""
    out = np.zeros((len(cells), width))
    for i, c in enumerate(cells):
        x = np.frombuffer(c, np.float64)
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole inner products, exactly; those beyond 64 bits are the nearest end of that range."""
    large_a, large_b = (np.abs(m).max(1, initial=0) for m in (a, b))
    width = max(1, a.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        exact = large_a[:, None] * large_b[None, :] * width < EXACT
        out = np.where(exact, a @ b.T, 0.0).astype(np.int64)
    for i, j in zip(*np.nonzero(~exact), strict=True):
        out[i, j] = min(GREATEST, max(LEAST, sum(int(x) * int(y) for x, y in zip(a[i], b[j], strict=True))))
    return out


@dataclass
class Space:
    """Where vectors are near if their inner product is great.

    Data gets one more component, the root of most squared less its norm squared, queries get zero there; then a squared
    distance is |q|^2 + most^2 - 2 q.x.  Pivots are data rows without that component, so a place as a query has.
    """

    centers: np.ndarray
    most: float

    def distances(self, x: np.ndarray, query: bool) -> np.ndarray:
        """From rows to pivots; infinite where squares leave the range."""
        with np.errstate(over="ignore", invalid="ignore"):
            square = (x**2).sum(1)[:, None] if query else self.most**2
            found = square + (self.centers**2).sum(1)[None, :] - 2 * (x @ self.centers.T)
            return np.sqrt(np.maximum(np.where(np.isnan(found), np.inf, found), 0))


def packed_groups(sizes: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First piece and number of pieces of each group, in that order: up to most rows a piece, groups with more have pieces of their own."""
    first, cuts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most))
    piece, room = 0, most
    for g in order:
        if sizes[g] > room and room < most:
            piece, room = piece + 1, most
        first[g] = piece
        if cuts[g] > 1:
            piece, room = piece + int(cuts[g]), most
        else:
            room -= int(sizes[g])
    return first, cuts


@dataclass
class Plan:
    """What is copied where: pieces(i, piece) of the query groups, data and queries dealt to (block, piece)."""

    data: DataFrame
    queries: DataFrame
    pieces: DataFrame


def neighbours_in_order(centers: np.ndarray) -> np.ndarray:
    """The pivots in an order that keeps near ones together: by the nearest of a few of them, then by the distance to it."""
    few = centers[: max(1, int(len(centers) ** 0.5))]
    with np.errstate(over="ignore", invalid="ignore"):
        square = (centers**2).sum(1)[:, None] + (few**2).sum(1)[None, :] - 2 * (centers @ few.T)
    square = np.where(np.isnan(square), np.inf, square)
    near = square.argmin(1)
    return np.lexsort((square[np.arange(len(centers)), near], near))


def plan(vectors: DataFrame, k: int, every: int, pivots: int | None) -> Plan | None:
    """Groups, bounds and copies for vectors(vec_id, row, vector, width, norm); None without queries."""
    is_query = F.col("vec_id") % every == 0
    n, width, most = vectors.agg(F.count(F.lit(1)), F.max("width"), F.max("norm")).first()
    own = vectors.where(is_query).groupBy("vec_id").count().agg(F.max("count")).first()[0]
    if not own:
        return None
    pivots = min(MOST_PIVOTS, max(1, int(n**0.5))) if pivots is None else pivots
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(pivots).collect()
    centers = matrix([r.vector for r in chosen], width)
    space = Space(centers, most)
    wanted = k + own  # rows of the query's own id don't count

    def summarise():
        """Rows by their nearest pivot, the farthest query of each, and the least distances of data to each."""

        def each(cols):
            x = matrix(cols["vector"].to_pylist(), width)
            ids = cols["vec_id"].to_numpy()
            far = space.distances(x, False)
            sizes = np.bincount(far.argmin(1), minlength=len(centers))
            out = [("n", int(g), float(sizes[g])) for g in np.flatnonzero(sizes)]
            few = np.sort(far, axis=0)[:wanted] if len(x) else far
            out += [("d", g, float(v)) for g in range(len(centers)) for v in few[:, g]]
            asked = space.distances(x[ids % every == 0], True)
            near = asked.argmin(1)
            out += [("q", int(g), float(v)) for g, v in zip(near, asked[np.arange(len(near)), near], strict=True)]
            return dict(zip(("what", "g", "v"), map(list, zip(*out, strict=True)), strict=True)) if out else None

        return each

    summary = map_arrow(vectors, summarise, "what string, g int, v double")
    order = Window.partitionBy("what", "g").orderBy("v")
    least = summary.where("what = 'd'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= wanted).groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.max("v").alias("v")).collect()
    sums = summary.where("what <> 'd'").groupBy("what", "g").agg(F.sum("v").alias("s"), F.max("v").alias("m"), F.count(F.lit(1)).alias("c")).collect()
    sizes, n_queries, reach = np.zeros(len(centers), np.int64), np.zeros(len(centers), np.int64), np.full(len(centers), -np.inf)
    kth = np.full(len(centers), np.inf)
    for r in least:
        if r.c >= wanted:
            kth[r.g] = r.v
    for r in sums:
        if r.what == "n":
            sizes[r.g] = int(r.s)
        else:
            # a query's k-th is at most its own distance from the pivot and the pivot's k-th away, so at most so far from the pivot
            n_queries[r.g], reach[r.g] = r.c, 2 * r.m + kth[r.g] + SLACK * (1 + most + r.m)
    along = neighbours_in_order(centers)
    first_piece, cuts = packed_groups(sizes, along, BLOCK)
    first_block, block_cuts = packed_groups(n_queries, along, QUERY_BLOCK)
    busy = np.flatnonzero(n_queries)
    last_block = int((first_block + block_cuts)[busy].max())
    #: blocks x groups: whether the block has queries of the group
    holds = np.zeros((last_block, len(busy)), bool)
    for at, g in enumerate(busy):
        holds[first_block[g] : first_block[g] + block_cuts[g], at] = True

    def in_reach(cols):
        x = matrix(cols["vector"].to_pylist(), width)
        far = space.distances(x, False)
        g = far.argmin(1)
        piece = first_piece[g] + cols["row"].to_numpy() % cuts[g]
        return ~(far[:, busy] > reach[busy][None, :]), piece

    def copy_data():
        def each(cols):
            near, piece = in_reach(cols)
            row, block = np.nonzero((near.astype(np.float32) @ holds.T.astype(np.float32)) > 0)
            return {"block": block, "piece": piece[row], "vec_id": cols["vec_id"].take(pa.array(row)), "vector": cols["vector"].take(pa.array(row))}

        return each

    def list_pieces():
        def each(cols):
            near, piece = in_reach(cols)
            row, at = np.nonzero(near)
            found = np.unique(np.stack([busy[at], piece[row]]), axis=1)
            return {"i": found[0], "piece": found[1]}

        return each

    def copy_queries():
        def each(cols):
            x = matrix(cols["vector"].to_pylist(), width)
            g = space.distances(x, True).argmin(1)
            block = first_block[g] + cols["row"].to_numpy() % block_cuts[g]
            return {"block": block, "g": g, "query_row": cols["row"], "query_id": cols["vec_id"], "vector": cols["vector"]}

        return each

    pieces = map_arrow(vectors, list_pieces, "i int, piece long").distinct()
    asked = map_arrow(vectors.where(is_query), copy_queries, "block long, g int, query_row long, query_id long, vector binary")
    asked = asked.join(pieces, F.col("g") == F.col("i")).select("block", "piece", "query_row", "query_id", "vector")
    return Plan(map_arrow(vectors, copy_data, "block long, piece long, vec_id long, vector binary"), asked, pieces)


def quantize(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, row (a number of its own), vector (whole doubles), width and norm of the vectors that take part."""

    def make():
        number = (TaskContext.get().partitionId()) << 33

        def each(cols):
            nonlocal number
            kept, out = quantized(cols["v"], scale)
            names = cols["id"].take(pa.array(kept))
            at = np.arange(number, number + len(kept))
            number += len(kept)
            with np.errstate(over="ignore"):
                norms = [float(np.sqrt((x**2).sum())) for x in out]
            return {"vec_id": names, "row": at, "vector": [x.tobytes() for x in out], "width": [len(x) for x in out], "norm": norms}

        return each

    plain = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    return map_arrow(plain, make, "vec_id long, row long, vector binary, width int, norm double")


def solver(k: int, width: int):
    """A function of the queries and the data of a piece that gives each query's best k rows there."""
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def best(q: np.ndarray, at: np.ndarray, own: np.ndarray, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        for a in range(0, len(q), STRIPE):
            for i, line in enumerate(products(q[a : a + STRIPE], x), a):
                few = np.flatnonzero(ids != own[i])
                if len(few) > k:  # all that reach the k-th score, then ties by id
                    some = line[few]
                    few = few[some >= np.partition(some, len(some) - k)[len(some) - k]]
                few = few[np.argsort(-line[few].astype(object), kind="stable")][:k]
                yield [at[i]] * len(few), [own[i]] * len(few), ids[few], line[few]

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x = matrix(right.column("vector").to_pylist(), width)[order]
            q = matrix(left.column("vector").to_pylist(), width)
            for found in best(q, left.column("query_row").to_numpy(), left.column("query_id").to_numpy(), ids[order], x):
                for c, v in zip(out, found, strict=True):
                    c.extend(v)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return solve


def top_k(rows: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, pivots: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k greatest inner products of every query.

    Components are floor(scale * x).  Queries are the rows whose id is divisible
    by every; candidates are all rows but those with the query's own id.  Ties go to the smaller id.

    Inner products become distances by one more component (Space).  Queries and data are grouped by their nearest pivot, one of
    the rows that the least hashes of ids choose (the square root of their number, MOST_PIVOTS at most).  A summary of each
    pivot, its farthest query and its k-th nearest row, bounds how far from the pivot a row can be that one of
    its queries needs; data rows beyond all bounds are not copied at all.  Data groups are cut or put together to
    pieces of about BLOCK rows, query groups to blocks of about QUERY_BLOCK, near ones together: a row goes to the
    blocks of query groups that it is in reach of, a query to the pieces that hold a row in its group's reach.  Each pair of a
    block and a piece is solved alone and gives k rows a query, which are merged.  So a hot group or many equal vectors fill several tasks.

    Vectors that are null or hold null or non-finite components take no part, nor do
    rows without an id.  Vectors of different lengths count as filled up with zeros.  Scores beyond 64 bits are the ends of that range.
    Each row of an id that repeats is a candidate, and a query that repeats is answered once per row.
    An empty table gives an empty one; further columns are not read.
    """
    vectors = saved(quantize(rows, scale, id_col, vector_col))
    made = plan(vectors, k, every, pivots)
    if made is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = vectors.agg(F.max("width")).first()[0]
    keys = ("block", "piece")
    met = made.queries.groupBy(*keys).cogroup(made.data.groupBy(*keys)).applyInArrow(solver(k, width), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def brute_sql(k: int = 5, every: int = 50, scale: float = 256.0) -> str:
    """DuckDB's SQL of the whole join, for tables small enough."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""
