"""Exact top-k search by inner product, as a Voronoi kNN join.

1. Pivots are taken from the data, about the square root of their number, from 8 to `most_pivots`.
   Every vector joins its nearest pivot's cell and keeps its norm; a query also keeps its
   (k+1)-th best score among the pivots.
2. Summaries of a fixed size for each cell (row counts, radii, the smallest of those scores, the
   k+1 nearest members) go to the driver. They give each query cell a score that every query's
   k-th best reaches. A query cell with pivot p and radius u can need a data cell with pivot c
   and radius r only if p.c + u * |c| + r * |p| + u * r reaches its score.
3. Query cells that need much the same data cells share a group; cells that need others stay
   apart. Where the bounds prune, groups are small and get their own data; where they don't,
   all queries make one group and the data are shipped once.
4. A vector x of a needed cell is shipped to a group only if p.x + u * |x| reaches the score of
   one of the group's cells.
5. A group's data are cut into splits by the number of rows that its cells hold. A group's
   queries go to its own splits; each is solved with a matrix product over blocks, and the best
   k of all splits are merged.

Components are integers, floor(256 * x), so scores are exact (below 2^53) and ties are real.

Defined results: vectors that are null, or hold a null or non-finite component, are neither
queries nor candidates; shorter vectors count as padded with zeros, so an empty one is all
zeros; a row is excluded from its own result only, so repeated ids can find each other; a null
id is no query, and as a candidate comes after all ids in a tie; fewer candidates than k are
all returned; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, mapped, pick

LAST = (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Columns row, vec_id, v (doubles) of the vectors that take part."""
    v = pick(vectors, vec_id=id_col, v=vector_col).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform("v", lambda x: x.cast("double")).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.where(F.col("v").isNotNull() & finite)


def packed(block: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes, with 16 bits each if they fit."""
    kind = "<i2" if np.abs(block).max(initial=0) < 1 << 15 else "<i8"
    return [r.tobytes() for r in block.astype(kind)]


def unpacked(column: pa.Array, width: int) -> np.ndarray:
    rows = column.to_pylist()
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        v = np.frombuffer(r, "<i2" if len(r) == 2 * width else "<i8")
        out[i, : len(v)] = v
    return out


def _quantized(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 * x), padded to width."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False))
    if np.abs(out).max(initial=0) >= 2.0**62:
        raise ValueError("a component is too large for an integer")
    return out


def _best(scores: np.ndarray, order: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best entries of each row, ties by order; own columns don't count."""
    n = scores.shape[1]
    key = scores.astype(np.int64) * n + (n - 1 - order)
    key[own] = -LAST
    top = min(k, n)
    at = np.argpartition(key, n - top, axis=1)[:, n - top :]
    i = np.repeat(np.arange(len(scores)), top)
    real = key[i, at.ravel()] > -LAST
    return i[real], at.ravel()[real]


def _solve(k: int, width: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, data = left.combine_chunks(), right.combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        if queries.num_rows and data.num_rows:
            ids = np.asarray(data["vec_id"].combine_chunks().fill_null(LAST))
            sort = np.argsort(ids, kind="stable")
            ids, rows = ids[sort], np.asarray(data["row"].combine_chunks())[sort]
            x = unpacked(data["v"], width)[sort]
            q, q_ids, q_rows = unpacked(queries["v"], width), np.asarray(queries["vec_id"].combine_chunks()), np.asarray(queries["row"].combine_chunks())
            for a in range(0, len(q), 256):
                for b in range(0, len(x), 16384):
                    block = q[a : a + 256] @ x[b : b + 16384].T
                    if np.abs(block).max(initial=0) >= 2.0**39:
                        raise ValueError("scores are too large to be exact")
                    i, j = _best(block, np.arange(block.shape[1]), q_rows[a : a + 256, None] == rows[None, b : b + 16384], k)
                    out.append((q_rows[a + i], q_ids[a + i], ids[b + j], rows[b + j], block[i, j].astype(np.int64)))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        found = pa.array(columns[2], mask=columns[2] == LAST)
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), found, pa.array(columns[3]), pa.array(columns[4])], ["q_row", "query_id", "vec_id", "row", "score"])

    return run


def grouped(needs: np.ndarray, sizes: np.ndarray, queries: np.ndarray, most: int, waste: float) -> list[list[int]]:
    """Groups of query cells. needs: which data cells each may need; sizes: their rows; queries: of each query cell.

    A cell joins the group whose data grow least by it, if the queries then meet at most `waste`
    times the rows that they need, and the group has at most `most` queries.
    """
    groups: list[list[int]] = []
    unions = np.zeros((0, needs.shape[1]), bool)
    held, wanted = np.zeros(0), np.zeros(0)  # queries of each group; query-row pairs that they need
    own = needs @ sizes
    for c in np.argsort(-own, kind="stable").tolist():
        joined = (unions | needs[c]) @ sizes
        n, pairs = held + queries[c], wanted + queries[c] * own[c]
        fits = np.flatnonzero((n <= most) & (n * joined <= waste * pairs))
        if len(fits):
            g = int(fits[np.argmin(joined[fits] - (unions @ sizes)[fits])])
            groups[g].append(c)
            unions[g] |= needs[c]
            held[g], wanted[g] = n[g], pairs[g]
        else:
            groups.append([c])
            unions = np.vstack((unions, needs[c]))
            held, wanted = np.append(held, queries[c]), np.append(wanted, queries[c] * own[c])
    return groups


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int | None = None,
    most_pivots: int = 1024,
    query_block: int = 32_768,
    data_block: int = 16_384,
    waste: float = 1.5,
    report: dict | None = None,
) -> DataFrame:
    """Columns query_id, rank, vec_id, score for the rows that is_query (over column vec_id) marks.

    report, if given, gets the numbers of groups, of shipped rows and of scored pairs, and that of all pairs.
    """
    if k < 1 or (pivots is not None and pivots < 1):
        raise ValueError("k and pivots must be positive")
    scratch = Scratch(vectors.sparkSession)
    v = usable(vectors, id_col, vector_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    width, total = v.agg(F.max(F.size("v")), F.count("*")).first()
    width = width or 1
    many = pivots or max(8, min(most_pivots, math.isqrt(total)))
    sample = v.orderBy(F.xxhash64("vec_id", "v")).limit(many).select("v").collect()  # most_pivots rows at most
    p = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        p[i, : len(r.v)] = np.floor(256.0 * np.array(r.v))
    p_norms = np.linalg.norm(p, axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _quantized(batch.column("v"), width)
            scores, norms = x @ p.T, np.linalg.norm(x, axis=1)
            square = np.maximum(norms[:, None] ** 2 + p_norms**2 - 2 * scores, 0)
            cell = square.argmin(axis=1)
            # One of the pivots may be the row itself, so the (k+1)-th counts.
            floor = np.partition(scores, -k - 1, axis=1)[:, -k - 1] if len(p) > k else np.full(len(x), -np.inf)
            yield pa.record_batch([batch.column("row"), batch.column("vec_id"), batch.column("is_query"), pa.array(packed(x), pa.binary()), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(square[np.arange(len(x)), cell])), pa.array(norms), pa.array(floor)], ["row", "vec_id", "is_query", "v", "cell", "distance", "norm", "floor"])

    marked = v.withColumn("is_query", F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)))
    cells = scratch.save(mapped(marked.select("row", "vec_id", "is_query", "v"), assign, "row long, vec_id long, is_query boolean, v binary, cell int, distance double, norm double, floor double"), "cells")

    # Summaries: a row for each cell, and k + 1 for the members nearest to its pivot.
    of_cells = {r.cell: r for r in cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("norm").alias("norm"), F.max("distance").alias("radius")).collect()}
    of_queries = {r.cell: r for r in cells.where("is_query").groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("radius"), F.min("floor").alias("floor")).collect()}
    near = cells.select("cell", "distance", "row").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("distance", "row"))).where(F.col("i") <= k + 1).select("cell", "distance").collect()

    slack = 1e-6 * max((r.norm for r in of_cells.values()), default=0.0) ** 2 + 1e-3
    asking, holding = sorted(of_queries), sorted(of_cells)
    radius = np.array([of_queries[c].radius for c in asking])
    near_cell, near_distance = np.array([r.cell for r in near], np.int64), np.array([r.distance for r in near])
    dots = p[asking] @ p.T if asking else np.zeros((0, len(p)))
    # A score that the k-th best of each query in a cell reaches; k + 1 as one may be the query's own row.
    bound = np.array([of_queries[c].floor for c in asking])
    for i, c in enumerate(asking):
        low = dots[i, near_cell] - p_norms[c] * near_distance - radius[i] * (p_norms[near_cell] + near_distance)
        if len(low) > k:
            bound[i] = max(bound[i], np.partition(low, -k - 1)[-k - 1])
    bound -= slack
    spread = np.array([of_cells[c].radius for c in holding])
    sizes, queries = np.array([of_cells[c].n for c in holding], float), np.array([of_queries[c].n for c in asking], float)
    needs = dots[:, holding] + radius[:, None] * p_norms[holding] + np.outer(p_norms[asking], spread) + np.outer(radius, spread) >= bound[:, None] if asking else np.zeros((0, len(holding)), bool)
    groups = grouped(needs, sizes, queries, query_block, waste)
    order = np.array([c for g in groups for c in g], np.int64)  # query cells, group by group
    first = np.concatenate(([0], np.cumsum([len(g) for g in groups])))[:-1].astype(np.int64) if groups else np.zeros(0, np.int64)
    splits = [max(1, -(-int(sizes[needs[g].any(axis=0)].sum()) // data_block)) for g in groups]
    parts = [max(1, -(-int(queries[g].sum()) // query_block)) for g in groups]
    wanted = np.zeros((len(p), len(order)), bool)  # by data cell and query cell
    wanted[holding] = needs[order].T

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector once for each group that may need it."""
        asked, wide, least = p[np.array(asking, np.int64)[order]].T, radius[order], bound[order]
        for batch in batches:
            if not batch.num_rows or not len(order):
                continue
            x, norms, cell = unpacked(batch.column("v"), width), np.asarray(batch.column("norm")), np.asarray(batch.column("cell"))
            may = (x @ asked + np.outer(norms, wide) >= least) & wanted[cell]
            may = np.logical_or.reduceat(may, first, axis=1)
            at, g = np.nonzero(may)
            part = batch.take(pa.array(at))
            yield pa.record_batch([pa.array(g.astype(np.int32)), part.column("row"), part.column("vec_id"), part.column("v")], ["g", "row", "vec_id", "v"])

    def lookup(values: list[int], key: Column) -> Column:
        return F.array(*map(F.lit, values))[key] if values else F.lit(0)

    group_of = {asking[c]: g for g, members in enumerate(groups) for c in members}
    data = mapped(cells.select("row", "vec_id", "v", "norm", "cell"), needed, "g int, row long, vec_id long, v binary").withColumn("split", F.pmod(F.xxhash64("row"), lookup(splits, F.col("g"))).cast("int"))
    asked = cells.where("is_query").withColumn("g", lookup([group_of.get(c, 0) for c in range(len(p))], F.col("cell"))).withColumn("part", F.pmod(F.xxhash64("row"), lookup(parts, F.col("g"))).cast("int"))
    # A split of a group's data meets each part of its queries.
    asked = asked.select("g", "part", F.explode(F.sequence(F.lit(0), lookup(splits, F.col("g")) - 1)).alias("split"), "row", "vec_id", "v")
    data = data.select("g", F.explode(F.sequence(F.lit(0), lookup(parts, F.col("g")) - 1)).alias("part"), "split", "row", "vec_id", "v")
    if report is not None:
        shipped = {r.g: r.n for r in data.where("part = 0").groupBy("g").agg(F.count("*").alias("n")).collect()}
        report.update(groups=len(groups), shipped=sum(shipped.values()), scored=sum(int(queries[g].sum()) * shipped.get(i, 0) for i, g in enumerate(groups)), all=int(queries.sum()) * total)
    solved = asked.groupBy("g", "part", "split").cogroup(data.groupBy("g", "part", "split")).applyInArrow(_solve(k, width), "q_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return solved.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0
), n AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 5
"""
