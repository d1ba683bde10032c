"""Exact search: top-k, radius, batches, refinement, groups, recall."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidArgument, NotFound
from ..functions import vectors as V
from ..schema import MetricType

MAX_K = 100_000


def _check(k: int) -> None:
    if not 0 < k <= MAX_K:
        raise InvalidArgument(f"k must be from 1 to {MAX_K}", "search")


def top_k(scored: DataFrame, metric: MetricType, k: int, id_col: str = "_doc_id", score_col: str = "_score", radius: float = 0.0) -> DataFrame:
    """The k best rows; ties go to the smaller id. Each partition sends k rows at most."""
    _check(k)
    s = F.col(score_col)
    return scored.where(s.isNotNull() & V.within_radius(metric, s, radius)).orderBy(V.best_first(metric, s), F.col(id_col)).limit(k)


def dense(df: DataFrame, query: Sequence[float], k: int, metric: MetricType, vector_col: str, id_col: str = "_doc_id", radius: float = 0.0, where: Column | None = None) -> DataFrame:
    """Filter, then score, then radius, then the k best; rows without a vector never match."""
    rows = df.where(F.col(vector_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    return top_k(rows.withColumn("_score", V.score(metric, F.col(vector_col), query)), metric, k, id_col, radius=radius)


def sparse(df: DataFrame, query: dict[int, float], k: int, vector_col: str, id_col: str = "_doc_id", radius: float = 0.0, where: Column | None = None) -> DataFrame:
    rows = df.where(F.col(vector_col).isNotNull())
    rows = rows if where is None else rows.where(where)
    return top_k(rows.withColumn("_score", V.sparse_inner_product(F.col(vector_col), query)), MetricType.IP, k, id_col, radius=radius)


def stored_vector(df: DataFrame, key: object, key_col: str, vector_col: str):
    """The vector of another document, whatever the filter; one row is read."""
    found = df.where(F.col(key_col) == F.lit(key)).select(vector_col).take(1)
    if not found:
        raise NotFound(f"no document {key!r}", "query by key")
    if found[0][0] is None:
        raise InvalidArgument(f"{key!r} has no vector", "query by key")
    return found[0][0]


def ranked(df: DataFrame, metric: MetricType, id_col: str = "_doc_id", score_col: str = "_score") -> DataFrame:
    """A long column rank, from 0. For results of at most MAX_K rows."""
    w = Window.orderBy(V.best_first(metric, F.col(score_col)), F.col(id_col))
    return df.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))


def refined(df: DataFrame, approximate: Column, query: Sequence[float], k: int, metric: MetricType, vector_col: str, id_col: str = "_doc_id", scale_factor: float = 10.0, radius: float = 0.0, where: Column | None = None) -> DataFrame:
    """Candidates by an approximate score (filter, no radius), then exact scores, radius and k."""
    _check(k)
    rows = df if where is None else df.where(where)
    first = rows.where(F.col(vector_col).isNotNull()).withColumn("_approx", approximate).orderBy(V.best_first(metric, F.col("_approx")), F.col(id_col)).limit(max(1, int(k * scale_factor)))
    return top_k(first.drop("_approx").withColumn("_score", V.score(metric, F.col(vector_col), query)), metric, k, id_col, radius=radius)


def coded(df: DataFrame, bits: int, query: Sequence[float], metric: MetricType, vector_col: str, id_col: str = "_doc_id") -> DataFrame:
    """id_col and _score by 8- or 4-bit codes of the vectors, a block of rows at a time; rows without a vector are left out."""
    low, high = V.CODES[bits]
    q = np.asarray(query, np.float64)

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, len(q)))
            least, most = (f(axis=1, keepdims=True) for f in (x.min, x.max)) if len(x) else (np.zeros((0, 1)), np.zeros((0, 1)))
            scale = (high - low) / np.maximum(most - least, 1.1920928955078125e-7)
            bias = low - least * scale
            t = x * scale + bias
            code = np.clip(np.sign(t) * np.floor(np.abs(t) + 0.5), low, high)
            near = np.where(most > least, (code - bias) / scale, x)
            s = np.asarray(V.scores(metric, near, q), float).ravel() if len(x) else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(s)], [id_col, "_score"])

    rows = df.where(F.col(vector_col).isNotNull()).select(id_col, vector_col)
    return rows.mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, _score double")


def refined_codes(df: DataFrame, bits: int, query: Sequence[float], k: int, metric: MetricType, vector_col: str, id_col: str = "_doc_id", scale_factor: float = 10.0, radius: float = 0.0) -> DataFrame:
    """Candidates by codes, then exact scores, radius and k."""
    _check(k)
    first = top_k(coded(df, bits, query, metric, vector_col, id_col), metric, max(1, int(k * scale_factor)), id_col).select(id_col)
    rows = df.join(F.broadcast(first), id_col)  # k * scale_factor rows at most
    return top_k(rows.withColumn("_score", V.score(metric, F.col(vector_col), query)), metric, k, id_col, radius=radius)


def batch(queries: DataFrame, data: DataFrame, k: int, metric: MetricType, vector_col: str, id_col: str = "_doc_id", query_block: int = 16_384, data_block: int = 50_000) -> DataFrame:
    """Columns query_id, rank (from 0), id_col, _score: the k best of data for each row of queries.

    Blocks of queries meet blocks of data in tasks of bounded size; each keeps its k best, and
    these are merged. Sparse vectors (structs) are met under the inner product.
    """
    _check(k)
    sparse_rows = data.schema[vector_col].dataType.typeName() == "struct"
    q = queries.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("v"))
    d = data.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    parts = max(1, -(-q.count() // query_block))
    splits = max(1, -(-d.count() // data_block))
    tasks = min(4 * parts * splits, 2000)
    q = q.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts))).withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(splits - 1).cast("long")))).repartition(tasks, "part", "split")
    d = d.withColumn("split", F.pmod(F.xxhash64("id"), F.lit(splits))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).repartition(tasks, "part", "split")
    sign = -1.0 if metric.descending else 1.0

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            right = right.sort_by("id")
            ids, qid = np.asarray(right.column("id").combine_chunks()), np.asarray(left.column("query_id").combine_chunks())
            of = _sparse_scores(left.column("v"), right.column("v")) if sparse_rows else _dense_scores(metric, left.column("v"), right.column("v"))
            for a in range(0, len(qid), 64):
                s = sign * of(a, min(a + 64, len(qid)))
                at, place = V.best_places(s, k)
                out.append((qid[a + at], ids[place], sign * s[at, place]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pa.table([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int64)), pa.array(cols[2])], ["query_id", "id", "_score"])

    found = q.groupBy("part", "split").cogroup(d.groupBy("part", "split")).applyInArrow(solve, "query_id long, id long, _score double")
    w = Window.partitionBy("query_id").orderBy(V.best_first(metric, F.col("_score")), "id")
    return found.withColumn("rank", (F.row_number().over(w) - 1).cast("long")).where(F.col("rank") < k).select("query_id", "rank", F.col("id").alias(id_col), "_score")


def _dense_scores(metric: MetricType, queries: pa.ChunkedArray, rows: pa.ChunkedArray) -> Callable[[int, int], np.ndarray]:
    """Scores of some of the queries with all rows."""
    from ..ann.indexes import _matrix

    q, x = _matrix(queries), _matrix(rows)
    return lambda a, b: V.scores(metric, x, q[a:b]).T


def _sparse_scores(queries: pa.ChunkedArray, rows: pa.ChunkedArray) -> Callable[[int, int], np.ndarray]:
    from ..ann.indexes import _sparse

    q, space = _sparse(queries), _sparse(rows)
    return lambda a, b: -space.many(space.aligned(q, a, b))


def group_value(df: DataFrame, column: str) -> Column:
    """Groups' names: null and '' are one group, floats have six digits."""
    kind = df.schema[column].dataType.simpleString()
    c = F.col(f"`{column}`")
    if kind in ("float", "double"):
        return F.coalesce(F.format_string("%.6f", c.cast("double")), F.lit(""))
    if kind.startswith("array") or kind.startswith("struct"):
        raise InvalidArgument(f"{column} can't be a group field", "group by")
    return F.coalesce(c.cast("string"), F.lit(""))


def groups(scored: DataFrame, group: Column, group_count: int, per_group: int, metric: MetricType, id_col: str = "_doc_id", score_col: str = "_score", radius: float = 0.0) -> DataFrame:
    """Columns _group, _group_rank, _rank (from 0) and scored's own: the per_group best rows of the group_count groups with the best rows."""
    _check(group_count)
    _check(per_group)
    s = F.col(score_col)
    rows = scored.where(s.isNotNull() & V.within_radius(metric, s, radius)).withColumn("_group", group)
    inside = Window.partitionBy("_group").orderBy(V.best_first(metric, s), F.col(id_col))
    kept = rows.withColumn("_rank", (F.row_number().over(inside) - 1).cast("long")).where(F.col("_rank") < per_group)
    best = kept.where(F.col("_rank") == 0).orderBy(V.best_first(metric, s), F.col("_group")).limit(group_count)
    across = Window.orderBy(V.best_first(metric, s), F.col("_group"))
    best = best.select(F.col("_group").alias("_g"), (F.row_number().over(across) - 1).cast("long").alias("_group_rank"))
    return kept.join(F.broadcast(best), F.col("_group") == F.col("_g")).drop("_g")  # group_count rows


def recall(truth: DataFrame, found: DataFrame, k: int, query_col: str = "query_id", id_col: str = "_doc_id") -> DataFrame:
    """Columns query_col, recall: the share of the k best that was found, repeated ids counted once."""
    t = truth.where(F.col("rank") < k).select(query_col, id_col).distinct()
    f = found.where(F.col("rank") < k).select(query_col, id_col).distinct().withColumn("hit", F.lit(1.0))
    return t.join(f, [query_col, id_col], "left").groupBy(query_col).agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))
