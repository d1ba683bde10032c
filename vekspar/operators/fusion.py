"""Fusion of ranked branches: reciprocal rank, weighted scores, or a function of the user's."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InternalError, InvalidArgument
from ..schema import MetricType

DEFAULT_K, DEFAULT_CANDIDATES, MAX_K = 10, 10, 100_000


def _fused(branches: Sequence[DataFrame], term: Callable[[int], Column], k: int) -> DataFrame:
    """One aggregate over all branches; each has _pk, _doc_id, _score and rank (from 0)."""
    if len(branches) < 2:
        raise InvalidArgument("fusion needs two branches or more", "fuse")
    if not 0 < k <= MAX_K:
        raise InvalidArgument(f"k must be from 1 to {MAX_K}", "fuse")
    parts = [b.select("_pk", "_doc_id", term(i).alias("_term")) for i, b in enumerate(branches)]
    total = reduce(DataFrame.unionByName, parts).groupBy("_pk").agg(F.sum("_term").alias("_score"), F.min("_doc_id").alias("_doc_id"))
    return total.orderBy(F.desc("_score"), "_pk", "_doc_id").limit(k)


def rrf(branches: Sequence[DataFrame], k: int = DEFAULT_K, constant: int = 60) -> DataFrame:
    """Sum of 1 / (constant + rank + 1)."""
    if constant < 0:
        raise InvalidArgument("the rank constant can't be negative", "rrf")
    return _fused(branches, lambda _: 1.0 / (F.lit(float(constant)) + F.col("rank") + 1.0), k)


def normalized(kind: MetricType | str, score: Column) -> Column:
    """Scores of different metrics on one scale; kind "fts" for text scores."""
    arc = F.atan(score)
    if kind == "fts":
        return 2.0 * arc / math.pi
    if kind == MetricType.L2:
        return 1.0 - 2.0 * arc / math.pi
    if kind == MetricType.IP:
        return 0.5 + arc / math.pi
    if kind == MetricType.COSINE:
        return 1.0 - score / 2.0
    raise InvalidArgument(f"{kind} scores can't be weighted", "weighted fusion")


def weighted(branches: Sequence[DataFrame], kinds: Sequence[MetricType | str], weights: Sequence[float], k: int = DEFAULT_K) -> DataFrame:
    """Sum of weight * normalized score."""
    if len(weights) != len(branches) or len(kinds) != len(branches):
        raise InvalidArgument("a weight and a kind for each branch are needed", "weighted fusion")
    if not all(math.isfinite(w) for w in weights):
        raise InvalidArgument("weights must be finite", "weighted fusion")
    return _fused(branches, lambda i: F.lit(float(weights[i])) * normalized(kinds[i], F.col("_score")), k)


def callback(branches: Sequence[DataFrame], function: Callable[[list[list[dict]], int], list[dict]], k: int = DEFAULT_K) -> DataFrame:
    """The user's function over the branches' rows (at most MAX_K each), checked."""
    batches = [[r.asDict() for r in b.orderBy("rank").limit(MAX_K).collect()] for b in branches]
    known = {r["_pk"]: r["_doc_id"] for rows in batches for r in rows}
    try:
        found = function(batches, k)
    except Exception as e:
        raise InternalError(f"the reranker failed: {e}", "rerank") from e
    return branches[0].sparkSession.createDataFrame(checked(found, known, k), "_pk string, _doc_id long, _score double")


def checked(found: list[dict], known: dict[str, int], k: int) -> list[tuple[str, int, float]]:
    """At most k rows, none twice, only candidates, finite scores."""
    out, seen = [], set()
    if len(found) > k:
        raise InvalidArgument("the reranker returned too many documents", "rerank")
    for r in found:
        if r["_pk"] not in known:
            raise InvalidArgument(f"{r['_pk']!r} is no candidate", "rerank")
        if r["_pk"] in seen:
            raise InvalidArgument(f"{r['_pk']!r} was returned twice", "rerank")
        if not math.isfinite(r["_score"]):
            raise InvalidArgument(f"the score of {r['_pk']!r} is not finite", "rerank")
        seen.add(r["_pk"])
        out.append((r["_pk"], known[r["_pk"]], float(r["_score"])))
    return out
