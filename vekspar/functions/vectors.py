"""Vector functions as Spark columns. Elements count as doubles, summed from left to right."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..schema import MetricType

Vector = Column | Sequence[float]


def as_column(v: Vector) -> Column:
    return v if isinstance(v, Column) else F.array(*(F.lit(float(x)) for x in v))


def _fold(a: Vector, b: Vector, each) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: each(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2_squared(a: Vector, b: Vector) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def norm_squared(a: Vector) -> Column:
    return F.aggregate(as_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_distance(a: Vector, b: Vector, norms: tuple[Column, Column] | None = None) -> Column:
    """1 - cosine. Two zero vectors: 0; one: 1. norms: stored squared norms, if there are any."""
    na, nb = norms or (norm_squared(a), norm_squared(b))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), inner_product(a, b) / (F.sqrt(na) * F.sqrt(nb))))
    return F.when((na == 0) & (nb == 0), F.lit(0.0)).when((na == 0) | (nb == 0), F.lit(1.0)).otherwise(1.0 - cosine)


def mips_l2(a: Vector, b: Vector) -> Column:
    """Squared distance after both vectors are scaled by the longer one's norm. Two zero vectors: 0."""
    most = F.greatest(norm_squared(a), norm_squared(b))
    return F.when(most == 0, F.lit(0.0)).otherwise(2.0 - 2.0 * inner_product(a, b) / most)


def score(metric: MetricType, a: Vector, b: Vector) -> Column:
    return {MetricType.IP: inner_product, MetricType.L2: l2_squared, MetricType.COSINE: cosine_distance, MetricType.MIPSL2: mips_l2}[metric](a, b)


def scores(metric: MetricType, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The same for a block of rows against one query or, with a second axis, several."""
    rows, query = rows.astype(np.float64), query.astype(np.float64)
    q = query.reshape(-1, query.shape[-1])
    # One query row by row, so that equal rows have equal scores wherever they stand.
    dots = np.einsum("ij,j->i", rows, q[0])[:, None] if len(q) == 1 else rows @ q.T
    nr, nq = (rows**2).sum(axis=1)[:, None], (q**2).sum(axis=1)[None]
    if metric == MetricType.IP:
        out = dots
    elif metric == MetricType.L2:
        out = ((rows[:, None] - q[None]) ** 2).sum(axis=2) if len(q) == 1 else np.maximum(nr + nq - 2 * dots, 0)
    elif metric == MetricType.COSINE:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = 1 - np.clip(dots / (np.sqrt(nr) * np.sqrt(nq)), -1, 1)
        out = np.where((nr == 0) & (nq == 0), 0.0, np.where((nr == 0) | (nq == 0), 1.0, out))
    else:
        most = np.maximum(nr, nq)
        out = np.where(most == 0, 0.0, 2 - 2 * dots / np.where(most == 0, 1, most))
    return out[:, 0] if query.ndim == 1 else out


def best_places(distance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row, best first; ties go to the smaller column."""
    if k >= distance.shape[1]:
        rows, places = (x.ravel() for x in np.indices(distance.shape))
    else:
        rows, places = np.nonzero(distance <= np.partition(distance, k - 1, axis=1)[:, k - 1 : k])
    order = np.lexsort((places, distance[rows, places], rows))
    rows, places = rows[order], places[order]
    turn = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return rows[turn < k], places[turn < k]


def within_radius(metric: MetricType, value: Column, radius: float) -> Column:
    """Inclusive; 0 means no radius."""
    if not 0 <= radius < float("inf"):
        raise InvalidArgument("the radius must be finite and not negative", "radius")
    if radius == 0:
        return F.lit(True)
    return value >= radius if metric.descending else value <= radius


def best_first(metric: MetricType, value: Column) -> Column:
    return value.desc() if metric.descending else value.asc()


def normalize_l2(v: Vector) -> Column:
    """Unit length; the zero vector stays."""
    n = F.sqrt(norm_squared(v))
    return F.when(n == 0, F.transform(as_column(v), lambda x: x.cast("double"))).otherwise(F.transform(as_column(v), lambda x: x.cast("double") / n))


# --- Sparse vectors: struct(indices, values) -----------------------------------------------


def sparse_inner_product(v: Column, query: dict[int, float]) -> Column:
    """Sum over the coordinates that both hold; an empty vector scores 0."""
    if not query:
        return F.when(v.isNotNull(), F.lit(0.0))
    q = F.create_map(*(F.lit(x) for k in sorted(query) for x in (int(k), float(query[k]))))
    terms = F.zip_with(v["indices"], v["values"], lambda i, x: F.coalesce(q[i] * x.cast("double"), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def sparse_canonical(v: Column, most: int = 16_384) -> Column:
    """Sorted by coordinate; null if coordinates repeat, are too many or don't match the values."""
    pairs = F.array_sort(F.arrays_zip(v["indices"].alias("i"), v["values"].alias("x")))
    fine = (F.size(v["indices"]) == F.size(v["values"])) & (F.size(F.array_distinct(v["indices"])) == F.size(v["indices"])) & (F.size(v["indices"]) <= most)
    return F.when(fine, F.struct(F.transform(pairs, lambda p: p["i"]).alias("indices"), F.transform(pairs, lambda p: p["x"]).alias("values")))


# --- Scalar quantization -------------------------------------------------------------------

CODES = {8: (-127, 127), 4: (-8, 7)}


def quantize(v: Column, bits: int) -> Column:
    """struct(codes, scale, bias): code = round(x * scale + bias), half away from zero.

    scale spreads the vector's own range over the codes; a constant vector has codes 0 and its
    value in bias, with scale 0.
    """
    low, high = CODES[bits]
    d = F.transform(v, lambda x: x.cast("double"))
    least, most = F.array_min(d), F.array_max(d)
    scale = F.when(most > least, F.lit(float(high - low)) / F.greatest(most - least, F.lit(1.1920928955078125e-7))).otherwise(F.lit(0.0))
    bias = F.when(most > least, low - least * scale).otherwise(least)
    code = F.when(most > least, F.transform(d, lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.round(x * scale + bias).cast("int"))))).otherwise(F.transform(d, lambda x: F.lit(0)))
    return F.struct(code.alias("codes"), scale.alias("scale"), bias.alias("bias"))


def dequantize(q: Column) -> Column:
    return F.when(q["scale"] == 0, F.transform(q["codes"], lambda c: q["bias"])).otherwise(F.transform(q["codes"], lambda c: (c.cast("double") - q["bias"]) / q["scale"]))


def quantized_score(metric: MetricType, q: Column, query: Sequence[float], bits: int) -> Column:
    """The query goes through the same codes as the stored vectors."""
    low, high = CODES[bits]
    x = np.asarray(query, np.float64)
    least, most = x.min(), x.max()
    if most > least:
        scale = (high - low) / max(most - least, 1.1920928955078125e-7)
        bias = low - least * scale
        t = x * scale + bias
        x = (np.clip(np.sign(t) * np.floor(np.abs(t) + 0.5), low, high) - bias) / scale
    return score(metric, dequantize(q), x.tolist())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(v: pd.Series) -> pd.Series:
    """Values as IEEE half holds them, rounded to nearest even; overflow is an error."""

    real = v.notna().to_numpy()
    rows = [np.asarray(x, np.float32) for x in v[real]]
    out: list = [None] * len(v)
    if rows:
        with np.errstate(over="ignore"):
            flat = np.concatenate(rows).astype(np.float16)
        if not np.isfinite(flat).all():
            raise ValueError("a value is too large for half precision")
        at = np.flatnonzero(real)
        for i, part in zip(at.tolist(), np.split(flat.astype(np.float32), np.cumsum([len(r) for r in rows])[:-1]), strict=True):
            out[i] = part
    return pd.Series(out, index=v.index, dtype=object)


def half_bits(x: float) -> int:
    """The bits of a value in IEEE half."""
    return int(np.float32(x).astype(np.float16).view(np.uint16))


def half_value(bits: int) -> float:
    return float(np.uint16(bits).view(np.float16))
