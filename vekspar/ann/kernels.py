"""Training and search kernels in numpy: k-means, rotation, product quantization, RaBitQ, graphs.

They run in one task over a segment's vectors (or a bounded sample), never over a whole table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np

from ..functions.vectors import scores
from ..schema import MetricType

EXACT_BELOW = 1000


def distances(metric: MetricType, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Scores with the sign that makes smaller better."""
    s = scores(metric, rows, query)
    return -s if metric.descending else s


# --- k-means -------------------------------------------------------------------------------


def nearest(metric: MetricType, rows: np.ndarray, centroids: np.ndarray, block: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Best centroid of each row (the lower one in a tie) and its distance."""
    labels, best = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for a in range(0, len(rows), block):
        d = distances(metric, rows[a : a + block], centroids)
        d = d.reshape(len(rows[a : a + block]), -1)
        labels[a : a + block] = d.argmin(axis=1)
        best[a : a + block] = d.min(axis=1)
    return labels, best


def kmeans(rows: np.ndarray, k: int, metric: MetricType = MetricType.L2, rounds: int = 10, seed: int = 0, plus_plus: bool = False, empty: str = "farthest", spherical: bool = False, tolerance: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and labels by Lloyd's algorithm. empty: keep, farthest (reseed) or drop."""
    rows = rows.astype(np.float64)
    k, r = min(k, len(rows)), np.random.default_rng(seed)
    if plus_plus:
        chosen = [int(r.integers(len(rows)))]
        d = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
        while len(chosen) < k:
            p = d / d.sum() if d.sum() > 0 else np.full(len(rows), 1 / len(rows))
            chosen.append(int(r.choice(len(rows), p=p)))
            d = np.minimum(d, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    else:
        chosen = r.choice(len(rows), k, replace=False).tolist()
    c, before = rows[chosen].copy(), 0.0
    for _ in range(rounds):
        labels, best = nearest(metric, rows, c)
        n = np.bincount(labels, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, labels, rows)
        filled = n > 0
        c[filled] = sums[filled] / n[filled, None]
        repaired = False
        if not filled.all() and empty == "farthest":
            far = np.argsort(-best, kind="stable")
            for i, at in zip(np.flatnonzero(~filled), far, strict=False):
                c[i] = rows[at]
            repaired = True
        elif not filled.all() and empty == "drop":
            c = c[filled]
        if spherical:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = np.where(norm > 0, c / np.where(norm == 0, 1, norm), c)
        cost = float(best.sum())
        if not repaired and abs(cost - before) < tolerance:
            break
        before = cost
    return c, nearest(metric, rows, c)[0]


# --- Rotation ------------------------------------------------------------------------------


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of rows whose length is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
        h *= 2
    return x


class Rotation:
    """Four rounds of sign flips and transforms; lengths between powers of two use two windows."""

    def __init__(self, dim: int, seed: int = 0) -> None:
        self.dim, self.size = dim, 1 << (dim.bit_length() - 1)
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (4, dim))

    def _window(self, x: np.ndarray, start: int) -> None:
        at = slice(start, start + self.size)
        x[:, at] = hadamard(x[:, at]) / math.sqrt(self.size)

    def rotate(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64).copy()
        for i, s in enumerate(self.signs):
            x *= s
            self._window(x, 0 if i % 2 == 0 else self.dim - self.size)
        return x

    def restore(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64).copy()
        for i in reversed(range(4)):
            self._window(x, 0 if i % 2 == 0 else self.dim - self.size)
            x *= self.signs[i]
        return x


# --- Product quantization ------------------------------------------------------------------


class ProductQuantizer:
    """8-bit codes for each chunk of the dimensions; wider chunks come first."""

    def __init__(self, rows: np.ndarray, chunks: int, metric: MetricType = MetricType.L2, seed: int = 0, rounds: int = 12, most: int = 200_000) -> None:
        rows, dim = rows[:most].astype(np.float64), rows.shape[1]
        widths = [dim // chunks + (i < dim % chunks) for i in range(chunks)]
        self.bounds, self.metric = np.concatenate(([0], np.cumsum(widths))), metric
        self.books = []
        for i in range(chunks):
            part = rows[:, self.bounds[i] : self.bounds[i + 1]]
            book, _ = kmeans(part, 256, rounds=rounds, seed=seed + i, plus_plus=len(part) <= 4096)
            self.books.append(np.concatenate((book, np.repeat(book[:1], 256 - len(book), axis=0))))

    def encode(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([nearest(MetricType.L2, rows[:, a:b], book)[0].astype(np.uint8) for a, b, book in zip(self.bounds[:-1], self.bounds[1:], self.books, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)

    def table(self, query: np.ndarray) -> np.ndarray:
        """For each chunk the part of each centroid in the distance (L2) or the negated product."""
        parts = [query[a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        if self.metric == MetricType.IP:
            return np.stack([-(book @ p) for p, book in zip(parts, self.books, strict=True)])
        return np.stack([((book - p) ** 2).sum(axis=1) for p, book in zip(parts, self.books, strict=True)])

    def pairs(self, queries: np.ndarray, codes: np.ndarray) -> Pairs:
        """distances() of queries (by their places) from coded rows, pair by pair."""
        parts = [queries[:, a:b] for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True)]
        if self.metric == MetricType.IP:
            table = np.stack([-(p @ book.T) for p, book in zip(parts, self.books, strict=True)], axis=1)
        else:
            table = np.stack([((book[None] - p[:, None]) ** 2).sum(axis=2) for p, book in zip(parts, self.books, strict=True)], axis=1)
        chunk = np.arange(table.shape[1])
        return lambda at, nodes: table[at[:, None], chunk, codes[nodes]].sum(axis=1)

    def distances(self, table: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return table[np.arange(len(table)), codes].sum(axis=1)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"pq_bounds": self.bounds, "pq_metric": np.array(int(self.metric)), "pq_books": np.concatenate([b.ravel() for b in self.books])}

    @classmethod
    def load(cls, a: dict[str, np.ndarray]) -> ProductQuantizer:
        out = cls.__new__(cls)
        out.bounds, out.metric = a["pq_bounds"], MetricType(int(a["pq_metric"]))
        widths = np.diff(out.bounds)
        out.books = [b.reshape(256, -1) for b in np.split(a["pq_books"], np.cumsum(widths * 256)[:-1])]
        return out


# --- RaBitQ --------------------------------------------------------------------------------


class RaBitQ:
    """Sign and magnitude bits of rotated residuals, with factors that correct their length."""

    def __init__(self, rows: np.ndarray, metric: MetricType, bits: int = 7, clusters: int = 16, sample: int = 0, seed: int = 0) -> None:
        rows = self._prepared(rows, metric)
        self.metric, self.bits, self.dim = metric, bits, -(-rows.shape[1] // 64) * 64
        self.rotation = Rotation(self.dim, seed)
        train = rows[:sample] if sample else rows
        inner = metric != MetricType.L2
        centroids, _ = kmeans(train, clusters, MetricType.IP if inner else MetricType.L2, seed=seed, spherical=inner)
        self.centroids = self.rotation.rotate(self._padded(centroids))
        r = np.random.default_rng(seed).standard_normal((100, self.dim))
        r = np.abs(r / np.linalg.norm(r, axis=1, keepdims=True))
        # The scale that spreads typical magnitudes over the codes.
        self.scale = ((1 << (bits - 1)) - 1) / float(np.quantile(r, 0.995)) if bits > 1 else 0.0

    @staticmethod
    def _prepared(rows: np.ndarray, metric: MetricType) -> np.ndarray:
        rows = rows.astype(np.float64)
        if metric == MetricType.COSINE:
            n = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.where(n > 0, rows / np.where(n == 0, 1, n), rows)
        return rows

    def _padded(self, rows: np.ndarray) -> np.ndarray:
        return np.pad(rows, ((0, 0), (0, self.dim - rows.shape[1])))

    def encode(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        x = self.rotation.rotate(self._padded(self._prepared(rows, self.metric)))
        cluster, _ = nearest(MetricType.IP if self.metric != MetricType.L2 else MetricType.L2, x, self.centroids)
        r = x - self.centroids[cluster]
        norm = np.linalg.norm(r, axis=1)
        unit = np.abs(r) / np.where(norm == 0, 1, norm)[:, None]
        sign = np.where(r >= 0, 1.0, -1.0)
        code = sign * 0.5
        if self.bits > 1:
            code = sign * (np.clip((self.scale * unit + 1e-5).astype(np.int64), 0, (1 << (self.bits - 1)) - 1) + 0.5)
        dot = (r * code).sum(axis=1)
        factor = np.where(dot == 0, 0.0, norm**2 / np.where(dot == 0, 1, dot))
        fit = (norm * np.linalg.norm(code, axis=1) / np.where(dot == 0, 1, dot)) ** 2
        return {"code": code.astype(np.float32), "cluster": cluster, "factor": factor, "norm": norm, "error": norm * np.sqrt(np.maximum(fit - 1, 0) / max(1, self.dim - 1))}

    def arrays(self) -> dict[str, np.ndarray]:
        return {"rq_metric": np.array(int(self.metric)), "rq_bits": np.array(self.bits), "rq_dim": np.array(self.dim), "rq_signs": self.rotation.signs, "rq_centroids": self.centroids, "rq_scale": np.array(self.scale)}

    @classmethod
    def load(cls, a: dict[str, np.ndarray]) -> RaBitQ:
        out = cls.__new__(cls)
        out.metric, out.bits, out.dim = MetricType(int(a["rq_metric"])), int(a["rq_bits"]), int(a["rq_dim"])
        out.rotation = Rotation(out.dim)
        out.rotation.signs, out.centroids, out.scale = a["rq_signs"], a["rq_centroids"], float(a["rq_scale"])
        return out

    def estimate(self, coded: dict[str, np.ndarray], query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated scores in the metric's own sense, and a bound of their error."""
        q = self.rotation.rotate(self._padded(self._prepared(query[None], self.metric)))[0]
        c = self.centroids[coded["cluster"]]
        residual = q - c
        length = np.linalg.norm(residual, axis=1)
        # <r, q - c> by <code, q - c> * |r|^2 / <r, code>
        inner = (coded["code"] * residual).sum(axis=1) * coded["factor"]
        if self.metric == MetricType.L2:
            return coded["norm"] ** 2 + length**2 - 2 * inner, 3.8 * coded["error"] * length
        dot = inner + (c * q).sum(axis=1) + (coded["code"] * c).sum(axis=1) * coded["factor"]
        return (1 - dot if self.metric == MetricType.COSINE else dot), 1.9 * coded["error"] * np.linalg.norm(q)


    def many(self, coded: dict[str, np.ndarray], queries: np.ndarray) -> tuple[Pairs, Callable[[np.ndarray], np.ndarray]]:
        """The scores of estimate() for queries (by their places) and rows: pair by pair, and of some queries with all rows."""
        q = self.rotation.rotate(self._padded(self._prepared(queries, self.metric)))
        code, cluster, factor = coded["code"].astype(np.float64), coded["cluster"], coded["factor"]
        products, own = q @ self.centroids.T, np.einsum("ij,ij->i", code, self.centroids[cluster])
        if self.metric == MetricType.L2:
            far = np.maximum((q**2).sum(axis=1)[:, None] + (self.centroids**2).sum(axis=1)[None] - 2 * products, 0)
            fixed = coded["norm"] ** 2 + 2 * own * factor

        def score(dots: np.ndarray, at: np.ndarray, nodes: np.ndarray | slice) -> np.ndarray:
            if self.metric == MetricType.L2:
                return fixed[nodes] + far[at, cluster[nodes]] - 2 * dots * factor[nodes]
            dot = dots * factor[nodes] + products[at, cluster[nodes]]
            return 1 - dot if self.metric == MetricType.COSINE else dot

        return lambda at, nodes: score(np.einsum("ij,ij->i", code[nodes], q[at]), at, nodes), lambda at: score(q[at] @ code.T, at[:, None], slice(None))


# --- Graphs --------------------------------------------------------------------------------

Pairs = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _combined(metric: MetricType, dots: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """Distances from products and squared norms."""
    if metric == MetricType.IP:
        return -dots
    if metric == MetricType.L2:
        return a2 + b2 - 2 * dots
    if metric == MetricType.COSINE:
        scale = np.sqrt(a2) * np.sqrt(b2)
        return np.where(scale == 0, np.where((a2 == 0) & (b2 == 0), 0.0, 1.0), 1 - dots / np.where(scale == 0, 1, scale))
    most = np.maximum(a2, b2)
    return np.where(most == 0, 0.0, 2 - 2 * dots / np.where(most == 0, 1, most))


class Dense:
    """Rows of equal length under a metric."""

    def __init__(self, rows: np.ndarray, metric: MetricType) -> None:
        self.rows, self.metric = np.ascontiguousarray(rows, np.float64), metric
        self._square = (self.rows**2).sum(axis=1)

    def __len__(self) -> int:
        return len(self.rows)

    @property
    def cells(self) -> int:
        return max(1, self.rows.shape[1])

    def matrix(self, a: np.ndarray, b: np.ndarray | slice) -> np.ndarray:
        """Distances of each of a from each of b."""
        return _combined(self.metric, self.rows[a] @ self.rows[b].T, self._square[a][:, None], self._square[b][None])

    def among(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Distances of each node from the others in its row."""
        dots = np.matmul(self.rows[others], self.rows[nodes][:, :, None])[:, :, 0]
        return _combined(self.metric, dots, self._square[nodes][:, None], self._square[others])

    def to(self, query: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        return lambda o: distances(self.metric, self.rows[o], query)

    def pairs(self, queries: np.ndarray) -> Pairs:
        """Distances of queries (by their places) from nodes, pair by pair."""
        square = (queries**2).sum(axis=1)

        def of(at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            x, q = self.rows[nodes], queries[at]
            if self.metric == MetricType.L2:
                x -= q
                return np.einsum("ij,ij->i", x, x)
            return _combined(self.metric, np.einsum("ij,ij->i", x, q), self._square[nodes], square[at])

        return of


class Sparse:
    """Sparse rows under the inner product: row i has the coordinates from bounds[i] to bounds[i + 1].

    With few coordinates in all, there is a dense copy for work on many rows at once.
    """

    def __init__(self, bounds: np.ndarray, indices: np.ndarray, values: np.ndarray, most: int = 1 << 24) -> None:
        self.bounds, self.indices, self.values = bounds.astype(np.int64), indices, values.astype(np.float64)
        self.dims, self._at = np.unique(indices, return_inverse=True)
        self.dense = None
        if len(self) * len(self.dims) <= most:
            whole = np.zeros((len(self), max(1, len(self.dims))))
            whole[np.repeat(np.arange(len(self)), np.diff(self.bounds)), self._at] = self.values
            self.dense = Dense(whole, MetricType.IP)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @property
    def cells(self) -> int:
        return self.dense.cells if self.dense else max(1, len(self.indices) // max(1, len(self)))

    def _dots(self, others: np.ndarray, dense: np.ndarray) -> np.ndarray:
        sizes = self.bounds[others + 1] - self.bounds[others]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.bounds[others] - (ends - sizes), sizes)
        return np.bincount(np.repeat(np.arange(len(others)), sizes), weights=self.values[at] * dense[self._at[at]], minlength=len(others))

    def _between(self, i: int, others: np.ndarray) -> np.ndarray:
        own, dense = slice(self.bounds[i], self.bounds[i + 1]), np.zeros(len(self.dims))
        dense[self._at[own]] = self.values[own]
        return -self._dots(np.asarray(others), dense)

    def matrix(self, a: np.ndarray, b: np.ndarray | slice) -> np.ndarray:
        if self.dense:
            return self.dense.matrix(a, b)
        b = np.arange(len(self))[b]
        return np.stack([self._between(i, b) for i in a.tolist()])

    def among(self, nodes: np.ndarray, others: np.ndarray) -> np.ndarray:
        if self.dense:
            return self.dense.among(nodes, others)
        return np.stack([self._between(i, o) for i, o in zip(nodes.tolist(), others, strict=True)])

    def vector(self, query: dict[int, float]) -> np.ndarray:
        """A query's values at the coordinates that the rows have."""
        dense = np.zeros(max(1, len(self.dims)))
        for d, x in query.items():
            at = int(np.searchsorted(self.dims, d))
            if at < len(self.dims) and self.dims[at] == d:
                dense[at] = x
        return dense

    def aligned(self, other: Sparse, a: int, b: int) -> np.ndarray:
        """other's rows from a to b at the coordinates that these rows have."""
        out, part = np.zeros((b - a, max(1, len(self.dims)))), slice(other.bounds[a], other.bounds[b])
        rows, values = np.repeat(np.arange(b - a), np.diff(other.bounds[a : b + 1])), other.values[part]
        at = np.minimum(np.searchsorted(self.dims, other.indices[part]), max(0, len(self.dims) - 1))
        same = self.dims[at] == other.indices[part] if len(self.dims) else np.zeros(len(at), bool)
        out[rows[same], at[same]] = values[same]
        return out

    def many(self, queries: np.ndarray) -> np.ndarray:
        """Distances of aligned queries from all rows."""
        if self.dense:
            return -(queries @ self.dense.rows.T)
        return np.stack([-self._dots(np.arange(len(self)), q) for q in queries])

    def to(self, query: dict[int, float]) -> Callable[[np.ndarray], np.ndarray]:
        dense = self.vector(query)
        return lambda o: -self._dots(np.asarray(o), dense)


# --- Building: whole blocks of nodes at once ------------------------------------------------


def first_copies(space: Dense | Sparse) -> np.ndarray:
    """For each row the first that is equal to it (under cosine: that has its direction)."""
    if isinstance(space, Sparse):
        seen: dict[tuple[bytes, bytes], int] = {}
        ends = zip(space.bounds[:-1].tolist(), space.bounds[1:].tolist(), strict=True)
        return np.array([seen.setdefault((space.indices[a:b].tobytes(), space.values[a:b].tobytes()), i) for i, (a, b) in enumerate(ends)], np.int64)
    rows = space.rows
    if space.metric == MetricType.COSINE:
        rows = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)).round(12)
    whole = np.ascontiguousarray(rows + 0.0).view(f"V{8 * rows.shape[1]}").ravel() if rows.shape[1] else np.zeros(len(rows))
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    return first[group]


def chained(links: list[np.ndarray], first: np.ndarray) -> None:
    """Links rows to their next equal one, and back to the first, so that a walk finds equal rows one after another.

    Equal rows take no part in the graph: each would stand before all that the other could link to.
    """
    order = np.lexsort((np.arange(len(first)), first))
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        if first[a] == first[b]:
            links[a], links[b] = np.append(links[a], b), np.array([first[b]], np.int64)


def earlier(space: Dense | Sparse, nodes: np.ndarray, width: int, cells: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of nodes, each node with the width nearest (-1: none) of those before it, best first, and their distances.

    That is what a graph that grows node by node looks for, found exactly. Memory is bounded by cells.
    """
    n = len(nodes)
    block = max(1, min(1024, cells // max(1, n)))
    for a in range(1, n, block):
        b = min(n, a + block)
        d = space.matrix(nodes[a:b], nodes[: b - 1])
        d[np.arange(b - 1)[None] >= np.arange(a, b)[:, None]] = np.inf
        at = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
        at = np.sort(at, axis=1)
        d = np.take_along_axis(d, at, axis=1)
        order = np.argsort(d, axis=1, kind="stable")
        at, d = np.take_along_axis(at, order, axis=1), np.take_along_axis(d, order, axis=1)
        yield nodes[a:b], np.where(np.isfinite(d), nodes[at], -1), d


def chosen(space: Dense | Sparse, near: np.ndarray, d: np.ndarray, room: int, alpha: float | None = None, saturate: bool = False) -> list[np.ndarray]:
    """Of each row's candidates (nearest first; -1: none) up to room that no kept one stands before.

    Without alpha a candidate is kept if it is nearer to the owner than to any kept one. With alpha it is
    kept if it is nearer than limit times that, with limits from 1 up to alpha as there is room.
    """
    count = np.zeros(len(near), np.int64)
    kept = np.full((len(near), room), -1, np.int64)
    last = 1.0
    while alpha is not None and last * 1.2 <= alpha + 1e-9:
        last *= 1.2
    all_near = near
    rows, dead, limit = np.arange(len(near)), near < 0, np.ones(len(near))
    worst = np.where(dead, np.inf, 0.0)
    shift = np.minimum(0.0, np.where(dead, 0.0, d).min(axis=1, initial=0.0))[:, None] - 1e-9  # products may be negative
    while len(rows):
        free = worst <= limit[:, None]
        some, full = free.any(axis=1), count[rows] >= room
        limit = np.where(~some & ~full, limit * 1.2, limit)
        going = ~full & (some | (limit <= last + 1e-9))
        many = int((worst <= last + 1e-9).sum(axis=1).max(initial=0))
        if 2 * going.sum() <= len(rows) or 2 * many <= near.shape[1]:
            order = np.argsort(worst[going] > last + 1e-9, axis=1, kind="stable")[:, : max(1, many)]
            rows, limit, shift, some = rows[going], limit[going], shift[going], some[going]
            near, d, worst = (np.take_along_axis(x[going], order, axis=1) for x in (near, d, worst))
            going = np.ones(len(rows), bool)
            if not len(rows):
                break
            free = worst <= limit[:, None]
        act = some & going
        if not act.any():
            continue
        pick, line = free.argmax(axis=1), np.arange(len(rows))
        nodes = near[line, pick]
        at = rows[act]
        kept[at, count[at]] = nodes[act]
        count[at] += 1
        other = space.among(np.where(act, nodes, 0), np.maximum(near, 0))
        ratio = np.where(other <= d, np.inf, 0.0) if alpha is None else (d - shift) / np.maximum(other - shift, 1e-12)
        worst = np.where(act[:, None], np.maximum(worst, ratio), worst)
        worst[line[act], pick[act]] = np.inf
    out = [k[:n] for k, n in zip(kept, count.tolist(), strict=True)]
    if saturate:
        out = [np.append(k, [x for x in c[c >= 0].tolist() if x not in set(k.tolist())][: room - len(k)]).astype(np.int64) for k, c in zip(out, all_near, strict=True)]
    return out


def linked(space: Dense | Sparse, nodes: np.ndarray, width: int, room: int, alpha: float | None = None, most: int | None = None, saturate: bool = False, cells: int = 1 << 22) -> list[np.ndarray]:
    """The links of nodes in the order given (by node; none for others): of each to chosen earlier ones, and back, chosen again where they are too many."""
    n, sources, targets = len(space), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    block = max(1, cells // (max(1, width) * space.cells))

    def pick(near: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        return [x for a in range(0, len(near), block) for x in chosen(space, near[a : a + block], d[a : a + block], room, alpha, saturate)]

    for owners, near, d in earlier(space, nodes, width, cells):
        own = pick(near[:, :most], d[:, :most])
        sources.append(np.repeat(owners, [len(x) for x in own]))
        targets += own
    source, target = np.concatenate(sources), np.concatenate(targets)
    step = max(1, cells // space.cells)
    d = np.concatenate([np.zeros(0), *(space.among(source[a : a + step], target[a : a + step, None])[:, 0] for a in range(0, len(source), step))])
    owner, other, d = np.concatenate((source, target)), np.concatenate((target, source)), np.concatenate((d, d))
    order = np.lexsort((other, d, owner))
    other, d, counts = other[order], d[order], np.bincount(owner, minlength=n)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    links = [other[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    crowded = np.flatnonzero(counts > room)
    crowded = crowded[np.argsort(counts[crowded], kind="stable")]
    a = 0
    while a < len(crowded):
        b = a + 1
        while b < len(crowded) and (b + 1 - a) * min(most or n, int(counts[crowded[b]])) * space.cells <= cells:
            b += 1
        some = crowded[a:b]
        wide = min(most or n, int(counts[some].max()))
        at = np.minimum(bounds[some][:, None] + np.arange(wide)[None], len(other) - 1)
        there = np.arange(wide)[None] < counts[some][:, None]
        for i, x in zip(some.tolist(), chosen(space, np.where(there, other[at], -1), np.where(there, d[at], np.inf), room, alpha, saturate), strict=True):
            links[i] = x
        a = b
    return links


def connected(space: Dense | Sparse, links: list[np.ndarray], nodes: np.ndarray, entry: int, cells: int = 1 << 22) -> None:
    """Gives nodes that no walk from the entry reaches a link from the nearest one that it does."""
    seen = np.zeros(len(space), bool)
    seen[entry] = True
    front = np.array([entry])
    while len(front):
        near = np.unique(np.concatenate([links[i] for i in front.tolist()]))
        front = near[~seen[near]]
        seen[front] = True
    reached, lost = nodes[seen[nodes]], nodes[~seen[nodes]]
    step = max(1, cells // max(1, len(reached)))
    for a in range(0, len(lost), step):
        for i, j in zip(reached[space.matrix(lost[a : a + step], reached).argmin(axis=1)].tolist(), lost[a : a + step].tolist(), strict=True):
            links[i] = np.append(links[i], j)


# --- Walks ----------------------------------------------------------------------------------


def padded(links: list[np.ndarray]) -> np.ndarray:
    """Links as one matrix, -1 where there are fewer."""
    sizes = np.array([len(x) for x in links])
    out = np.full((len(links), max(1, int(sizes.max(initial=0)))), -1, np.int32)
    out[np.arange(out.shape[1])[None] < sizes[:, None]] = np.concatenate([*links, np.zeros(0)])
    return out


def walk_many(links: np.ndarray, start: np.ndarray, pairs: Pairs, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """beam() for many queries side by side: nodes (-1: none) and distances, best first. Each step opens up to step nodes of each query."""
    many, n = len(start), len(links)
    line = np.arange(many)
    ids, d = np.full((many, width), -1, np.int64), np.full((many, width), np.inf)
    ids[:, 0], d[:, 0] = start, pairs(line, start)
    opened = d == np.inf
    seen = np.zeros((many, n), np.uint16)  # the place, from 1, at which a node came up last
    seen[line, start] = 1
    active = line
    step = min(step, width)
    while len(active):
        waiting = np.where(opened[active], np.inf, d[active])
        pick = np.argpartition(waiting, step - 1, axis=1)[:, :step] if step < width else np.broadcast_to(np.arange(width), waiting.shape)
        good = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
        going = good.any(axis=1)
        active, pick, good = active[going], pick[going], good[going]
        if not len(active):
            break
        a = active[:, None]
        opened[a, pick] = True
        near = np.where(good[:, :, None], links[ids[a, pick]], -1).reshape(len(active), -1)
        fresh = (near >= 0) & (seen[a, near] == 0)
        at, place = np.nonzero(fresh)
        nodes = near[at, place]
        seen[active[at], nodes] = place + 1
        once = seen[active[at], nodes] == place + 1  # a node that two opened ones share comes up once
        at, place, nodes = at[once], place[once], nodes[once]
        found = np.full(near.shape, np.inf)
        found[at, place] = pairs(active[at], nodes)
        whole_d, whole_ids = np.concatenate((d[active], found), axis=1), np.concatenate((ids[active], near), axis=1)
        whole_open = np.concatenate((opened[active], ~np.isfinite(found)), axis=1)
        best = np.argpartition(whole_d, width - 1, axis=1)[:, :width]
        d[active], ids[active], opened[active] = (np.take_along_axis(x, best, axis=1) for x in (whole_d, whole_ids, whole_open))
    order = np.lexsort((ids, d), axis=1)
    ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
    return np.where(np.isfinite(d), ids, -1), d


def beam(start: list[int], neighbours: Callable[[int], np.ndarray], distance: Callable[[np.ndarray], np.ndarray], width: int, size: int, allowed: np.ndarray | None = None) -> list[tuple[float, int]]:
    """Best-first search with a list of width nodes; (distance, node), best first.

    All nodes are walked, but only allowed ones are accepted, so a filter doesn't shorten the result.
    """
    seen = np.zeros(size, bool)
    seen[start] = True
    d = distance(np.array(start))
    todo = [(float(x), i) for x, i in zip(d, start, strict=True)]
    heapq.heapify(todo)
    best = [(-x, -i) for x, i in todo if allowed is None or allowed[i]]
    heapq.heapify(best)
    while todo:
        x, i = heapq.heappop(todo)
        if len(best) >= width and (x, i) > (-best[0][0], -best[0][1]):
            break
        near = neighbours(i)
        near = near[~seen[near]]
        if len(near):
            seen[near] = True
            for y, j in zip(distance(near).tolist(), near.tolist(), strict=True):
                if len(best) < width or (y, j) < (-best[0][0], -best[0][1]):
                    heapq.heappush(todo, (y, j))
                    if allowed is None or allowed[j]:
                        heapq.heappush(best, (-y, -j))
                        if len(best) > width:
                            heapq.heappop(best)
    return sorted((-x, -i) for x, i in best)


def scan(distance: Callable[[np.ndarray], np.ndarray], nodes: np.ndarray, width: int) -> list[tuple[float, int]]:
    """The width best of some nodes, exactly."""
    d = distance(nodes) if len(nodes) else np.zeros(0)
    return sorted(zip(d.tolist(), nodes.tolist(), strict=True))[:width]


def walked(walk: Callable[[int], list[tuple[float, int]]], distance: Callable[[np.ndarray], np.ndarray], width: int, size: int, allowed: np.ndarray | None, exact_share: float) -> list[tuple[float, int]]:
    """A walk, or an exact scan where few nodes are allowed or the walk has missed some that it should have found."""
    if allowed is None:
        return walk(width)
    nodes = np.flatnonzero(allowed)
    if len(nodes) <= max(width, exact_share * size):
        return scan(distance, nodes, width)
    found = walk(width)
    return found if len(found) >= min(width, len(nodes)) else scan(distance, nodes, width)


def flat_links(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(([0], np.cumsum([len(x) for x in links]))).astype(np.int64), np.concatenate([*links, np.zeros(0)]).astype(np.int32)


def cut_links(bounds: np.ndarray, flat: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b].astype(np.int64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class HNSW:
    """Layers of navigable graphs; below EXACT_BELOW rows the search is exact.

    A node's links are chosen from the ef_construction nearest of the nodes before it, as if nodes came one by one.
    """

    def __init__(self, space: Dense | Sparse, m: int = 50, ef_construction: int = 500, seed: int = 0, exact_below: int = EXACT_BELOW) -> None:
        self.space, self.m = space, m
        n = len(space)
        levels = np.minimum(14, (-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(max(2, m))).astype(int))
        self.entry = -1
        if n <= exact_below:
            self.links: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] * (int(v) + 1) for v in levels]
            return
        first = first_copies(space)
        own = first == np.arange(n)
        levels = np.where(own, levels, 0)
        self.links = [[np.zeros(0, np.int64)] * (int(v) + 1) for v in levels]
        self.entry = int(levels.argmax()) if levels.any() else int(first[0])
        for level in range(int(levels.max()) + 1):
            nodes = np.flatnonzero(own & (levels >= level))
            links = linked(space, nodes, ef_construction, self._room(level))
            if level == 0:
                connected(space, links, nodes, self.entry)
                chained(links, first)
                nodes = np.arange(n)
            for i in nodes.tolist():
                self.links[i][level] = links[i]

    def _room(self, level: int) -> int:
        return 2 * self.m if level == 0 else self.m

    def search(self, query, width: int, distance: Callable[[np.ndarray], np.ndarray] | None = None, allowed: np.ndarray | None = None, exact_share: float = 0.1) -> list[tuple[float, int]]:
        """(distance, row) of up to width allowed rows, best first; distance replaces the space's own."""
        of, n = distance or self.space.to(query), len(self.space)
        if self.entry < 0:
            return scan(of, np.arange(n) if allowed is None else np.flatnonzero(allowed), width)

        def walk(width: int) -> list[tuple[float, int]]:
            at = [self.entry]
            for level in range(len(self.links[self.entry]) - 1, 0, -1):
                at = [v for _, v in beam(at, lambda v, lv=level: self.links[v][lv], of, 1, n)]
            return beam(at, lambda v: self.links[v][0], of, width, n, allowed)

        return walked(walk, of, width, n, allowed, exact_share)

    def search_many(self, queries: np.ndarray, width: int, pairs: Pairs | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Walks of the lowest layer for many queries, each from the nearest node of the layers above."""
        space = self.space.dense if isinstance(self.space, Sparse) else self.space
        if not hasattr(self, "_flat"):
            self._flat = padded([x[0] for x in self.links])
            self._upper = np.array([i for i, x in enumerate(self.links) if len(x) > 1 or i == self.entry], np.int64)
        upper = self._upper
        d = distances(space.metric, space.rows[upper], queries).reshape(len(upper), -1)
        return walk_many(self._flat, upper[d.argmin(axis=0)], pairs or space.pairs(queries), width)

    def arrays(self) -> dict[str, np.ndarray]:
        bounds, flat = flat_links([x for node in self.links for x in node])
        return {"levels": np.array([len(x) for x in self.links], np.int32), "bounds": bounds, "links": flat, "entry": np.array(self.entry), "m": np.array(self.m)}

    @classmethod
    def load(cls, space: Dense | Sparse, a: dict[str, np.ndarray]) -> HNSW:
        out = cls.__new__(cls)
        out.space, out.m, out.entry = space, int(a["m"]), int(a["entry"])
        flat, at, out.links = cut_links(a["bounds"], a["links"]), 0, []
        for n in a["levels"].tolist():
            out.links.append(flat[at : at + n])
            at += n
        return out


class Vamana:
    """A flat graph pruned for long links; with a product quantizer the frontier is ordered by codes."""

    def __init__(self, space: Dense, degree: int = 64, list_size: int = 100, alpha: float = 1.2, most: int = 750, saturate: bool = False, exact_below: int = EXACT_BELOW) -> None:
        self.space, n = space, len(space)
        self.links, self.entry = [np.zeros(0, np.int64)] * n, -1
        if n <= exact_below:
            return
        self.entry = int(((space.rows - space.rows.mean(axis=0)) ** 2).sum(axis=1).argmin())
        first = first_copies(space)
        self.entry = int(first[self.entry])
        nodes = np.flatnonzero(first == np.arange(n))
        nodes = np.concatenate(([self.entry], nodes[nodes != self.entry]))
        self.links = linked(space, nodes, list_size, degree, alpha, most, saturate)
        connected(space, self.links, nodes, self.entry)
        chained(self.links, first)

    def search(self, query: np.ndarray, width: int, quick: Callable[[np.ndarray], np.ndarray] | None = None, allowed: np.ndarray | None = None, exact_share: float = 0.1) -> list[tuple[float, int]]:
        """(distance, row) of allowed rows, best first. quick orders the frontier; results have exact distances."""
        exact, n = self.space.to(query), len(self.space)
        if self.entry < 0:
            return scan(exact, np.arange(n) if allowed is None else np.flatnonzero(allowed), width)
        found = walked(lambda w: beam([self.entry], lambda v: self.links[v], quick or exact, w, n, allowed), exact, width, n, allowed, exact_share)
        if quick is None:
            return found
        return scan(exact, np.array([v for _, v in found], np.int64), width)

    def search_many(self, queries: np.ndarray, width: int, pairs: Pairs | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Walks for many queries; results have exact distances."""
        if not hasattr(self, "_flat"):
            self._flat = padded(self.links)
        exact = self.space.pairs(queries)
        ids, d = walk_many(self._flat, np.full(len(queries), self.entry), pairs or exact, width)
        if pairs is not None:
            at, place = np.nonzero(ids >= 0)
            d[at, place] = exact(at, ids[at, place])
            order = np.lexsort((ids, d), axis=1)
            ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
        return ids, d

    def arrays(self) -> dict[str, np.ndarray]:
        bounds, flat = flat_links(self.links)
        return {"bounds": bounds, "links": flat, "entry": np.array(self.entry)}

    @classmethod
    def load(cls, space: Dense, a: dict[str, np.ndarray]) -> Vamana:
        out = cls.__new__(cls)
        out.space, out.entry, out.links = space, int(a["entry"]), cut_links(a["bounds"], a["links"])
        return out
