"""A small causal self-attention model over token ids, in numpy.

The vocabulary is cut into classes: the most frequent ids are classes of their own, the others
share classes of equal mass (those that end a word apart from those that don't). Attention
predicts the next id's class from the ids before it; within a class the id has its smoothed
share of all training counts. So the probabilities of all ids sum to one.

One layer: embeddings and positions, masked attention, a feed-forward step, both with residual
connections, and a softmax over classes.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np

from .common import run_lengths

WINDOW, FRESH = 32, 24
DIM, HIDDEN = 16, 32
SCALE, LOG2E = np.float32(DIM**-0.5), np.float32(1.4426950409)
#: Rows of hidden states whose class scores are made at once.
BLOCK = 512
ONES, ZEROS = np.ones(WINDOW, np.float32), np.zeros(8 * HIDDEN, np.float32)


@dataclass
class Classes:
    of: np.ndarray  # class of each id
    inside: np.ndarray  # log10 of an id's share of its class
    count: int

    @classmethod
    def build(cls, counts: np.ndarray, ends_word: np.ndarray, single: int = 48, grouped: int = 48, smooth: float = 0.1) -> Classes:
        order = np.argsort(-counts, kind="stable")
        of = np.zeros(len(counts), np.int32)
        of[order[:single]] = np.arange(single)
        first = single
        for kind in (False, True):
            rest = order[single:][ends_word[order[single:]] == kind]
            mass = np.cumsum(counts[rest] + smooth)
            bins = np.minimum((mass / max(mass[-1], 1e-9) * (grouped // 2)).astype(np.int32), grouped // 2 - 1) if len(rest) else np.zeros(0, np.int32)
            of[rest] = first + bins
            first += grouped // 2
        weight = counts + smooth
        total = np.bincount(of, weights=weight, minlength=first)
        return cls(of, np.log10(weight / total[of]).astype(np.float32), first)


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping context windows over sequences that lie one after the other.

    For each window: where it starts, where its sequence ends, and from which place on its
    tokens are new. Each token is new in one window. Also the sequence of each window.
    """
    sizes = np.diff(bounds)
    many = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // FRESH) + 1, (sizes > 0).astype(np.int64))
    k = run_lengths(np.zeros(len(sizes), np.int64), many)
    seq = np.repeat(np.arange(len(sizes)), many)
    return bounds[:-1][seq] + k * FRESH, bounds[1:][seq], np.where(k > 0, WINDOW - FRESH, 0), seq


def powers(bits: np.ndarray, place: np.ndarray | None = None) -> np.ndarray | None:
    """Makes bits their powers of two, of 115 bits (80 nats) at most; returns what bits had at the flat places."""
    if not bits.max() <= 115:
        np.minimum(bits, 115, out=bits)
    before = None if place is None else bits.ravel()[place]
    np.exp2(bits, out=bits)
    return before


def turned(t: np.ndarray) -> np.ndarray:
    """The rows of each window as columns, in memory too: small products with these are far faster than with views."""
    return np.ascontiguousarray(t.reshape(-1, WINDOW, t.shape[1]).transpose(0, 2, 1))


def spread(t: np.ndarray) -> np.ndarray:
    """Each number in a row of DIM, as numpy is slow at stretching narrow rows by itself."""
    return np.repeat(t, DIM).reshape(-1, DIM)


def crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b over all rows of windows: a sum of small products, which are faster than a long one."""
    size = 8 * WINDOW if len(a) % (8 * WINDOW) == 0 else WINDOW
    return (a.reshape(-1, size, a.shape[1]).transpose(0, 2, 1) @ b.reshape(-1, size, b.shape[1])).sum(axis=0)


class Model:
    def __init__(self, classes: int, inputs: int, seed: int = 7) -> None:
        r = np.random.default_rng(seed)

        def make(*shape: int, scale: float) -> np.ndarray:
            return (r.standard_normal(shape) * scale).astype(np.float32)

        s = DIM**-0.5
        self.p = {
            "emb": make(inputs, DIM, scale=0.3), "pos": make(WINDOW, DIM, scale=0.1),
            "q": make(DIM, DIM, scale=s), "k": make(DIM, DIM, scale=s), "v": make(DIM, DIM, scale=s), "o": make(DIM, DIM, scale=s),
            "w1": make(DIM, HIDDEN, scale=s), "b1": np.zeros(HIDDEN, np.float32), "w2": make(HIDDEN, DIM, scale=HIDDEN**-0.5),
            "c": make(DIM, classes, scale=s), "cb": np.zeros(classes, np.float32),
        }
        self.open = np.tril(np.ones((WINDOW, WINDOW), np.float32))
        self.mask = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
        self.places = np.arange(inputs * DIM // 2).reshape(inputs, DIM // 2)  # of the pairs of numbers in each row of emb

    def forward(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Hidden states of input windows (n, WINDOW)."""
        p = self.p
        e = p["emb"][x] + p["pos"]
        q, k, v = e @ p["q"], e @ p["k"], e @ p["v"]
        a = q @ k.transpose(0, 2, 1)
        a *= DIM**-0.5
        a += self.mask
        a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        a /= a.sum(axis=2, keepdims=True)
        z = a @ v
        h = e + z @ p["o"]
        u = h @ p["w1"] + p["b1"]
        np.maximum(u, 0, out=u)
        m = h + u @ p["w2"]
        if keep is not None:
            keep.update(x=x, e=e, q=q, k=k, v=v, a=a, z=z, h=h, u=u, m=m)
        return m

    def hidden(self, x: np.ndarray, skip: int = 0) -> np.ndarray:
        """What forward() gives from place skip on, (n * (WINDOW - skip), DIM), with fewer passes over memory.

        Weights are powers of two without a shift, cut off far above what training reaches.
        """
        p, n = self.p, len(x)
        e = p["emb"].take(x.ravel(), axis=0)
        e.reshape(n, WINDOW, DIM)[...] += p["pos"]
        k, v = turned(e @ p["k"]), (e @ p["v"]).reshape(n, WINDOW, DIM)
        e = e.reshape(n, WINDOW, DIM)[:, skip:].reshape(-1, DIM)
        a = self._open_weights(e @ (p["q"] * (SCALE * LOG2E)), k)
        z = (a @ v).reshape(-1, DIM)
        z /= spread(a.reshape(-1, WINDOW) @ ONES)
        e += z @ p["o"]
        u = self._positive(e)
        e += u @ p["w2"]
        return e

    def _open_weights(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Attention weights of each window's last places before they are made to sum to one; k is turned, q . k counts in bits."""
        a = q.reshape(len(k), -1, DIM) @ k
        powers(a)
        a *= self.open[WINDOW - a.shape[1] :]
        return a

    def _positive(self, h: np.ndarray) -> np.ndarray:
        """What the first feed-forward layer yields; eight rows in one, as numpy is slow on narrow rows and with a single number."""
        u = h @ self.p["w1"]
        wide = u.reshape(-1, 8 * HIDDEN)
        wide += np.tile(self.p["b1"], 8)
        np.maximum(wide, ZEROS, out=wide)
        return u

    def _table(self) -> np.ndarray:
        """Weights and, as the last row, biases of the classes, in bits."""
        return np.vstack((self.p["c"], self.p["cb"])) * LOG2E

    def log10(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log10 of the probability of the target class, for rows of hidden states."""
        table, right, total = self.p["c"] * LOG2E, np.empty(len(target), np.float32), np.empty(len(target), np.float32)
        bias = (self.p["cb"] - self.p["cb"].max()) * LOG2E  # as factors of the powers; what all have in common cancels out
        factor, row = np.exp2(bias), np.arange(min(BLOCK, len(target))) * table.shape[1]
        for at in range(0, len(target), BLOCK):
            y = target[at : at + BLOCK]
            d = hidden[at : at + BLOCK] @ table
            right[at : at + BLOCK] = powers(d, row[: len(y)] + y)
            np.matmul(d, factor, out=total[at : at + BLOCK])
        right += bias.take(target)
        right -= np.log2(total)
        right *= np.float32(0.30102999566)
        return right

    def gradients(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss (nats) over real places and its gradients.

        Weights that would sum to one, and probabilities, are never divided by their sums: the
        narrower arrays that they are multiplied with are.
        """
        p, g, n = self.p, {}, len(x)
        at, y = x.ravel(), y.ravel()

        def cut(t: np.ndarray) -> np.ndarray:
            return t.reshape(n, WINDOW, t.shape[1])

        e = p["emb"].take(at, axis=0)
        cut(e)[...] += p["pos"]
        q, k, v = e @ (p["q"] * (SCALE * LOG2E)), e @ p["k"], e @ p["v"]
        a = self._open_weights(q, turned(k))
        sums = spread(a.reshape(-1, WINDOW) @ ONES)
        z = (a @ cut(v)).reshape(-1, DIM)
        z /= sums
        h = e + z @ p["o"]
        u = self._positive(h)
        m = np.ones((len(e), DIM + 1), np.float32)
        np.add(h, u @ p["w2"], out=m[:, :DIM])
        table, back = self._table(), np.ascontiguousarray(p["c"].T)
        ones, weight = np.ones(table.shape[1], np.float32), (real / real.sum()).ravel().astype(np.float32)
        classes, dm, total, right = np.zeros_like(table), np.empty_like(h), np.empty_like(weight), np.empty_like(weight)
        row = np.arange(min(BLOCK, len(m))) * table.shape[1]
        for lo in range(0, len(m), BLOCK):  # what is as wide as the classes stays in the cache
            rows, part = m[lo : lo + BLOCK], slice(lo, lo + BLOCK)
            d = rows @ table
            place = row[: len(d)] + y[part]
            right[part] = powers(d, place)
            d.ravel()[place] -= np.matmul(d, ones, out=total[part])
            classes += (rows * (weight[part] / total[part])[:, None]).T @ d
            np.matmul(d, back, out=dm[part])
        loss = float((np.log2(total) - right) @ weight) / float(LOG2E)
        dm *= spread(weight / total)
        g["c"], g["cb"] = classes[:DIM], classes[DIM]
        g["w2"] = crossed(u, dm)
        du = dm @ p["w2"].T
        du *= (u > 0).astype(np.float32)
        g["w1"], g["b1"] = crossed(h, du), np.ones(len(du), np.float32) @ du
        de = dm + du @ p["w1"].T
        g["o"] = crossed(z, de)
        dz = de @ p["o"].T
        dz /= sums
        both, turn = np.empty((len(e), DIM + 1), np.float32), np.ones((n, DIM + 1, WINDOW), np.float32)
        both[:, :DIM], turn[:, :DIM] = dz, cut(v).transpose(0, 2, 1)
        np.negative((dz * z) @ ONES[:DIM], out=both[:, DIM])  # the mean of ds under a
        ds = cut(both) @ turn
        ds *= a
        dx = np.empty((n, WINDOW, 3 * DIM), np.float32)  # of q, k and v, side by side
        np.matmul(ds, cut(k), out=dx[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), cut(q), out=dx[:, :, DIM : 2 * DIM])
        np.matmul(a.transpose(0, 2, 1), cut(dz), out=dx[:, :, 2 * DIM :])
        dx = dx.reshape(-1, 3 * DIM)
        found = crossed(e, dx)
        g["q"], g["k"], g["v"] = found[:, :DIM] * SCALE, found[:, DIM : 2 * DIM] / LOG2E, found[:, 2 * DIM :]
        de += dx @ np.hstack((p["q"] * SCALE, p["k"] / LOG2E, p["v"])).T
        g["pos"] = cut(de).sum(axis=0)
        g["emb"] = np.zeros_like(p["emb"])
        # Pairs of numbers are added as complex ones, which takes half as many places.
        np.add.at(g["emb"].ravel().view(np.complex64), self.places.take(at, axis=0).ravel(), de.ravel().view(np.complex64))
        return loss, g

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([v.ravel() for v in self.p.values()])

    def with_weights(self, flat: np.ndarray, shared: bool = False) -> Model:
        """A model of the same shape with weights as flat() gives them; shared: as views of flat."""
        out, at = copy.copy(self), 0
        out.p = {}
        for k, v in self.p.items():
            out.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32, copy=not shared)
            at += v.size
        return out

    def score(self, inputs: np.ndarray, target: np.ndarray, bounds: np.ndarray, batch: int = 128) -> np.ndarray:
        """log10 probability of each target class, in sequences that lie one after the other."""
        out = np.zeros(len(target), np.float32)
        padded = np.concatenate((inputs, np.zeros(WINDOW, inputs.dtype)))
        starts, ends, new, _ = windows(bounds)
        for skip in (0, WINDOW - FRESH):
            start, end, place = starts[new == skip], ends[new == skip], np.arange(WINDOW)
            for at in range(0, len(start), batch):
                pos = start[at : at + batch, None] + place
                hidden, pos = self.hidden(padded[pos], skip), pos[:, skip:]
                fresh = np.flatnonzero(pos < end[at : at + batch, None])
                where = pos.ravel()[fresh]
                out[where] = self.log10(hidden[fresh], target[where])
        return out


class Adam:
    """Steps of Adam on a model's weights, which become views of one row."""

    def __init__(self, model: Model) -> None:
        self.model, self.t, self.row = model, 0, model.flat()
        model.p = model.with_weights(self.row, shared=True).p
        self.first, self.second = np.zeros_like(self.row), np.zeros_like(self.row)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray, rate: float) -> float:
        self.t += 1
        loss, found = self.model.gradients(x, y, real)
        g = np.concatenate([found[k].ravel() for k in self.model.p])
        change = g - self.first
        change *= np.float32(0.1)
        self.first += change
        g *= g
        g -= self.second
        g *= np.float32(0.01)
        self.second += g
        np.multiply(self.second, np.float32(1 / (1 - 0.99**self.t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-8)
        np.divide(self.first, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.t))
        self.row -= g
        return loss


def all_windows(ids: np.ndarray, bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets (-1 behind the end) of windows that hold each id of each sequence once as a target."""
    sizes = np.diff(bounds)
    many = -(-sizes // WINDOW)
    k = run_lengths(np.zeros(len(sizes), np.int64), many)
    at = np.repeat(bounds[:-1], many) + k * WINDOW
    pos = at[:, None] + np.arange(WINDOW)
    inside = pos < np.repeat(bounds[1:], many)[:, None]
    ids = ids.astype(np.int32)  # -1 stands behind the end
    y = np.where(inside, ids[np.minimum(pos, max(len(ids) - 1, 0))], -1) if len(ids) else pos
    x = np.where(inside, ids[np.clip(pos - 1, 0, max(len(ids) - 1, 0))], -1) if len(ids) else pos
    x[k == 0, 0] = start
    return x, y
