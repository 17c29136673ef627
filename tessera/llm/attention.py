"""A small causal self-attention model of subword ids, in numpy.

One head attends from every place to the places before it in its window; what
it reads is added to the place's own embedding. The next id is predicted in
three factors: its group, its slot in the group, and, where rare ids share the
last slot, its share of what that slot was seen as. All three are distributions,
so the probabilities of all ids sum to one. Groups hold ids that stand between
like neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Places a window holds, of which the last ``STRIDE`` are scored.
WINDOW, STRIDE = 24, 12
GROUPS, SLOTS, WIDTH = 32, 32, 24
#: Neighbours that a profile tells apart, without the rest.
NEIGHBOURS = 32
#: Windows of the pool that steps draw from.
POOL = 2048
#: Counts of an unseen id.
UNSEEN = 0.01

f32 = np.float32


@dataclass
class Units:
    """Which group and slot an id has, and the log share it has of its slot."""

    group: np.ndarray
    slot: np.ndarray
    share: np.ndarray

    @property
    def unit(self) -> np.ndarray:
        return self.group.astype(np.int64) * SLOTS + self.slot


def units_of(counts: np.ndarray, profiles: np.ndarray) -> Units:
    """Groups ids by profile (counts of neighbours, a row an id): centres first
    move to their nearest ids, then frequent ids take their nearest centre with
    a free slot. Ties go to the smaller id or centre, so equal counts give equal units."""
    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    smooth = profiles + 0.05
    points = np.sqrt(smooth / smooth.sum(1, keepdims=True))
    some = order[: max(GROUPS, GROUPS * (SLOTS - 1))]
    spread = some[np.linspace(0, max(0, min(len(some), 4 * GROUPS) - 1), GROUPS).astype(np.int64)]
    centres = points[spread].copy()
    weight = np.sqrt(counts[some] + UNSEEN)
    for _ in range(8):
        near = np.argmax(points[some] @ centres.T, 1)
        for g in range(GROUPS):
            own = near == g
            if own.any():
                c = (points[some[own]] * weight[own, None]).sum(0)
                centres[g] = c / np.linalg.norm(c)
    group, slot = np.zeros(n, np.int32), np.full(n, SLOTS - 1, np.int32)
    like = np.argsort(-(points @ centres.T), axis=1, kind="stable")
    free = np.zeros(GROUPS, np.int64)
    for rank, i in enumerate(order.tolist()):
        own = like[i]
        if rank < GROUPS * (SLOTS - 1):
            g = int(own[np.argmax(free[own] < SLOTS - 1)])
            slot[i], free[g] = free[g], free[g] + 1
        else:
            g = int(own[0])
        group[i] = g
    seen = counts + UNSEEN
    unit = group.astype(np.int64) * SLOTS + slot
    return Units(group, slot, np.log(seen / np.bincount(unit, seen, GROUPS * SLOTS)[unit]))


class Model:
    """Parameters as one vector, with views by name."""

    shapes = {"E": (GROUPS * SLOTS, WIDTH), "P": (WINDOW, WIDTH), "W": (WIDTH, 3 * WIDTH), "O": (WIDTH, WIDTH), "U": (WIDTH, GROUPS), "b": (GROUPS,), "V": (GROUPS, WIDTH, SLOTS), "c": (GROUPS, SLOTS)}

    def __init__(self, vector: np.ndarray) -> None:
        self.vector, at = vector, 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            setattr(self, name, vector[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes.values())

    @classmethod
    def start(cls, counts: np.ndarray, units: Units, seed: int = 7) -> Model:
        """Small random weights; biases are the log shares of groups and slots."""
        rng = np.random.default_rng(seed)
        m = cls(np.zeros(cls.size(), f32))
        for name, scale in (("E", 0.3), ("P", 0.1), ("W", WIDTH**-0.5), ("O", 0.3 * WIDTH**-0.5), ("U", 0.1), ("V", 0.1)):
            getattr(m, name)[...] = rng.normal(0, scale, cls.shapes[name])
        by = (np.bincount(units.unit, counts, GROUPS * SLOTS) + UNSEEN).reshape(GROUPS, SLOTS)
        m.b[...] = np.log(by.sum(1) / by.sum())
        m.c[...] = np.log(by / by.sum(1, keepdims=True))
        return m


_CAUSAL = np.triu(np.full((WINDOW, WINDOW), -1e9, f32), 1)
_SCALE = f32(WIDTH**-0.5)
_COLUMNS = np.arange(WIDTH)


def _exp(x: np.ndarray) -> np.ndarray:
    """e to the power of ``x``, in place, and the rows' sums; rows are first
    lowered by their largest value only where one could pass what 32 bits hold."""
    if x.size and x.max() > 60:
        x -= x.max(-1, keepdims=True)
    np.exp(x, out=x)
    return x @ np.ones(x.shape[-1], f32)  # a product is the fastest sum of short rows


def _softmax(x: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Rows that sum to ``scale``."""
    total = _exp(x)
    x *= (f32(scale) / total)[..., None]
    return x


def _by_group(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their groups, and where each group starts."""
    order = np.argsort(group.astype(np.uint8), kind="stable")  # bytes are sorted by counting
    return order, np.searchsorted(group[order], np.arange(GROUPS + 1))


def _with_ones(F: np.ndarray) -> np.ndarray:
    """A column of ones more, so that one product takes weights and biases, or gives the gradient of both."""
    out = np.empty((len(F), WIDTH + 1), f32)
    out[:, :WIDTH], out[:, WIDTH] = F, 1
    return out


def _with_biases(m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights of groups and of slots with the biases as their last rows."""
    return np.concatenate([m.U, m.b[None]]), np.concatenate([m.V, m.c[:, None]], 1)


def logs(m: Model, x: np.ndarray, y: np.ndarray, units: Units, blank: np.ndarray | None = None) -> np.ndarray:
    """Log probability (natural, float64) of the ids ``y`` (n, STRIDE) at the last
    places of windows of unit numbers ``x`` (n, WINDOW). The first ``blank`` places
    of a window are before the text's start and are not attended to."""
    n = len(x)
    own = WINDOW - STRIDE
    X = m.E[x] + m.P
    kv = (X.reshape(-1, WIDTH) @ m.W[:, WIDTH:]).reshape(n, WINDOW, 2 * WIDTH)
    last = X[:, own:]
    q = (last.reshape(-1, WIDTH) @ (m.W[:, :WIDTH] * _SCALE)).reshape(n, STRIDE, WIDTH)
    S = q @ kv[..., :WIDTH].transpose(0, 2, 1)
    S += _CAUSAL[own:]
    if blank is not None and blank.any():
        some = np.flatnonzero(blank)
        S[some] += np.where(np.arange(WINDOW) < blank[some, None], f32(-1e9), f32(0))[:, None, :]
    Z = _softmax(S) @ kv[..., WIDTH:]
    F = last.reshape(-1, WIDTH) + Z.reshape(-1, WIDTH) @ m.O
    return _logs(m, F, y.ravel(), units).reshape(y.shape)


def _logs(m: Model, F: np.ndarray, ids: np.ndarray, units: Units) -> np.ndarray:
    group, slot = units.group[ids], units.slot[ids]
    out = units.share[ids]
    (U, V), F = _with_biases(m), _with_ones(F)
    a = F @ U
    total = _exp(a)
    out += np.log(a[np.arange(len(ids)), group] / total)
    order, starts = _by_group(group)
    F, a, starts = F[order], np.empty((len(ids), SLOTS), f32), starts.tolist()
    for g, (i, j) in enumerate(zip(starts, starts[1:], strict=False)):
        np.matmul(F[i:j], V[g], out=a[i:j])
    total = _exp(a)
    out[order] += np.log(a[np.arange(len(ids)), slot[order]] / total)
    return out


def gradient(m: Model, g: Model, x: np.ndarray, group: np.ndarray, slot: np.ndarray) -> None:
    """Fills ``g`` with the gradient of the mean negative log probability of
    (group, slot) at all places of windows of unit numbers ``x``."""
    n, rows = x.shape[0], x.size
    group, slot = group.ravel(), slot.ravel()
    X = (m.E[x] + m.P).reshape(-1, WIDTH)
    qkv = (X @ m.W).reshape(n, WINDOW, 3 * WIDTH)
    q, k, v = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
    S = q @ k.transpose(0, 2, 1)
    S *= _SCALE
    S += _CAUSAL
    _softmax(S)
    Z = (S @ v).reshape(-1, WIDTH)
    (U, V), F = _with_biases(m), _with_ones(X + Z @ m.O)
    # groups
    a = F @ U
    _softmax(a, 1 / rows)
    a[np.arange(rows), group] -= f32(1 / rows)
    both = F.T @ a
    g.U[...], g.b[...] = both[:WIDTH], both[WIDTH]
    dF = a @ m.U.T
    # slots
    order, starts = _by_group(group)
    Fo, a, dFo, both, turned = F[order], np.empty((rows, SLOTS), f32), np.empty_like(X), np.empty_like(V), m.V.transpose(0, 2, 1)
    starts = starts.tolist()
    parts = [slice(lo, hi) for lo, hi in zip(starts, starts[1:], strict=False)]
    for i, part in enumerate(parts):
        np.matmul(Fo[part], V[i], out=a[part])
    _softmax(a, 1 / rows)
    a[np.arange(rows), slot[order]] -= f32(1 / rows)
    for i, part in enumerate(parts):
        own = a[part]
        np.matmul(Fo[part].T, own, out=both[i])
        np.matmul(own, turned[i], out=dFo[part])
    g.V[...], g.c[...] = both[:, :WIDTH], both[:, WIDTH]
    dF[order] += dFo
    # attention
    g.O[...] = Z.T @ dF
    dZ = (dF @ m.O.T).reshape(n, WINDOW, WIDTH)
    dqkv = np.empty_like(qkv)
    dqkv[..., 2 * WIDTH :] = S.transpose(0, 2, 1) @ dZ
    dS = dZ @ v.transpose(0, 2, 1)
    dS -= np.einsum("nij,nij->ni", dS, S)[..., None]
    dS *= S
    dS *= _SCALE
    dqkv[..., :WIDTH] = dS @ k
    dqkv[..., WIDTH : 2 * WIDTH] = dS.transpose(0, 2, 1) @ q
    dqkv = dqkv.reshape(-1, 3 * WIDTH)
    g.W[...] = X.T @ dqkv
    dF += dqkv @ m.W.T
    g.P[...] = dF.reshape(n, WINDOW, WIDTH).sum(0)
    cells = (x.reshape(-1, 1) * WIDTH + _COLUMNS).ravel()
    g.E[...] = np.bincount(cells, dF.ravel(), g.E.size).reshape(g.E.shape)


class Trainer:
    """Adam over windows as they come, ``batch`` a step, from given parameters.
    The rate rises over the first ``warm`` steps, until the moments mean something."""

    def __init__(self, vector: np.ndarray, units: Units, rate: float, batch: int, warm: int, seed: int) -> None:
        self.model, self.units, self.rate, self.batch, self.warm = Model(vector.copy()), units, rate, batch, warm
        self.grad = Model(np.zeros_like(vector))
        self.m, self.v, self.t = np.zeros_like(vector), np.zeros_like(vector), 0
        self.rng, self.held, self.n_held, self.tokens = np.random.default_rng(seed), [], 0, 0

    def step(self, x: np.ndarray, y: np.ndarray) -> None:
        gradient(self.model, self.grad, x, self.units.group[y], self.units.slot[y])
        g, self.t = self.grad.vector, self.t + 1
        self.m += f32(0.1) * (g - self.m)
        np.multiply(g, g, out=g)
        self.v += f32(0.005) * (g - self.v)
        rate = self.rate * min(1.0, self.t / self.warm) / (1 - 0.9**self.t)
        np.sqrt(self.v / f32(1 - 0.995**self.t), out=g)
        g += f32(1e-8)
        np.divide(self.m, g, out=g)
        g *= f32(rate)
        self.model.vector -= g
        self.tokens += y.size

    def _pool(self, least: int) -> None:
        """Steps over the windows held, in random order; what is over stays for the next."""
        ids = np.concatenate(self.held)
        n = (len(ids) - 1) // WINDOW
        if n >= least:
            x = self.units.unit[ids[: n * WINDOW]].reshape(n, WINDOW)
            y = ids[1 : n * WINDOW + 1].reshape(n, WINDOW)
            order = self.rng.permutation(n)
            for i in range(0, n, self.batch):
                own = order[i : i + self.batch]
                self.step(x[own], y[own])
            ids = ids[n * WINDOW :]
        self.held, self.n_held = [ids], len(ids)

    def add(self, ids: np.ndarray, end: int) -> None:
        """A text's ids, the end among them. A longer text than the pool is taken in parts."""
        if not self.held:
            self.held, self.n_held = [np.array([end])], 1
        for i in range(0, len(ids), POOL * WINDOW):
            part = ids[i : i + POOL * WINDOW]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held > POOL * WINDOW:
                self._pool(POOL // 2)

    def done(self) -> np.ndarray:
        """The parameters after all windows; fewer ids than a window are not learned from."""
        if self.held:
            self._pool(1)
        return self.model.vector


def scored(m: Model, units: Units, texts: list[np.ndarray], end: int) -> np.ndarray:
    """Log probability of each text's ids (each ends with ``end``). A window is
    ``WINDOW`` ids, of which it scores the last ``STRIDE`` by those before."""
    out = np.zeros(len(texts))
    lengths = np.array([len(t) for t in texts], np.int64)
    n_win = -(-lengths // STRIDE)
    pad, back = WINDOW - STRIDE, STRIDE
    # one line of all texts, each after ``pad`` blanks and its start, filled up to whole strides
    starts = np.cumsum(n_win * back + pad) - (n_win * back + pad)
    line = np.full(int((n_win * back + pad).sum()) + 1, end, np.int64)
    for s, t in zip(starts.tolist(), texts, strict=True):
        line[s + pad + 1 : s + pad + 1 + len(t)] = t
    of = np.repeat(np.arange(len(texts)), n_win)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    begin = starts[of] + nth * back
    unit = units.unit
    for i in range(0, len(of), 512):
        b, text = begin[i : i + 512], of[i : i + 512]
        x = unit[line[b[:, None] + np.arange(WINDOW)]]
        y = line[b[:, None] + np.arange(pad + 1, WINDOW + 1)]
        blank = np.where(nth[i : i + 512] == 0, pad, 0)
        got = logs(m, x, y, units, blank)
        over = nth[i : i + 512, None] * back + np.arange(back) >= lengths[text][:, None]
        got[over] = 0
        np.add.at(out, text, got.sum(1))
    return out
