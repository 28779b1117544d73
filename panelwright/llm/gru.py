"""A gated recurrent language model with a class-factored softmax, in numpy.

A token is predicted in two steps: its class from the hidden state, then the
token within its class.  Frequent words have classes of their own size and a
softmax over the members; the rest falls into frequency bins within which the
training counts decide.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN, EMBED = 16, 16
LANES, STEPS = 512, 24


@dataclass(frozen=True)
class Shape:
    """``head`` frequent words in classes of ``width``; ``bins`` further classes."""

    head: int
    width: int
    bins: int

    @property
    def head_classes(self) -> int:
        return -(-self.head // self.width)

    @property
    def classes(self) -> int:
        return self.head_classes + self.bins

    @property
    def inputs(self) -> int:
        """Input symbols: head words, bins, and the start of a document."""
        return self.head + self.bins + 1

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.head, symbol // self.width, self.head_classes + symbol - self.head)


def initial(shape: Shape, symbol_counts: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters at which the model equals the unigram model: biases are log shares, output weights zero."""
    rng = np.random.default_rng(seed)
    share = symbol_counts[: shape.head + shape.bins].astype(np.float64) + 1e-3
    by_class = np.bincount(shape.class_of(np.arange(len(share))), weights=share, minlength=shape.classes)
    head = np.log(share[: shape.head] / by_class[shape.class_of(np.arange(shape.head))])
    p = {
        "emb": rng.normal(0, 0.3, (shape.inputs, EMBED)),
        "wx": rng.normal(0, EMBED**-0.5, (EMBED, 3 * HIDDEN)),
        "wh": rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)),
        "b": np.zeros(3 * HIDDEN),
        "wc": np.zeros((HIDDEN, shape.classes)),
        "bc": np.log(by_class / by_class.sum()),
        "wo": np.zeros((shape.head, HIDDEN)),
        "bo": head,
    }
    p["b"][:HIDDEN] = 1.0
    return {k: v.astype(np.float32) for k, v in p.items()}


def pack(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


@dataclass
class State:
    """Parameters with the optimiser's averages of gradients and squares, and its steps."""

    params: dict[str, np.ndarray]
    m: dict[str, np.ndarray]
    v: dict[str, np.ndarray]
    steps: int

    @classmethod
    def begin(cls, params: dict[str, np.ndarray]) -> State:
        zero = {k: np.zeros_like(x) for k, x in params.items()}
        return cls(params, zero, zero, 0)

    def flat(self) -> np.ndarray:
        return np.concatenate([pack(x) for x in (self.params, self.m, self.v)])

    @classmethod
    def from_flat(cls, flat: np.ndarray, steps: int, like: dict[str, np.ndarray]) -> State:
        return cls(*(unpack(x, like) for x in np.split(flat, 3)), steps)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _step(h: np.ndarray, x: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    a = h @ wh
    gates = _sigmoid(x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
    own = a[:, 2 * HIDDEN :]
    new = np.tanh(x[:, 2 * HIDDEN :] + gates[:, HIDDEN:] * own)
    return new + gates[:, :HIDDEN] * (h - new), gates, own, new


def _by_class(shape: Shape, y: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(first word, last word + 1, places) for each head class among the targets."""
    at = np.flatnonzero(y < shape.head)
    c = y[at] // shape.width
    order = np.argsort(c, kind="stable")
    at, c = at[order], c[order]
    cut = np.searchsorted(c, np.arange(shape.head_classes + 1))
    return [(k * shape.width, min(shape.head, (k + 1) * shape.width), at[cut[k] : cut[k + 1]]) for k in range(shape.head_classes) if cut[k + 1] > cut[k]]


def token_log_probs(p: dict[str, np.ndarray], shape: Shape, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log of P(class) and, for head words, P(word | class)."""
    out = _log_softmax(h @ p["wc"] + p["bc"])[np.arange(len(y)), shape.class_of(y)]
    for a, b, at in _by_class(shape, y):
        out[at] += _log_softmax(h[at] @ p["wo"][a:b].T + p["bo"][a:b])[np.arange(len(at)), y[at] - a]
    return out


def _loss_gradient(p: dict[str, np.ndarray], shape: Shape, h: np.ndarray, y: np.ndarray, g: dict[str, np.ndarray]) -> np.ndarray:
    n = np.float32(len(y))
    d = np.exp(_log_softmax(h @ p["wc"] + p["bc"]))
    d[np.arange(len(y)), shape.class_of(y)] -= 1
    d /= n
    g["wc"], g["bc"] = h.T @ d, d.sum(axis=0)
    dh = d @ p["wc"].T
    for a, b, at in _by_class(shape, y):
        own = h[at]
        d = np.exp(_log_softmax(own @ p["wo"][a:b].T + p["bo"][a:b]))
        d[np.arange(len(at)), y[at] - a] -= 1
        d /= n
        g["wo"][a:b], g["bo"][a:b] = d.T @ own, d.sum(axis=0)
        dh[at] += d @ p["wo"][a:b]
    return dh


class Trainer:
    """Truncated backpropagation through time with Adam; the state is carried from window to window."""

    def __init__(self, p: dict[str, np.ndarray], shape: Shape, rate: float = 0.004, state: State | None = None):
        state = state or State.begin(p)
        self.shape, self.rate = shape, rate
        self.p, self.m, self.v = ({k: x.copy() for k, x in part.items()} for part in (p, state.m, state.v))
        self.t, self.tokens = state.steps, 0

    def state(self) -> State:
        return State(self.p, self.m, self.v, self.t)

    def learn(self, symbols: np.ndarray, firsts: np.ndarray) -> None:
        """One pass over a stream of documents; ``firsts`` flags the first token of each."""
        # Short streams take fewer lanes, so that there are some dozens of updates.
        lanes = max(1, min(LANES, len(symbols) // (64 * STEPS)))
        length = -(-len(symbols) // lanes)
        if not length:
            return
        # The last lane is padded; padded places have no loss.
        pad = lanes * length - len(symbols)
        start = self.shape.inputs - 1
        before = np.concatenate([[start], symbols[:-1]])
        before = np.where(firsts, start, before)
        y, x, fresh, real = (np.pad(v, (0, pad)).reshape(lanes, length).T for v in (symbols, before, firsts, np.ones(len(symbols), dtype=bool)))
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in range(0, length, STEPS):
            h = self._window(h, x[t : t + STEPS], y[t : t + STEPS], fresh[t : t + STEPS], real[t : t + STEPS])
        self.tokens += len(symbols)

    def _window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, real: np.ndarray | None = None) -> np.ndarray:
        p, steps, lanes = self.p, len(x), x.shape[1]
        real = np.ones(y.shape, dtype=bool) if real is None else real
        embedded = p["emb"][x.ravel()]
        drive = (embedded @ p["wx"] + p["b"]).reshape(steps, lanes, 3 * HIDDEN)
        keep = (~fresh).astype(np.float32)[:, :, None]
        states, cache = np.empty((steps, lanes, HIDDEN), dtype=np.float32), []
        for t in range(steps):
            h = h * keep[t]
            previous = h
            h, gates, own, new = _step(h, drive[t], p["wh"])
            states[t] = h
            cache.append((previous, gates, own, new))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dh_out = np.zeros((steps, lanes, HIDDEN), dtype=np.float32)
        dh_out[real] = _loss_gradient(p, self.shape, states[real], y[real], g)
        ddrive = np.empty_like(drive)
        dh = np.zeros((lanes, HIDDEN), dtype=np.float32)
        da = np.empty((lanes, 3 * HIDDEN), dtype=np.float32)
        for t in range(steps - 1, -1, -1):
            previous, gates, own, new = cache[t]
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            dh = dh + dh_out[t]
            dnew = dh * (1 - z) * (1 - new * new)
            ddrive[t, :, 2 * HIDDEN :] = dnew
            da[:, :HIDDEN] = dh * (previous - new) * z * (1 - z)
            da[:, HIDDEN : 2 * HIDDEN] = dnew * own * r * (1 - r)
            da[:, 2 * HIDDEN :] = dnew * r
            ddrive[t, :, : 2 * HIDDEN] = da[:, : 2 * HIDDEN]
            g["wh"] += previous.T @ da
            dh = (dh * z + da @ p["wh"].T) * keep[t]
        flat = ddrive.reshape(-1, 3 * HIDDEN)
        g["b"], g["wx"] = flat.sum(axis=0), embedded.T @ flat
        order = np.argsort(x.ravel(), kind="stable")
        ids = x.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        g["emb"][ids[first]] = np.add.reduceat((flat @ p["wx"].T)[order], first, axis=0)
        self._adam(g)
        return h

    def _adam(self, g: dict[str, np.ndarray]) -> None:
        norm = float(np.sqrt(sum(float((v * v).sum()) for v in g.values())))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-12)))
        self.t += 1
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for k, v in g.items():
            v *= scale
            self.m[k] += np.float32(0.1) * (v - self.m[k])
            self.v[k] += np.float32(0.001) * (v * v - self.v[k])
            self.p[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))


def score_documents(p: dict[str, np.ndarray], shape: Shape, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Natural log probability of each document's symbols, every token read with the state of all before it.

    Whole documents are dealt to lanes, longest first to the shortest lane; the
    state is carried from window to window and cleared where a document starts.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    total = np.zeros(len(symbols), dtype=np.float64)
    lanes = max(1, min(LANES, n))
    load, held = np.zeros(lanes, dtype=np.int64), [[] for _ in range(lanes)]
    order = np.argsort(-sizes, kind="stable")
    # Rounds of one document per lane, the longest to the least loaded.
    for a in range(0, n, lanes):
        group = order[a : a + lanes]
        for lane, doc in zip(np.argsort(load, kind="stable")[: len(group)], group, strict=True):
            held[lane].append(doc)
            load[lane] += sizes[doc]
    by_load = np.argsort(-load, kind="stable")
    load, held = load[by_load], [held[k] for k in by_load]
    place = np.zeros((int(load[0]) if n else 0, lanes), dtype=np.int64)
    fresh = np.zeros(place.shape, dtype=bool)
    for k, docs in enumerate(held):
        at = 0
        for doc in docs:
            place[at : at + sizes[doc], k] = np.arange(offsets[doc], offsets[doc + 1])
            if sizes[doc]:
                fresh[at, k] = True
            at += sizes[doc]
    start = shape.inputs - 1
    before = np.concatenate([[start], symbols[:-1]]) if len(symbols) else symbols
    drive = p["emb"] @ p["wx"] + p["b"]
    h = np.zeros((lanes, HIDDEN), dtype=np.float32)
    steps = 4 * STEPS
    for t in range(0, len(place), steps):
        active = int(np.searchsorted(-load, -t, side="left"))
        where, new = place[t : t + steps, :active], fresh[t : t + steps, :active]
        x = np.where(new, start, before[where])
        states = np.empty((*where.shape, HIDDEN), dtype=np.float32)
        h = h[:active]
        for k in range(len(where)):
            if new[k].any():
                h = h * (~new[k])[:, None].astype(np.float32)
            h = _step(h, drive[x[k]], p["wh"])[0]
            states[k] = h
        real = (np.arange(t, t + len(where))[:, None] < load[:active]).ravel()
        at = where.ravel()[real]
        total[at] = token_log_probs(p, shape, states.reshape(-1, HIDDEN)[real], symbols[at])
    summed = np.concatenate([[0.0], np.cumsum(total)])
    return summed[offsets[1:]] - summed[offsets[:-1]]
