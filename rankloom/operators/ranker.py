"""A trainable ranking model over the set of a day's names, in NumPy.

Each name's inputs go through a small network together with the mean of all names' hidden values, so a score depends on the
cross-section it stands in; the order of the names changes nothing but the order of the scores, and slots without a name are
not in the set at all.  Losses give their gradient by score, pairs are not formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Params = dict[str, np.ndarray]
Gradient = tuple[float, np.ndarray]


def ordinal(y: np.ndarray) -> np.ndarray:
    """1-based ranks, ties in the order given."""
    out = np.empty(len(y))
    out[np.argsort(y, kind="stable")] = np.arange(1, len(y) + 1)
    return out


def neg_pearson_rank(score: np.ndarray, label: np.ndarray) -> Gradient:
    """Minus the correlation of the score with the label's rank."""
    a, b = score - score.mean(), ordinal(label)
    b = b - b.mean()
    na, nb = np.sqrt(a @ a), np.sqrt(b @ b)
    bottom = na * nb + 1e-8
    c = a @ b / bottom
    slope = b / bottom - (c * nb / (bottom * na) * a if na > 0 else 0.0)
    return -c, -(slope - slope.mean())


def squared_error(score: np.ndarray, label: np.ndarray) -> Gradient:
    gap = score - label
    return float(gap @ gap) / len(gap), 2 * gap / len(gap)


def hybrid_hinge(score: np.ndarray, label: np.ndarray, margin: float = 0.1, decile: float = 0.1, lambda_mse: float = 1.0, target: str = "zscore") -> Gradient:
    """Mean hinge over the pairs of top and bottom labels plus lambda times the squared error, by counts in the sorted tails."""
    n = len(score)
    y = (label - label.mean()) / (label.std(ddof=1) + 1e-8) if target == "zscore" else label
    tail = max(1, int(n * decile))
    order = np.argsort(label, kind="stable")
    short, long = order[:tail], order[n - tail :]
    s, bar = score[short], score[long] - margin
    sorted_s = np.sort(s)
    total = np.concatenate([[0.0], np.cumsum(sorted_s[::-1])])
    above = tail - np.searchsorted(sorted_s, bar, side="right")  # shorts within the margin of each long
    below = np.searchsorted(np.sort(bar), s, side="left")  # longs within the margin of each short
    pairs = tail * tail
    loss, slope = float((total[above] - above * bar).sum()) / pairs, np.zeros(n)
    np.add.at(slope, long, -above / pairs)
    np.add.at(slope, short, below / pairs)
    mse, rest = squared_error(score, y)
    return loss + lambda_mse * mse, slope + lambda_mse * rest


LOSSES: dict[str, Callable[..., Gradient]] = {"neg_pearson_rank": neg_pearson_rank, "hybrid_hinge": hybrid_hinge, "squared_error": squared_error}


def start(inputs: int, hidden: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda a, b: rng.normal(0, np.sqrt(2 / a), (a, b))
    return {"w1": draw(inputs, hidden), "b1": np.zeros(hidden), "w2": draw(2 * hidden, hidden), "b2": np.zeros(hidden), "w3": rng.normal(0, np.sqrt(1 / hidden), hidden)}


def scores(p: Params, x: np.ndarray) -> np.ndarray:
    return _forward(p, x)[0]


def _forward(p: Params, x: np.ndarray):
    h = np.maximum(x @ p["w1"] + p["b1"], 0)
    both = np.concatenate([h, np.broadcast_to(h.mean(axis=0), h.shape)], axis=1)
    g = np.maximum(both @ p["w2"] + p["b2"], 0)
    return g @ p["w3"], h, both, g


def slopes(p: Params, x: np.ndarray, loss: Callable[[np.ndarray], Gradient]) -> tuple[float, Params]:
    """The loss of a day and its gradient by the parameters."""
    s, h, both, g = _forward(p, x)
    value, ds = loss(s)
    dg = ds[:, None] * p["w3"] * (g > 0)
    dboth = dg @ p["w2"].T
    k = h.shape[1]
    dh = (dboth[:, :k] + dboth[:, k:].sum(axis=0) / len(h)) * (h > 0)
    return value, {"w1": x.T @ dh, "b1": dh.sum(axis=0), "w2": both.T @ dg, "b2": dg.sum(axis=0), "w3": g.T @ ds}


Day = tuple[np.ndarray, np.ndarray]  # inputs of the names, their labels (NaN where there is none)


def descend(p: Params, days: list[Day], loss: Callable[..., Gradient], rate: float, decay: float, batch: int) -> tuple[Params, float]:
    """One pass over the days in the order given, in batches, by Adam with decoupled decay; the parameters after it and the mean loss on the way."""
    p = {k: v.copy() for k, v in p.items()}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    seen = 0.0
    for n, a in enumerate(range(0, len(days), batch), 1):
        part = days[a : a + batch]
        total = {k: np.zeros_like(v) for k, v in p.items()}
        for x, y in part:
            ok = np.isfinite(y)
            value, g = _labelled(p, x, y, ok, loss)
            seen += value
            for k in total:
                total[k] += g[k] / len(part)
        for k, g in total.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] -= rate * (first[k] / (1 - 0.9**n) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8) + decay * p[k])
    return p, seen / max(len(days), 1)


def _labelled(p: Params, x: np.ndarray, y: np.ndarray, ok: np.ndarray, loss: Callable[..., Gradient]) -> tuple[float, Params]:
    """All names are in the set; only labelled ones have a loss."""

    def of(s: np.ndarray) -> Gradient:
        value, part = loss(s[ok], y[ok])
        out = np.zeros(len(s))
        out[ok] = part
        return value, out

    return slopes(p, x, of)


def judged(p: Params, x: np.ndarray, y: np.ndarray, loss: Callable[..., Gradient]) -> tuple[float, float]:
    """(correlation of ordinal ranks, loss) of a day; NaN correlation without spread."""
    ok = np.isfinite(y)
    s = scores(p, x)[ok]
    a, b = ordinal(s), ordinal(y[ok])
    return (float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 else np.nan), loss(s, y[ok])[0]


def input_slopes(p: Params, x: np.ndarray) -> np.ndarray:
    """Gradient of the sum of a day's scores by the inputs of its names."""
    _, h, _, g = _forward(p, x)
    dboth = (p["w3"] * (g > 0)) @ p["w2"].T
    k = h.shape[1]
    return ((dboth[:, :k] + dboth[:, k:].sum(axis=0) / len(h)) * (h > 0)) @ p["w1"].T
