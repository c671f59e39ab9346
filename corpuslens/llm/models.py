"""Small models trained on the driver from bounded samples: logistic regression, boosted trees, isotonic curves."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_sparse_logistic(ptr, idx, val, y, weight, dims, l2=1e-5, steps=120, rate=0.3):
    """Logistic weights and bias for rows in CSR form, by AdaGrad over full passes."""
    w, b = np.zeros(dims, np.float64), 0.0
    gw, gb = np.full(dims, 1e-8), 1e-8
    row = np.repeat(np.arange(len(y)), np.diff(ptr))
    weight = weight / weight.sum()
    for _ in range(steps):
        z = np.bincount(row, w[idx] * val, minlength=len(y)) + b
        r = (sigmoid(z) - y) * weight
        g = np.bincount(idx, r[row] * val, minlength=dims) + l2 * w
        gw += g * g
        w -= rate * g / np.sqrt(gw)
        gb += r.sum() ** 2
        b -= rate * r.sum() / np.sqrt(gb)
    return w, b


def fit_platt(z, y, weight, steps=60):
    """Slope and offset so that sigmoid(a * z + b) is a probability; Newton steps with a small ridge."""
    a, b = 1.0, 0.0
    weight = weight / weight.sum() * len(y)
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = x.T @ ((p - y) * weight) + 1e-2 * np.array([a - 1, b])
        h = (x * (p * (1 - p) * weight)[:, None]).T @ x + 1e-2 * np.eye(2)
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
    return max(float(a), 1e-3), float(b)


@dataclass
class Isotonic:
    """A non-decreasing step curve, interpolated between the centres of its steps."""

    x: np.ndarray = field(default_factory=lambda: np.zeros(1))
    y: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def __call__(self, z):
        return np.interp(z, self.x, self.y)


def fit_isotonic(z, y, weight) -> Isotonic:
    """Pool adjacent violators; each pool's rate is drawn a little towards the overall rate."""
    order = np.argsort(z, kind="stable")
    base = float((y * weight).sum() / weight.sum())
    pools: list[list[float]] = []
    for zz, yy, ww in zip(z[order], y[order], weight[order], strict=True):
        if pools and pools[-1][3] == zz:
            pools[-1][0] += yy * ww
            pools[-1][1] += ww
            pools[-1][2] += zz * ww
        else:
            pools.append([yy * ww, ww, zz * ww, zz])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a, b, c, top = pools.pop()
            pools[-1] = [pools[-1][0] + a, pools[-1][1] + b, pools[-1][2] + c, top]
    x = np.array([p[2] / p[1] for p in pools])
    v = np.array([(p[0] + 0.5 * base) / (p[1] + 0.5) for p in pools])
    return Isotonic(x, np.maximum.accumulate(v))


@dataclass
class Tree:
    """Complete binary tree in arrays; a split goes left where x <= cut; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def __call__(self, x):
        at = np.zeros(len(x), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            inner = f >= 0
            go = x[np.arange(len(x)), np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + 1 + go, at)
        return self.value[at]


def _grow(x, bins, cuts, g, h, depth, min_weight, lam):
    size = 2 ** (depth + 1) - 1
    feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
    rows = {0: np.arange(len(g))}
    for node in range(size):
        r = rows.pop(node, None)
        if r is None or not len(r):
            continue
        gs, hs = g[r].sum(), h[r].sum()
        value[node] = -gs / (hs + lam)
        if node >= 2**depth - 1:
            continue
        best = (1e-6, -1, 0)
        for f in range(x.shape[1]):
            k = len(cuts[f])
            if not k:
                continue
            b = bins[r, f]
            gl, hl = np.bincount(b, g[r], k + 1).cumsum()[:-1], np.bincount(b, h[r], k + 1).cumsum()[:-1]
            gain = gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam)
            gain[(hl < min_weight) | (hs - hl < min_weight)] = -1
            c = int(np.argmax(gain))
            if gain[c] > best[0]:
                best = (gain[c], f, c)
        if best[1] < 0:
            continue
        _, f, c = best
        feature[node], cut[node] = f, cuts[f][c]
        left = bins[r, f] <= c
        rows[2 * node + 1], rows[2 * node + 2] = r[left], r[~left]
    return Tree(feature, cut, value)


def fit_boosted(x, y, weight, trees=60, depth=3, rate=0.2, lam=1.0, n_bins=48):
    """Gradient-boosted trees for the logistic loss over histogram bins: (base score, list of trees)."""
    weight = weight / weight.mean()
    cuts = []
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        mid = (v[1:] + v[:-1]) / 2
        if len(mid) > n_bins:
            mid = np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 2)[1:-1]))
            zero = v[v > 0][:1] / 2  # the border between none and any
            mid = np.unique(np.concatenate([mid, zero]))
        cuts.append(mid)
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], 1)
    p = float((y * weight).sum() / weight.sum())
    base = float(np.log((p + 1e-4) / (1 - p + 1e-4)))
    score, out = np.full(len(y), base), []
    for _ in range(trees):
        q = sigmoid(score)
        t = _grow(x, bins, cuts, (q - y) * weight, np.maximum(q * (1 - q), 1e-6) * weight, depth, 1e-2, lam)
        t.value *= rate
        out.append(t)
        score = score + t(x)
    return base, out


def boosted_score(model, x):
    base, trees = model
    z = np.full(len(x), base)
    for t in trees:
        z += t(x)
    return z


def fit_lasso_logistic(x, y, weight, l1, steps=800):
    """Sparse logistic weights and bias by accelerated proximal gradient steps."""
    weight = weight / weight.sum()
    n, d = x.shape
    xb = np.concatenate([x, np.ones((n, 1))], 1)
    step = 1 / (0.25 * np.linalg.norm(xb * np.sqrt(weight)[:, None], 2) ** 2 + 1e-9)
    w, v, t = np.zeros(d + 1), np.zeros(d + 1), 1.0
    for _ in range(steps):
        g = xb.T @ ((sigmoid(xb @ v) - y) * weight)
        u = v - step * g
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = u + (t - 1) / t2 * (u - w)
        w, t = u, t2
    return w[:-1], float(w[-1])
