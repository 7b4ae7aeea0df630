"""The numeric kernel of one training shard or scoring batch (numpy, used inside tasks).

A model is a list of tensors: per hidden layer weights, bias, norm gain and norm shift; then the
weights and bias of the output. Without hidden layers it is a logistic regression.
"""

from __future__ import annotations

import numpy as np

_EPS = 1e-5
_BLOCK = 1024
#: Numbers of a layer of stacked models that are worked on at once.
_STACK = 1 << 15


def shapes(n_in: int, hidden: tuple[int, ...]) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = []
    for width in hidden:
        out += [(n_in, width), (width,), (width,), (width,)]
        n_in = width
    return [*out, (n_in, 1), (1,)]


def init(n_in: int, hidden: tuple[int, ...], seed: int) -> list[np.ndarray]:
    """Uniform Xavier weights, zero bias, unit gain, zero shift."""
    rng = np.random.default_rng(seed)
    tensors = []
    for i, shape in enumerate(shapes(n_in, hidden)):
        if len(shape) == 2:
            bound = np.sqrt(6.0 / sum(shape))
            tensors.append(rng.uniform(-bound, bound, shape))
        else:
            is_gain = i % 4 == 2 and i < 4 * len(hidden)
            tensors.append(np.ones(shape) if is_gain else np.zeros(shape))
    return tensors


def logits(params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """Logit of each row, in blocks that stay in the processor cache.

    Weights and biases are centred once instead of each row's sums, and a layer works in place.
    """
    centred = [
        (w - w.mean(axis=1, keepdims=True), b - b.mean(), gain, shift)
        for w, b, gain, shift in (params[i : i + 4] for i in range(0, len(params) - 2, 4))
    ]
    blocks = [_block_logits(centred, params[-2:], x[i : i + _BLOCK]) for i in range(0, max(len(x), 1), _BLOCK)]
    return np.concatenate(blocks)


def _block_logits(centred, last, x: np.ndarray) -> np.ndarray:
    for w, b, gain, shift in centred:
        x = x @ w
        x += b
        x *= (1.0 / np.sqrt(np.einsum("ij,ij->i", x, x) / x.shape[1] + _EPS))[:, None]
        x *= gain
        x += shift
        np.maximum(x, 0.0, out=x)
    return (x @ last[0] + last[1])[:, 0]


def mean_loss(z: np.ndarray, y: np.ndarray) -> float:
    """Mean binary cross-entropy with logits."""
    return float(np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))))


def gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    """Mean loss of a batch, the gradient of every tensor, and the logits."""
    saved = []
    for i in range(0, len(params) - 2, 4):
        w, b, gain, shift = params[i : i + 4]
        pre = x @ w + b
        centred = pre - pre.mean(axis=1, keepdims=True)
        inv = 1.0 / np.sqrt((centred**2).mean(axis=1, keepdims=True) + _EPS)
        normed = centred * inv
        out = normed * gain + shift
        saved.append((x, inv, normed, out))
        x = np.maximum(out, 0.0)
    z = (x @ params[-2] + params[-1])[:, 0]
    dz = ((1.0 / (1.0 + np.exp(-z)) - y) / len(y))[:, None]
    grads = [x.T @ dz, dz.sum(axis=0)]
    dx = dz @ params[-2].T
    for i in range(len(params) - 6, -1, -4):
        x, inv, normed, out = saved[i // 4]
        w, _, gain, _ = params[i : i + 4]
        dout = dx * (out > 0)
        dn = dout * gain
        dpre = inv * (
            dn - dn.mean(axis=1, keepdims=True) - normed * (dn * normed).mean(axis=1, keepdims=True)
        )
        grads = [x.T @ dpre, dpre.sum(axis=0), (dout * normed).sum(axis=0), dout.sum(axis=0), *grads]
        dx = dpre @ w.T
    return mean_loss(z, y), grads, z


def stacked_gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    """:func:`gradients` of several models at once: tensors, mean losses and gradients have a leading model axis.

    Models go through in groups that stay in the processor cache. Weights and biases are centred once, and so are
    their gradients, instead of each row's sums.
    """
    at_once = max(1, _STACK // max(1, len(y) * max(t.shape[-1] for t in params)))
    parts = [
        _stack_gradients([t[i : i + at_once] for t in params], x, y) for i in range(0, len(params[0]), at_once)
    ]
    losses, grads = zip(*parts)
    return np.concatenate(losses), [np.concatenate(g) for g in zip(*grads)]


def _stack_gradients(params: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    saved = []
    for i in range(0, len(params) - 2, 4):
        w, b, gain, shift = params[i : i + 4]
        w = w - w.mean(axis=2, keepdims=True)
        normed = x @ w
        normed += (b - b.mean(axis=1, keepdims=True))[:, None]
        inv = 1.0 / np.sqrt(np.einsum("mnh,mnh->mn", normed, normed) / w.shape[2] + _EPS)
        normed *= inv[..., None]
        out = normed * gain[:, None]
        out += shift[:, None]
        np.maximum(out, 0.0, out=out)
        saved.append((x, w, inv, normed, out))
        x = out
    z = (x @ params[-2])[..., 0] + params[-1]
    dz = (1.0 / (1.0 + np.exp(-z)) - y) / len(y)
    losses = np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))), axis=1)
    grads = [np.swapaxes(x, -1, -2) @ dz[..., None], dz.sum(axis=1)[:, None]]
    dx = dz[..., None] * params[-2][..., 0][:, None]
    for i in range(len(params) - 6, -1, -4):
        x, w, inv, normed, out = saved[i // 4]
        dx *= out > 0
        dgain, dshift = np.einsum("mnh,mnh->mh", dx, normed), dx.sum(axis=1)
        dx *= params[i + 2][:, None]
        dx -= normed * (np.einsum("mnh,mnh->mn", dx, normed) / w.shape[2])[..., None]
        dx *= inv[..., None]
        dw, db = np.swapaxes(x, -1, -2) @ dx, dx.sum(axis=1)
        grads = [dw - dw.mean(axis=2, keepdims=True), db - db.mean(axis=1, keepdims=True), dgain, dshift, *grads]
        dx = dx @ np.swapaxes(w, 1, 2)
    return losses, grads


class Optimizer:
    """``adamw`` (decoupled decay), ``adam`` (decay in the gradient) or ``sgd`` with momentum.

    Numbers may be arrays that broadcast against the tensors: one per model of a stack.
    """

    def __init__(self, kind: str, lr: float, momentum: float, weight_decay: float):
        if kind not in ("adamw", "adam", "sgd"):
            raise ValueError(f"unknown optimizer {kind!r}")
        self.kind, self.lr, self.momentum, self.decay = kind, lr, momentum, weight_decay
        self.step_no, self.m, self.v = 0, None, None

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> list[np.ndarray]:
        self.step_no += 1
        if self.kind != "adamw":
            grads = [g + self.decay * p for g, p in zip(grads, params)]
        if self.kind == "sgd":
            first = self.m is None
            self.m = grads if first else [self.momentum * m + g for m, g in zip(self.m, grads)]
            return [p - self.lr * m for p, m in zip(params, self.m)]
        if self.m is None:
            self.m = [np.zeros_like(g) for g in grads]
            self.v = [np.zeros_like(g) for g in grads]
        self.m = [0.9 * m + 0.1 * g for m, g in zip(self.m, grads)]
        self.v = [0.999 * v + 0.001 * g * g for v, g in zip(self.v, grads)]
        c1, c2 = 1 - 0.9**self.step_no, 1 - 0.999**self.step_no
        if self.kind == "adamw":
            params = [p * (1 - self.lr * self.decay) for p in params]
        return [
            p - self.lr * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            for p, m, v in zip(params, self.m, self.v)
        ]
