"""A bidirectional gated recurrent network with attention pooling, forward and backward in numpy."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(inputs: int, hidden: int, seed: int) -> Params:
    rng = np.random.Generator(np.random.PCG64(seed))

    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {}
    for d in ("f", "b"):
        p["W" + d], p["U" + d], p["c" + d] = draw(inputs, 3 * hidden), draw(hidden, 3 * hidden), np.zeros(3 * hidden, np.float32)
    p["A"], p["v"], p["u"], p["o"] = draw(2 * hidden, hidden), draw(hidden), draw(2 * hidden), np.zeros(1, np.float32)
    return p


def _run(pre: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """States of one direction; pre: (time, batch, 3 hidden), mask: (time, batch, 1)."""
    steps, batch, three = pre.shape
    n = three // 3
    h = np.zeros((batch, n), np.float32)
    out = np.empty((steps, batch, n), np.float32)
    for t in range(steps):
        a = h @ u
        zr = sigmoid(pre[t, :, : 2 * n] + a[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        new = np.tanh(pre[t, :, 2 * n :] + r * a[:, 2 * n :])
        if keep is not None:
            keep.append((h, a, z, r, new))
        h = h + mask[t] * (1 - z) * (new - h)
        out[t] = h
    return out


def _run_back(dout: np.ndarray, u: np.ndarray, mask: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
    steps, batch, n = dout.shape
    dpre, du, dh = np.empty((steps, batch, 3 * n), np.float32), np.zeros_like(u), np.zeros((batch, n), np.float32)
    for t in range(steps - 1, -1, -1):
        h, a, z, r, new = keep[t]
        g = dout[t] + dh
        gm = g * mask[t]
        dnew = gm * (1 - z) * (1 - new * new)
        dz = gm * (h - new) * z * (1 - z)
        dr = dnew * a[:, 2 * n :] * r * (1 - r)
        da = np.concatenate([dz, dr, dnew * r], axis=1)
        dpre[t] = np.concatenate([dz, dr, dnew], axis=1)
        du += h.T @ da
        dh = g - gm * (1 - z) + da @ u.T
    return dpre, du


def forward(p: Params, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows from their projected inputs, (time, batch, 3 hidden) for each direction."""
    m = mask[:, :, None].astype(np.float32)
    kf: list | None = [] if keep is not None else None
    kb: list | None = [] if keep is not None else None
    hf = _run(pre_f, p["Uf"], m, kf)
    hb = _run(pre_b[::-1], p["Ub"], m[::-1], kb)[::-1]
    h = np.concatenate([hf, hb], axis=2)
    q = np.tanh(h @ p["A"])
    e = np.where(mask, q @ p["v"], -1e9)
    e = np.exp(e - e.max(axis=0))
    alpha = e * mask / np.maximum((e * mask).sum(axis=0), 1e-9)
    c = np.einsum("tb,tbh->bh", alpha, h)
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, q=q, alpha=alpha, c=c, m=m)
    return c @ p["u"] + p["o"][0]


def backward(p: Params, dlogit: np.ndarray, keep: dict) -> tuple[Params, np.ndarray, np.ndarray]:
    """Gradients of the parameters after the inputs, and of both projected inputs."""
    n = p["Uf"].shape[0]
    h, q, alpha, c, m = (keep[k] for k in ("h", "q", "alpha", "c", "m"))
    g: Params = {"u": c.T @ dlogit, "o": dlogit.sum(keepdims=True)}
    dc = dlogit[:, None] * p["u"]
    dh = alpha[:, :, None] * dc
    dalpha = np.einsum("bh,tbh->tb", dc, h)
    de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["v"] = np.einsum("tb,tbk->k", de, q)
    dq = de[:, :, None] * p["v"] * (1 - q * q)
    g["A"] = np.einsum("tbh,tbk->hk", h, dq)
    dh = dh + dq @ p["A"].T
    dpf, g["Uf"] = _run_back(np.ascontiguousarray(dh[:, :, :n]), p["Uf"], m, keep["kf"])
    dpb, g["Ub"] = _run_back(np.ascontiguousarray(dh[::-1, :, n:]), p["Ub"], m[::-1], keep["kb"])
    return g, dpf, dpb[::-1]


class Adam:
    def __init__(self, params: Params, rate: float):
        self.p, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(x) for k, x in params.items()}
        self.s = {k: np.zeros_like(x) for k, x in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g.astype(np.float32) * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.999 * self.s[k] + 0.001 * g * g
            self.p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.999**self.t)) + 1e-8)
