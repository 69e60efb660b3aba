"""A gated recurrent layer in numpy, run and trained (backpropagation through time) over batches of sequences.

Arrays are time-major. A step's input comes as a row of a table of projected inputs, so the same
symbol is projected once: gates = table[symbol] + h U with columns for update z, reset r and candidate c,
    z = s(gz + h Uz), r = s(gr + h Ur), c = tanh(gc + r (h Uc)), h' = c + z (h - c).
"""

from __future__ import annotations

import numpy as np

F4 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def run(table: np.ndarray, symbols: np.ndarray, u: np.ndarray, reverse: bool) -> np.ndarray:
    """States (T, B, H) after each step of symbols (T, B)."""
    steps, b = symbols.shape
    h = u.shape[0]
    # s(x) = (tanh(x / 2) + 1) / 2: columns are halved once rather than at every step; each gate has arrays of its own, so that all lie in a row
    tz, tr, tc = (np.ascontiguousarray(table[:, i * h : (i + 1) * h]) * F4(0.5 if i < 2 else 1) for i in range(3))
    uz, ur, uc = (np.ascontiguousarray(u[:, i * h : (i + 1) * h]) * F4(0.5) for i in range(3))
    out = np.empty((steps, b, h), F4)
    state = np.zeros((b, h), F4)
    z, r, c, d = (np.empty((b, h), F4) for _ in range(4))
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        s = symbols[t]
        np.take(tz, s, axis=0, out=z, mode="clip")
        np.dot(state, uz, out=d)
        z += d
        np.tanh(z, out=z)
        z += 1.0
        np.take(tr, s, axis=0, out=r, mode="clip")
        np.dot(state, ur, out=d)
        r += d
        np.tanh(r, out=r)
        r += 1.0
        np.dot(state, uc, out=d)
        d *= r
        np.take(tc, s, axis=0, out=c, mode="clip")
        c += d
        np.tanh(c, out=c)
        np.subtract(state, c, out=d)
        d *= z
        d *= 0.5
        np.add(c, d, out=out[t])
        state = out[t]
    return out


def run_kept(table: np.ndarray, symbols: np.ndarray, u: np.ndarray, reverse: bool) -> tuple[np.ndarray, tuple]:
    """The same, with what the way back needs."""
    steps, b = symbols.shape
    h = u.shape[0]
    out, zs, rs, cs, hus, before = (np.empty((steps, b, h), F4) for _ in range(6))
    state = np.zeros((b, h), F4)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        before[t] = state
        g = table[symbols[t]]
        hu = state @ u
        zr = sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
        zs[t], rs[t], hus[t] = zr[:, :h], zr[:, h:], hu[:, 2 * h :]
        cs[t] = np.tanh(g[:, 2 * h :] + rs[t] * hus[t])
        state = out[t] = cs[t] + zs[t] * (state - cs[t])
    return out, (zs, rs, cs, hus, before)


def back(d_out: np.ndarray, kept: tuple, symbols: np.ndarray, u: np.ndarray, n_symbols: int, reverse: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and of U from those of the states."""
    zs, rs, cs, hus, before = kept
    steps, b, h = d_out.shape
    dg = np.empty((steps, b, 3 * h), F4)
    du = np.zeros_like(u)
    carry = np.zeros((b, h), F4)
    for t in range(steps) if reverse else range(steps - 1, -1, -1):
        d = d_out[t] + carry
        z, r, c, hu, prev = zs[t], rs[t], cs[t], hus[t], before[t]
        dc = d * (1 - z) * (1 - c * c)
        dz = d * (prev - c) * z * (1 - z)
        dr = dc * hu * r * (1 - r)
        dg[t, :, :h], dg[t, :, h : 2 * h], dg[t, :, 2 * h :] = dz, dr, dc
        dhu = np.concatenate([dz, dr, dc * r], 1)
        du += prev.T @ dhu
        carry = d * z + dhu @ u.T
    return sum_rows(dg.reshape(steps * b, 3 * h), symbols.reshape(-1), n_symbols), du


def sum_rows(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that go to each of n places."""
    order = np.argsort(at, kind="stable")
    places, first = np.unique(at[order], return_index=True)
    out = np.zeros((n, rows.shape[1]), F4)
    out[places] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        size = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, clip / (size + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(F4)


def start(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else 1 / np.sqrt(shape[0]))).astype(F4)
