"""A bidirectional gated recurrent network over bytes in numpy: forward, backpropagation through time, training."""

from __future__ import annotations

import numpy as np


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|) in place: between -1 and 1 like a hyperbolic tangent, at a fifth of its cost. Its slope is (1 - |value|)^2."""
    bound = np.abs(x)
    bound += 1.0
    x /= bound
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    out = 1.0 - np.abs(y)
    out *= out
    return out


class ByteGru:
    """Labels every byte of a window. Both directions run side by side: axis 0 of the recurrent arrays is the direction.

    Input weights are a table by byte value, so a byte costs a lookup: gates of byte t are table[byte] + state @ inner, split into update, reset and
    candidate; state = update * state + (1 - update) * squash(candidate). Gates are squashed to 0 .. 1.
    """

    def __init__(self, classes: int, hidden: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        h = hidden
        self.classes, self.hidden = classes, h
        self.w = {
            "table": rng.normal(0, 0.3, (2, 256, 3 * h)),
            "inner": rng.normal(0, 0.8 / np.sqrt(h), (2, h, 3 * h)),
            "out": rng.normal(0, 0.3, (2 * h, classes)),
            "bias": np.zeros(classes),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}
        self.w["table"][:, :, :h] += 1.0  # remember at first

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (windows, bytes) uint8 -> (windows, bytes, 2 * hidden)."""
        h, (n, t) = self.hidden, x.shape
        both = np.stack([x.T, x.T[::-1]])  # (2, t, n)
        state = np.zeros((2, n, h), np.float32)
        out = np.empty((2, t, n, h), np.float32)
        table, inner = self.w["table"], self.w["inner"]
        for i in range(t):
            a = np.stack([table[0].take(both[0, i], 0), table[1].take(both[1, i], 0)])
            u = np.matmul(state, inner)
            gate = _squash(a[:, :, : 2 * h] + u[:, :, : 2 * h])
            gate += 1.0
            gate *= 0.5
            z, r = gate[:, :, :h], gate[:, :, h:]
            c = _squash(a[:, :, 2 * h :] + r * u[:, :, 2 * h :])
            if keep is not None:
                keep.append((state, z, r, c, u[:, :, 2 * h :]))
            state = c + z * (state - c)
            out[:, i] = state
        return np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        y = self.states(x) @ self.w["out"] + self.w["bias"]
        y -= y.max(2, keepdims=True)
        y -= np.log(np.exp(y).sum(2, keepdims=True))
        return y

    def gradients(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray, least: float = 0.0) -> tuple[float, dict]:
        """Mean loss over weighted bytes and its gradients. Windows that give their label a mean probability below ``least`` don't count."""
        h, (n, t) = self.hidden, x.shape
        steps: list = []
        s = self.states(x, steps)
        y = s @ self.w["out"] + self.w["bias"]
        y -= y.max(2, keepdims=True)
        p = np.exp(y)
        p /= p.sum(2, keepdims=True)
        of_label = np.log(p[np.arange(n), :, labels] + 1e-9)
        mean = np.exp((of_label * weight).sum(1) / np.maximum(1e-6, weight.sum(1)))
        weight = weight * (mean >= least)[:, None]
        total = max(1e-6, float(weight.sum()))
        d = p
        d[np.arange(n), :, labels] -= 1
        d *= (weight / total)[:, :, None]
        grad = {"out": s.reshape(-1, 2 * h).T @ d.reshape(-1, self.classes), "bias": d.sum((0, 1))}
        ds = (d @ self.w["out"].T).transpose(1, 0, 2)
        ds = np.stack([ds[:, :, :h], ds[::-1, :, h:]])  # (2, t, n, h), each in its own direction's order
        inner = self.w["inner"]
        grad["inner"] = np.zeros_like(inner)
        da = np.empty((2, t, n, 3 * h), np.float32)
        back = np.zeros((2, n, h), np.float32)
        for i in range(t - 1, -1, -1):
            state, z, r, c, uc = steps[i]
            g = ds[:, i] + back
            dc = g * (1 - z) * _slope(c)
            dz = g * (state - c) * 0.5 * _slope(2 * z - 1)
            dr = dc * uc * 0.5 * _slope(2 * r - 1)
            da[:, i] = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            grad["inner"] += np.matmul(state.transpose(0, 2, 1), du)
            back = g * z + np.matmul(du, inner.transpose(0, 2, 1))
        grad["table"] = np.zeros_like(self.w["table"])
        both = np.stack([x.T, x.T[::-1]]).reshape(2, -1)
        for k in range(2):
            order = np.argsort(both[k], kind="stable")
            values, first = np.unique(both[k][order], return_index=True)
            grad["table"][k, values] = np.add.reduceat(da[k].reshape(-1, 3 * h)[order], first, axis=0)
        return float(-(of_label * weight).sum() / total), grad

    def train(self, x: np.ndarray, labels: np.ndarray, window: int = 64, steps: int = 480, batch: int = 160, rate: float = 0.02, seed: int = 6) -> "ByteGru":
        """x: texts as rows of bytes between zeros, which carry no weight: the network learns how texts begin and end. Each step cuts windows anew at random places; Adam with a falling rate. In the second half windows whose label the network finds all but impossible are left out: their documents
        were labelled wrongly, or the window lies in a passage of another language."""
        rng = np.random.default_rng(seed)
        if x.shape[1] < window:
            x = np.pad(x, ((0, 0), (0, window - x.shape[1])))
        first = (x > 0).argmax(1)
        room = np.maximum(1, np.minimum((x > 0).sum(1) + 2 * first, x.shape[1]) - window + 1)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        classes = [np.flatnonzero(labels == c) for c in range(self.classes) if (labels == c).any()]
        for step in range(1, steps + 1):
            # As many windows of each class.
            pick = np.concatenate([rng.choice(c, max(1, batch // len(classes))) for c in classes])
            cut = x[pick[:, None], (rng.random(len(pick)) * room[pick]).astype(np.int64)[:, None] + np.arange(window)]
            weight = (cut > 0).astype(np.float32)
            _, grad = self.gradients(cut, labels[pick], weight, 0.2 if step > steps // 2 else 0.0)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            scale = min(1.0, 1.0 / max(norm, 1e-9))
            now = rate * (1 - 0.9 * step / steps)
            for k, g in grad.items():
                g = g * scale
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.995 * v[k] + 0.005 * g * g
                self.w[k] -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.995**step)) + 1e-8)).astype(np.float32)
        return self
