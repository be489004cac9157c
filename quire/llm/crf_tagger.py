"""Character-level bidirectional LSTM with a linear-chain CRF on top, in numpy.

Small enough to train on the driver in seconds; tagging is vectorised over many windows at once.
"""

from __future__ import annotations

import numpy as np

KINDS = ["email", "ip", "card", "phone"]
TAGS = 1 + 2 * len(KINDS)  # 0 outside, then begin and inside of each kind
CHARS = 130  # 0 padding, 1..127 ASCII, 128 other letters, 129 other characters


def character_ids(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(code == 0, 129, np.where(code < 128, code, np.where(code < 0x2000, 128, 129))).astype(np.int16)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, embedding: int = 12, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden = hidden

        def matrix(a, b):
            return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        self.w = {"emb": matrix(CHARS, embedding), "out": matrix(2 * hidden, TAGS), "out_b": np.zeros(TAGS, np.float32),
                  "trans": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":  # forward and backward in time
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # remember at first
            self.w |= {f"x{d}": matrix(embedding, 4 * hidden), f"h{d}": matrix(hidden, 4 * hidden), f"b{d}": bias}
        # an inside tag follows only its own begin or inside
        self.allowed = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            for previous in range(TAGS):
                if previous not in (inside, inside - 1):
                    self.allowed[previous, inside] = -1e4
        self.first = np.where([t and t % 2 == 0 for t in range(TAGS)], -1e4, 0).astype(np.float32)

    def _run(self, e: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        b, t, _ = e.shape
        n = self.hidden
        x = e @ self.w[f"x{d}"] + self.w[f"b{d}"]
        h, c, out = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32), np.empty((b, t, n), np.float32)
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = x[:, s] + h @ self.w[f"h{d}"]
            gates = _sigmoid(z[:, :3 * n])
            i, f, o = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
            g = np.tanh(z[:, 3 * n:])
            c_new = f * c + i * g
            th = np.tanh(c_new)
            if keep is not None:
                keep.append((s, i, f, o, g, c, th, h))
            h, c = o * th, c_new
            out[:, s] = h
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        e = self.w["emb"][ids]
        return np.concatenate((self._run(e, "f"), self._run(e, "b")), 2) @ self.w["out"] + self.w["out_b"]

    def _forward(self, em: np.ndarray) -> np.ndarray:
        trans = self.w["trans"] + self.allowed
        alpha = np.empty_like(em)
        alpha[:, 0] = em[:, 0] + self.w["start"] + self.first
        for s in range(1, em.shape[1]):
            alpha[:, s] = em[:, s] + _logsumexp(alpha[:, s - 1][:, :, None] + trans, 1)
        return alpha

    def _backward(self, em: np.ndarray) -> np.ndarray:
        trans = self.w["trans"] + self.allowed
        beta = np.zeros_like(em)
        for s in range(em.shape[1] - 2, -1, -1):
            beta[:, s] = _logsumexp(trans + (em[:, s + 1] + beta[:, s + 1])[:, None, :], 2)
        return beta

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tag sequence of each window (Viterbi) and the marginal probability of each chosen tag."""
        em = self.emissions(ids)
        trans = self.w["trans"] + self.allowed
        b, t, _ = em.shape
        score, back = em[:, 0] + self.w["start"] + self.first, np.empty((b, t, TAGS), np.int8)
        for s in range(1, t):
            every = score[:, :, None] + trans
            back[:, s] = every.argmax(1)
            score = every.max(1) + em[:, s]
        tags = np.empty((b, t), np.int8)
        tags[:, -1] = score.argmax(1)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[np.arange(b), s, tags[:, s]]
        alpha, beta = self._forward(em), self._backward(em)
        logp = alpha + beta - _logsumexp(alpha[:, -1], 1)[:, None, None]
        return tags, np.exp(np.take_along_axis(logp, tags[:, :, None].astype(np.int64), 2)[:, :, 0])

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        b, t = ids.shape
        n = self.hidden
        e = self.w["emb"][ids]
        kept = {"f": [], "b": []}
        hs = np.concatenate((self._run(e, "f", kept["f"]), self._run(e, "b", kept["b"])), 2)
        em = hs @ self.w["out"] + self.w["out_b"]
        alpha, beta = self._forward(em), self._backward(em)
        z = _logsumexp(alpha[:, -1], 1)
        trans = self.w["trans"] + self.allowed
        rows = np.arange(b)[:, None]
        gold = em[rows, np.arange(t), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1) + (self.w["start"] + self.first)[tags[:, 0]]
        d_em = np.exp(alpha + beta - z[:, None, None])
        pair = np.exp(alpha[:, :-1, :, None] + trans + (em[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pair, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        first = d_em[:, 0].sum(0) - np.bincount(tags[:, 0], minlength=TAGS)
        d_em[rows, np.arange(t), tags] -= 1
        g = {"trans": pair / b, "start": first / b}
        d_em /= b
        flat = d_em.reshape(-1, TAGS)
        g |= {"out": hs.reshape(-1, 2 * n).T @ flat, "out_b": flat.sum(0)}
        d_hs, d_e = d_em @ self.w["out"].T, np.zeros_like(e)
        for d, at in (("f", 0), ("b", n)):
            wh = self.w[f"h{d}"]
            dx, dwh = np.empty((b, t, 4 * n), np.float32), np.zeros_like(wh)
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for s, i, f, o, gg, c, th, h in reversed(kept[d]):
                dh = dh + d_hs[:, s, at:at + n]
                dc = dc + dh * o * (1 - th ** 2)
                dz = np.concatenate((dc * gg * i * (1 - i), dc * c * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - gg ** 2)), 1)
                dx[:, s] = dz
                dwh += h.T @ dz
                dh, dc = dz @ wh.T, dc * f
            g |= {f"h{d}": dwh, f"x{d}": e.reshape(-1, e.shape[2]).T @ dx.reshape(-1, 4 * n), f"b{d}": dx.sum((0, 1))}
            d_e += dx @ self.w[f"x{d}"].T
        g["emb"] = np.zeros_like(self.w["emb"])
        np.add.at(g["emb"], ids.ravel(), d_e.reshape(-1, e.shape[2]))
        return float((z - gold).mean()), g

    def fit(self, ids: np.ndarray, tags: np.ndarray, epochs: int = 5, batch: int = 48, rate: float = 0.012, seed: int = 3,
            more: list[tuple[np.ndarray, np.ndarray]] = ()) -> list[float]:
        """Adam over shuffled batches, each of one of the sets (``ids, tags`` and ``more``, which may have other widths); the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            batches, total = [], 0.0
            for x, y in ((ids, tags), *more):
                order = rng.permutation(len(x))
                batches += [(x[order[a:a + batch]], y[order[a:a + batch]]) for a in range(0, len(order), batch)]
            for at in rng.permutation(len(batches)) if more else range(len(batches)):
                some, gold = batches[at]
                loss, g = self.gradients(some, gold.astype(np.int64))
                norm = np.sqrt(sum(float((x ** 2).sum()) for x in g.values()))
                step += 1
                for k, x in g.items():
                    x = x * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.99 * v[k] + 0.01 * x ** 2
                    self.w[k] -= (rate * (0.6 ** epoch) * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
                total += loss * len(some)
            losses.append(total / max(len(ids) + sum(len(x) for x, _ in more), 1))
        return losses
