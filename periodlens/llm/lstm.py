"""A character tagger in numpy: bidirectional LSTM emissions, CRF transitions."""

from __future__ import annotations

import numpy as np

VOCABULARY = 132
PAD = VOCABULARY - 1


def char_ids(text: str) -> np.ndarray:
    """ASCII as itself; other characters in three classes (Latin letters, the rest of the basic plane, beyond)."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < 128, cp, np.where(cp < 0x250, 128, np.where(cp < 0x10000, 129, 130))).astype(np.uint8)


class Tagger:
    """Tags: 0 is outside; kind k begins with 2k + 1 and goes on with 2k + 2."""

    def __init__(self, kinds: int, hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.kinds, self.hidden, self.tags = kinds, hidden, 2 * kinds + 1
        h = hidden
        p = {"x": rng.normal(0, 0.3, (2, VOCABULARY, 4 * h)), "u": rng.normal(0, 0.3, (2, h, 4 * h)),
             "o": rng.normal(0, 0.3, (2, h, self.tags)), "b": np.zeros(self.tags), "a": np.zeros((self.tags, self.tags))}
        p["x"][:, :, h : 2 * h] += 1.0  # remember at first
        self.p = {k: v.astype(np.float32) for k, v in p.items()}
        self.allowed = np.ones((self.tags, self.tags), bool)
        for k in range(kinds):  # a kind goes on only after itself
            self.allowed[:, 2 * k + 2] = False
            self.allowed[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True

    def transitions(self) -> np.ndarray:
        return np.where(self.allowed, self.p["a"], -1e4).astype(np.float32)

    # ------------------------------------------------------------ forward
    def _step(self, z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gates (activated in place in ``z``: in, forget, out, candidate) and the new cell."""
        h = self.hidden
        z[..., : 3 * h] *= 0.5
        np.tanh(z, out=z)
        z[..., : 3 * h] *= 0.5
        z[..., : 3 * h] += 0.5
        c = c * z[..., h : 2 * h]
        c += z[..., :h] * z[..., 3 * h :]
        return c, np.tanh(c)

    def emissions(self, ids: np.ndarray):
        """Scores (windows, characters, tags) of id windows, and the states that training needs."""
        n, t = ids.shape
        h, p = self.hidden, self.p
        both = np.stack([ids, ids[:, ::-1]])  # direction, window, step
        table = p["x"].reshape(2 * VOCABULARY, 4 * h)
        index = both.astype(np.int32) + np.array([0, VOCABULARY], np.int32)[:, None, None]
        out = np.empty((t, n, self.tags), np.float32)
        out[:] = p["b"]
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        kept = []
        for s in range(t):
            z = table[index[:, :, s]]
            z += state @ p["u"]
            before, old = state, cell
            cell, squashed = self._step(z, cell)
            state = z[..., 2 * h : 3 * h] * squashed
            out[s] += state[0] @ p["o"][0]
            out[t - 1 - s] += state[1] @ p["o"][1]
            kept.append((z, old, squashed, before, state))
        return out.transpose(1, 0, 2), both, kept

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """The emissions again (tags, characters, windows), without what training needs: one direction
        after the other, windows along the rows, in reused memory."""
        n, t = ids.shape
        h, p = self.hidden, self.p
        half = np.ones(4 * h, np.float32)
        half[: 3 * h] = 0.5  # half angles, so that one tanh serves all gates
        out = np.empty((self.tags, t, n), np.float32)
        out[:] = p["b"][:, None, None]
        steps = np.ascontiguousarray(ids.T).astype(np.intp)
        z, y = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32)
        product = np.empty((h, n), np.float32)
        gates = z[: 3 * h]
        for d, order in enumerate((range(t), range(t - 1, -1, -1))):
            table = np.ascontiguousarray((p["x"][d] * half).T)
            u, o = np.ascontiguousarray((p["u"][d] * half).T), np.ascontiguousarray(p["o"][d].T)
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for s in order:
                np.take(table, steps[s], axis=1, out=z, mode="clip")
                np.matmul(u, state, out=y)
                z += y
                np.tanh(z, out=z)
                gates *= 0.5
                gates += 0.5
                cell *= z[h : 2 * h]
                np.multiply(z[:h], z[3 * h :], out=product)
                cell += product
                np.tanh(cell, out=product)
                np.multiply(product, z[2 * h : 3 * h], out=state)
                out[:, s] += o @ state
        return out

    # ----------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Best tags of each window, (windows, characters)."""
        e, a = self.scores(ids), self.transitions()
        tags = np.zeros(ids.shape, np.int8)
        some = np.flatnonzero(self._leaves(e, a))
        if len(some):
            tags[some] = self._viterbi(e[:, :, some], a)
        return tags

    def _leaves(self, e: np.ndarray, a: np.ndarray) -> np.ndarray:
        """Windows whose best path may hold another tag than 0.  Scores are taken relative to tag 0 throughout;
        a kind's inner tag follows its own kind, as in the search, and a first tag after another kind
        gets that step's best case.  Windows in which nothing comes out above 0 need no search."""
        first, inner = e[1::2] - e[:1], e[2::2] - e[:1]
        k = np.arange(self.kinds)
        b, i = 2 * k + 1, 2 * k + 2
        into = (a[0, b] - a[0, 0])[:, None]
        other = (a[1:, b].max(axis=0) - a[0, 0])[:, None]
        go, stay = (a[b, i] - a[0, 0])[:, None], (a[i, i] - a[0, 0])[:, None]
        out = np.maximum(a[b, 0], a[i, 0])[:, None] - a[0, 0]
        outside = np.zeros(e.shape[2], np.float32)
        begun, inside = first[:, 0], inner[:, 0]  # a window may begin inside a span
        for s in range(1, e.shape[1]):
            held = np.maximum(begun, inside)
            best = held.max(axis=0)
            inside = np.maximum(begun + go, inside + stay) + inner[:, s]
            begun = np.maximum(outside + into, best + other) + first[:, s]
            outside = np.maximum(outside, (held + out).max(axis=0))
        return np.maximum(outside, np.maximum(begun, inside).max(axis=0)) > 0

    def _viterbi(self, e: np.ndarray, a: np.ndarray) -> np.ndarray:
        k, t, n = e.shape
        best, back = e[:, 0].copy(), np.zeros((t, k, n), np.int8)
        for s in range(1, t):
            ways = best[:, None, :] + a[:, :, None]
            back[s] = ways.argmax(axis=0)
            best = ways.max(axis=0) + e[:, s]
        tags = np.empty((n, t), np.int8)
        tags[:, -1] = best.argmax(axis=0)
        rows = np.arange(n)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[s, tags[:, s], rows]
        return tags

    # ----------------------------------------------------------- training
    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window and its gradient."""
        e, both, kept = self.emissions(ids)
        e, a = e.astype(np.float64), self.transitions().astype(np.float64)
        n, t, k = e.shape

        def lse(x, axis):
            m = x.max(axis=axis, keepdims=True)
            return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

        alpha, beta = np.empty((t, n, k)), np.zeros((t, n, k))
        alpha[0] = e[:, 0]
        for s in range(1, t):
            alpha[s] = lse(alpha[s - 1][:, :, None] + a, 1) + e[:, s]
        for s in range(t - 2, -1, -1):
            beta[s] = lse(a[None] + (e[:, s + 1] + beta[s + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        rows = np.arange(n)
        right = e[rows[:, None], np.arange(t), tags].sum(axis=1) + a[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        de = np.exp(alpha + beta - total[:, None])  # step, window, tag
        da = np.zeros((k, k))
        for s in range(1, t):
            da += np.exp(alpha[s - 1][:, :, None] + a + (e[:, s] + beta[s])[:, None, :] - total[:, None, None]).sum(axis=0)
        np.add.at(de, (np.arange(t)[:, None], rows[None, :], tags.T), -1.0)
        np.add.at(da, (tags[:, :-1], tags[:, 1:]), -1.0)
        de = (de / n).astype(np.float32)
        g = {"b": de.sum(axis=(0, 1)), "a": np.where(self.allowed, da / n, 0).astype(np.float32)}
        h, p = self.hidden, self.p
        do, du = np.zeros_like(p["o"]), np.zeros_like(p["u"])
        dz_all = np.empty((t, 2, n, 4 * h), np.float32)
        dh, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        back = p["u"].transpose(0, 2, 1)
        for s in range(t - 1, -1, -1):
            z, old, squashed, before, state = kept[s]
            own = np.stack([de[s], de[t - 1 - s]])
            do += state.transpose(0, 2, 1) @ own
            dh = dh + own @ p["o"].transpose(0, 2, 1)
            i, f, o, c = z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]
            dc = dc + dh * o * (1 - squashed**2)
            dz = dz_all[s]
            dz[..., :h] = dc * c * i * (1 - i)
            dz[..., h : 2 * h] = dc * old * f * (1 - f)
            dz[..., 2 * h : 3 * h] = dh * squashed * o * (1 - o)
            dz[..., 3 * h :] = dc * i * (1 - c**2)
            du += before.transpose(0, 2, 1) @ dz
            dh, dc = dz @ back, dc * f
        dx = np.zeros_like(p["x"])
        for d in range(2):
            hot = np.zeros((n * t, VOCABULARY), np.float32)
            hot[np.arange(n * t), both[d].T.reshape(-1)] = 1
            dx[d] = hot.T @ dz_all[:, d].reshape(n * t, 4 * h)
        return float((total - right).mean()), g | {"o": do, "u": du, "x": dx}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches; the losses."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        losses = []
        for s in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, g = self.gradient(ids[pick], tags[pick])
            losses.append(loss)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate_now = rate * min(1.0, 2 * (1 - (s - 1) / steps))
            for k in self.p:
                x = g[k] * min(1.0, 5.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - rate_now * (m[k] / (1 - 0.9**s)) / (np.sqrt(v[k] / (1 - 0.99**s)) + 1e-8)).astype(np.float32)
        return losses
