"""A gated recurrent network in numpy with a class-factored output.

The probability of a word is that of its class times that of the word within its
class.  Classes of frequent words have a softmax over their members; the members
of a rare class follow counts that the caller multiplies in.  Inputs are frequent
words and, for all others, their rare class.
"""

from __future__ import annotations

import numpy as np


class Gru:
    """inputs: number of inputs; bounds: first frequent word of each frequent class and their number; rare: number of rare classes."""

    def __init__(self, inputs: int, bounds: list[int], rare: int, hidden: int = 24, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bounds, self.rare, self.hidden = bounds, rare, hidden
        self.frequent = len(bounds) - 1
        draw = lambda *s: (rng.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {
            "E": draw(inputs, hidden), "Wx": draw(hidden, 3 * hidden), "Wh": draw(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "Wc": draw(hidden, self.frequent + rare), "bc": np.zeros(self.frequent + rare, np.float32),
            "Ww": draw(hidden, bounds[-1]), "bw": np.zeros(bounds[-1], np.float32),
        }

    def table(self) -> np.ndarray:
        """What each input adds to the gates."""
        return self.p["E"] @ self.p["Wx"] + self.p["b"]

    def step(self, gates: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The next state from an input's row of table() and the state."""
        k = self.hidden
        own = h @ self.p["Wh"]
        zr = _sigmoid(gates[:, : 2 * k] + own[:, : 2 * k])
        n = _tanh(gates[:, 2 * k :] + zr[:, k:] * own[:, 2 * k :])
        return n + zr[:, :k] * (h - n)

    def log_probs(self, hs: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """ln P(class) + ln P(word | class) of each row; only ln P(class) for rare classes."""
        out = _log_share(hs, self.p["Wc"], self.p["bc"], classes)
        order = np.argsort(classes.astype(np.uint16), kind="stable")  # a radix sort
        ends = np.searchsorted(classes[order], np.arange(self.frequent + 1))
        for c in range(self.frequent):
            rows = order[ends[c] : ends[c + 1]]
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if len(rows) and hi - lo > 1:
                out[rows] += _log_share(hs[rows], self.p["Ww"][:, lo:hi], self.p["bw"][lo:hi], words[rows] - lo)
        return out

    def _outputs(self, hs: np.ndarray, classes: np.ndarray, words: np.ndarray, g: dict) -> np.ndarray:
        """Adds the output layers' gradients of the mean loss to g; the gradient of hs."""
        m = len(hs)
        d = _softmax(hs, self.p["Wc"], self.p["bc"])
        d[np.arange(m), classes] -= 1
        d /= m
        g["Wc"] += hs.T @ d
        g["bc"] += d.sum(axis=0)
        dh = d @ self.p["Wc"].T
        for c in np.unique(classes[classes < self.frequent]):
            lo, hi = self.bounds[c], self.bounds[c + 1]
            if hi - lo > 1:
                rows = np.nonzero(classes == c)[0]
                own = hs[rows]
                d = _softmax(own, self.p["Ww"][:, lo:hi], self.p["bw"][lo:hi])
                d[np.arange(len(rows)), words[rows] - lo] -= 1
                d /= m
                g["Ww"][:, lo:hi] += own.T @ d
                g["bw"][lo:hi] += d.sum(axis=0)
                dh[rows] += d @ self.p["Ww"][:, lo:hi].T
        return dh

    def gradients(self, inputs: np.ndarray, starts: np.ndarray, classes: np.ndarray, words: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of a window (steps by lanes) of truncated backpropagation from state h; starts marks where a document begins."""
        k, steps = self.hidden, len(inputs)
        wh, gates = self.p["Wh"], self.table()[inputs]
        seen = []
        for t in range(steps):
            if starts[t].any():
                h = np.where(starts[t][:, None], np.float32(0), h)
            own = h @ wh
            zr = _sigmoid(gates[t][:, : 2 * k] + own[:, : 2 * k])
            n = _tanh(gates[t][:, 2 * k :] + zr[:, k:] * own[:, 2 * k :])
            new = n + zr[:, :k] * (h - n)
            seen.append((h, own[:, 2 * k :], zr[:, :k], zr[:, k:], n, new))
            h = new
        g = {name: np.zeros_like(x) for name, x in self.p.items()}
        hs = np.concatenate([s[5] for s in seen])
        out = self._outputs(hs, classes.ravel(), words.ravel(), g).reshape(steps, -1, k)
        back, pre, own = np.zeros_like(h), np.empty_like(gates), np.empty_like(gates[0])
        for t in range(steps - 1, -1, -1):
            prev, own_n, z, r, n, _ = seen[t]
            d = out[t] + back
            rest = d * (1 - z)
            dn, dz, dr = pre[t][:, 2 * k :], pre[t][:, :k], pre[t][:, k : 2 * k]
            np.multiply(rest, 1 - n * n, out=dn)
            np.multiply(rest * z, prev - n, out=dz)
            last = dn * r
            np.multiply(last * own_n, 1 - r, out=dr)
            own[:, : 2 * k], own[:, 2 * k :] = pre[t][:, : 2 * k], last
            g["Wh"] += prev.T @ own
            back = d * z + own @ wh.T
            if starts[t].any():
                back[starts[t]] = 0
        # the table's gradient, a row for each input that occurs, goes on to its factors
        flat, ids = pre.reshape(-1, 3 * k), inputs.ravel()
        order = np.argsort(ids.astype(np.uint16) if len(self.p["E"]) <= 1 << 16 else ids, kind="stable")
        first = np.nonzero(np.diff(ids[order], prepend=-1))[0]
        used, sums = ids[order[first]], np.add.reduceat(flat[order], first, axis=0)
        g["b"] += sums.sum(axis=0)
        g["Wx"] += self.p["E"][used].T @ sums
        g["E"][used] = sums @ self.p["Wx"].T
        return g, h

    def train_flat(self, inputs: np.ndarray, classes: np.ndarray, words: np.ndarray, begin: np.ndarray, lanes: int = 32, window: int = 24, passes: int = 4, rate: float = 6e-3) -> None:
        """Of documents one after another (begin marks their first tokens); lanes read on in parts of equal length, Adam follows the gradients."""
        if not len(begin):
            return
        lanes = max(1, min(lanes, len(begin) // window or 1))
        length = -(-len(begin) // lanes)  # the last lane goes on with the first tokens
        x, c, w, s = (np.resize(a, lanes * length).reshape(lanes, length).T for a in (inputs, classes, words, begin))
        m = {n: np.zeros_like(v) for n, v in self.p.items()}
        v2 = {n: np.zeros_like(v) for n, v in self.p.items()}
        total, done = passes * -(-length // window), 0
        for _ in range(passes):
            h = np.zeros((lanes, self.hidden), np.float32)
            for at in range(0, length, window):
                part = slice(at, at + window)
                g, h = self.gradients(x[part], s[part], c[part], w[part], h)
                done += 1
                norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
                scale, step = min(1.0, 1.0 / max(norm, 1e-9)), rate * (1 - done / (total + 1))
                for n, a in g.items():
                    a *= scale
                    m[n] += 0.1 * (a - m[n])
                    v2[n] += 0.01 * (a * a - v2[n])
                    self.p[n] -= (step * (m[n] / (1 - 0.9**done)) / (np.sqrt(v2[n] / (1 - 0.99**done)) + 1e-8)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    """In place."""
    return np.tanh(x, out=x)


def _exp_logits(hs: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits less a shift of each row, their exponentials and the sums of these; states lie in -1 to 1, so weights bound the logits and few need a shift."""
    x = hs @ w
    x += b
    if float((np.abs(w).sum(axis=0) + np.abs(b)).max()) > 60:
        x -= x.max(axis=1, keepdims=True)
    e = np.exp(x)
    return x, e, e @ np.ones(e.shape[1], e.dtype)


def _log_share(hs: np.ndarray, w: np.ndarray, b: np.ndarray, which: np.ndarray) -> np.ndarray:
    """ln of the softmax at one column of each row."""
    x, _, sums = _exp_logits(hs, w, b)
    return x[np.arange(len(x)), which] - np.log(sums)


def _softmax(hs: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, e, sums = _exp_logits(hs, w, b)
    e *= (1 / sums)[:, None]
    return e


def document_scores(model: Gru, docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], first: int, window: int = 64, lanes: int = 4096) -> np.ndarray:
    """ln probability of each document (inputs are those that its tokens are as the next step's input; first starts it).

    Documents run side by side from the longest; windows bound the memory and the
    state goes on from one to the next, so each score is that of the whole document.
    """
    out, table = np.zeros(len(docs)), model.table()
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i][0]))
    for lo in range(0, len(order), lanes):
        mine = order[lo : lo + lanes]
        size = np.array([len(docs[i][0]) for i in mine])
        x, classes, words = (np.concatenate([docs[i][j] for i in mine]) for j in range(3))
        begin = np.cumsum(size) - size
        h = np.zeros((len(mine), model.hidden), np.float32)
        for at in range(0, int(size[0]), window):
            hs, who = [], []
            for t in range(at, min(at + window, int(size[0]))):
                alive = int(np.searchsorted(-size, -t, side="left"))  # those longer than t
                given = x[begin[:alive] + t - 1] if t else np.full(alive, first)
                h = model.step(table[given], h[:alive])
                hs.append(h)
                who.append(alive)
            lane = np.concatenate([np.arange(k) for k in who])
            where = begin[lane] + np.repeat(np.arange(at, at + len(who)), who)
            got = model.log_probs(np.concatenate(hs), classes[where], words[where])
            out[mine[: who[0]]] += np.bincount(lane, weights=got.astype(np.float64), minlength=who[0])
    return out
