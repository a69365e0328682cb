"""Character BiLSTM with CRF transitions, forward, backward and Viterbi in numpy.

The input layer is one table per direction that holds, for every symbol, its
contribution to the four gates, so a step costs one look-up and one product
with the recurrent matrix.  Arrays are time-major: [T, B, ...], or where it is
said [labels, T, B].
"""

from __future__ import annotations

import numpy as np

from quaestor.llm import lstm_onnx


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    NAMES = ("pf", "wf", "pb", "wb", "wo", "bo", "tr", "st")

    def __init__(self, params: dict[str, np.ndarray]):
        self.p = params
        self.h = params["wf"].shape[0]
        self.k = params["bo"].shape[0]
        self.fast: lstm_onnx.Emissions | None = None  # for searches; training changes the weights

    @classmethod
    def fresh(cls, symbols: int, hidden: int, labels: int, seed: int = 0) -> "BiLstmCrf":
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        p = {
            "pf": g(symbols, 4 * hidden, scale=0.3), "wf": g(hidden, 4 * hidden, scale=hidden**-0.5),
            "pb": g(symbols, 4 * hidden, scale=0.3), "wb": g(hidden, 4 * hidden, scale=hidden**-0.5),
            "wo": g(2 * hidden, labels, scale=(2 * hidden) ** -0.5), "bo": np.zeros(labels, np.float32),
            "tr": np.zeros((labels, labels), np.float32), "st": np.zeros(labels, np.float32),
        }
        for x in ("pf", "pb"):  # forget gates start open
            p[x][:, hidden : 2 * hidden] += 1.0
        return cls(p)

    @classmethod
    def load(cls, path: str) -> "BiLstmCrf":
        with np.load(path) as z:
            return cls({k: z[k].astype(np.float32) for k in cls.NAMES})

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _run(self, table, w, ids, mask, back, keep):
        t_n, b = ids.shape
        n = self.h
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out = np.empty((t_n, b, n), np.float32)
        tape = []
        # the sigmoid's half goes into the weights once: a power of two, so every result stays as it is
        half = np.r_[np.full(3 * n, 0.5), np.ones(n)].astype(np.float32)
        table, w = table * half, w * half
        z, hw, tc = np.empty((b, 4 * n), np.float32), np.empty((b, 4 * n), np.float32), np.empty((b, n), np.float32)
        whole = mask.all(axis=(1, 2))
        for t in range(t_n - 1, -1, -1) if back else range(t_n):
            if keep:
                z, tc = np.empty_like(z), np.empty_like(tc)
            np.take(table, ids[t], axis=0, out=z, mode="clip")
            z += np.matmul(h, w, out=hw)
            np.tanh(z, out=z)
            s = z[:, : 3 * n]
            s *= 0.5
            s += 0.5
            i, f, o, g = z[:, :n], z[:, n : 2 * n], z[:, 2 * n : 3 * n], z[:, 3 * n :]
            c0, h0 = c, h
            c = f * c
            c += i * g
            if not whole[t]:
                c *= mask[t]
            np.tanh(c, out=tc)
            h = out[t]
            np.multiply(o, tc, out=h)
            if not whole[t]:
                h *= mask[t]
            if keep:
                tape.append((t, i, f, o, g, c0, tc, h0))
        return out, tape

    def emissions(self, ids, mask, keep=False):
        m = mask[:, :, None].astype(np.float32)
        f, tf = self._run(self.p["pf"], self.p["wf"], ids, m, False, keep)
        b, tb = self._run(self.p["pb"], self.p["wb"], ids, m, True, keep)
        hidden = np.concatenate([f, b], axis=2)
        return hidden @ self.p["wo"] + self.p["bo"], hidden, tf, tb

    def scores(self, ids, mask):
        """Emissions as [labels, T, B], by ONNX Runtime where it is installed."""
        if self.fast is None and lstm_onnx.runtime():
            self.fast = lstm_onnx.Emissions(self.p)
        return self.fast(ids, mask) if self.fast else self.emissions(ids, mask)[0].transpose(2, 0, 1)

    def outside(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Windows whose best path is sure to stay at label 0; e: [labels, T, B].

        A way out of label 0 and back gains at most `enter` where it leaves, `go` for each further place and `back`
        where it returns, each the most over all labels.  Where no such way gains anything, none is in the best path.
        """
        tr = self.p["tr"] - self.p["tr"][0, 0]
        st = self.p["st"] - self.p["st"][0]
        on, back, slack = tr[1:].max(0), tr[1:, 0].max(), 1e-3  # more than rounding can add up to
        enter = go = first = -np.inf
        for own in (slice(1, None, 2), slice(2, None, 2)):  # bounded together: labels that begin, labels that continue
            d = e[own].max(0)
            d -= e[0]
            enter = np.maximum(enter, d + tr[0, own].max())
            go = np.maximum(go, d + on[own].max())
            first = np.maximum(first, d[0] + st[own].max())
        gain = enter  # of the best way that is outside at t
        gain[0] = first
        for t in range(1, len(gain)):
            np.maximum(gain[t], np.add(gain[t - 1], go[t], out=go[t]), out=gain[t])
        last = gain[mask.sum(0) - 1, np.arange(mask.shape[1])]  # where the window ends nothing leads back
        return (np.where(mask, gain, -np.inf).max(0) + back < -slack) & (last < -slack)

    def decode(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Most likely label of every position, [T, B]; meaningless where mask is 0."""
        return self.paths(self.emissions(ids, mask)[0].transpose(2, 0, 1), mask)

    def paths(self, e: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Best paths for emissions [labels, T, B]."""
        k, t_n, b = e.shape
        best = np.ascontiguousarray(e.transpose(1, 0, 2))
        best[0] += self.p["st"][:, None]
        tr = self.p["tr"][:, :, None]
        whole = mask.all(1)
        ways, top = np.empty((k, k, b), np.float32), np.empty((k, b), np.float32)  # [from, to, B]
        for t in range(1, t_n):
            np.add(best[t - 1][:, None], tr, out=ways).max(0, out=top)
            best[t] += top
            if not whole[t]:
                np.copyto(best[t], best[t - 1], where=~mask[t])
        path = np.zeros((t_n, b), np.int8)
        cur = best[-1].argmax(0)
        for t in range(t_n - 1, -1, -1):
            path[t] = cur
            if t:  # where the best way to a label came from is asked for the labels of the path only
                np.add(best[t - 1], self.p["tr"].take(cur, axis=1), out=top)
                cur = top.argmax(0) if whole[t] else np.where(mask[t], top.argmax(0), cur)
        return path

    def loss_and_grads(self, ids, mask, gold):
        """Mean negative log-likelihood of a batch and its gradients."""
        p, n = self.p, self.h
        e, hidden, tf, tb = self.emissions(ids, mask, keep=True)
        t_n, b, k = e.shape
        tr, rows = p["tr"], np.arange(b)
        al = np.empty((t_n, b, k), np.float32)
        be = np.zeros((t_n, b, k), np.float32)
        al[0] = p["st"] + e[0]
        for t in range(1, t_n):
            al[t] = np.where(mask[t][:, None], _lse(al[t - 1][:, :, None] + tr, 1) + e[t], al[t - 1])
        for t in range(t_n - 2, -1, -1):
            be[t] = np.where(mask[t + 1][:, None], _lse(tr[None] + (e[t + 1] + be[t + 1])[:, None, :], 2), be[t + 1])
        z = _lse(al[-1], 1)
        de = np.exp(al + be - z[None, :, None]) * mask[:, :, None]
        dtr = np.zeros_like(tr)
        score = p["st"][gold[0]] + e[0, rows, gold[0]]
        dst = de[0].sum(0) - np.bincount(gold[0], minlength=k)
        for t in range(1, t_n):
            m = mask[t]
            x = np.exp(al[t - 1][:, :, None] + tr + (e[t] + be[t] - z[:, None])[:, None, :])
            dtr += (x * m[:, None, None]).sum(0)
            np.subtract.at(dtr, (gold[t - 1][m], gold[t][m]), 1)
            score += (tr[gold[t - 1], gold[t]] + e[t, rows, gold[t]]) * m
        tt, bb = np.nonzero(mask)
        de[tt, bb, gold[tt, bb]] -= 1
        de /= b
        grads = {"tr": dtr / b, "st": (dst / b).astype(np.float32), "wo": np.einsum("tbh,tbk->hk", hidden, de), "bo": de.sum((0, 1))}
        dh = de @ p["wo"].T
        m3 = mask[:, :, None].astype(np.float32)
        for table, w, tape, part in (("pf", "wf", tf, dh[:, :, :n]), ("pb", "wb", tb, dh[:, :, n:])):
            gt, gw = np.zeros_like(p[table]), np.zeros_like(p[w])
            rh, rc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            wt = p[w].T.copy()
            for t, i, f, o, g, c0, tc, h0 in reversed(tape):
                h_ = (part[t] + rh) * m3[t]
                c_ = (h_ * o * (1 - tc * tc) + rc) * m3[t]
                dz = np.concatenate([c_ * g * i * (1 - i), c_ * c0 * f * (1 - f), h_ * tc * o * (1 - o), c_ * i * (1 - g * g)], axis=1)
                gw += h0.T @ dz
                order = np.argsort(ids[t], kind="stable")
                s = ids[t][order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                gt[s[first]] += np.add.reduceat(dz[order], first, axis=0)
                rh, rc = dz @ wt, c_ * f
            grads[table], grads[w] = gt, gw
        return float((z - score).mean()), grads


def train(model: BiLstmCrf, batches, rate: float = 0.004, clip: float = 5.0, total: int = 1000, tell=None) -> BiLstmCrf:
    """Adam with a linear decay over `total` batches of (ids, mask, gold), each [T, B]."""
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    for step, (ids, mask, gold) in enumerate(batches, 1):
        loss, g = model.loss_and_grads(ids, mask, gold)
        norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
        scale = min(1.0, clip / (norm + 1e-9))
        lr = rate * max(0.02, 1 - step / total)
        for k, x in g.items():
            x = x * scale
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            model.p[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if tell:
            tell(step, loss)
    return model
