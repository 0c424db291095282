"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation.

Tokens are numbered 0 .. V-1 by falling frequency; the last two numbers are the
end of a text and the unknown word. Each token belongs to one output class; its
probability is P(class | state) * P(token | class, state). Texts run through
``lanes``: each lane reads texts one after another, the state starts at zero
with each text and is carried from window to window until the text ends, so a
text of any length is scored whole and memory holds one window.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN = 16
LANES = 512
WINDOW = 16
RATE = 0.2                # of a pass over RATE_TOKENS or more; smaller passes step more carefully
RATE_TOKENS = 500_000


def classes_of(freq: np.ndarray, n_classes: int) -> np.ndarray:
    """Class of each token: runs of falling frequency of about equal summed square root."""
    share = np.sqrt(freq + 1.0)
    run = np.cumsum(share) - share / 2
    return np.minimum((run / share.sum() * n_classes).astype(np.int64), n_classes - 1)


class Lanes:
    """Texts dealt to lanes, longest first to the shortest lane; step t is a prefix of the lanes."""

    def __init__(self, lengths: np.ndarray, lanes: int):
        order = np.argsort(-lengths, kind="stable")
        heap = [(0, i) for i in range(min(lanes, max(1, len(lengths))))]
        place = np.zeros((2, len(lengths)), np.int64)
        for d in order.tolist():
            used, lane = heapq.heappop(heap)
            place[:, d] = lane, used
            heapq.heappush(heap, (used + int(lengths[d]), lane))
        size = np.zeros(len(heap), np.int64)
        for used, lane in heap:
            size[lane] = used
        rank = np.empty(len(size), np.int64)
        rank[np.argsort(-size, kind="stable")] = np.arange(len(size))
        self.lane, self.at = rank[place[0]], place[1]
        self.size = -np.sort(-size)
        self.steps = int(self.size[0]) if len(size) else 0


class Gru:
    def __init__(self, freq: np.ndarray, hidden: int = HIDDEN, seed: int = 5):
        """``freq``: training count of each token, falling but for the last two (end, unknown)."""
        v = len(freq)
        self.v, self.hidden = v, hidden
        words = v - 2
        n = max(1, int(np.sqrt(max(words, 1))))
        cls = np.empty(v, np.int64)
        cls[:words] = classes_of(freq[:words], n)
        cls[v - 2], cls[v - 1] = n, n + 1               # end and unknown are alone in theirs
        used, cls = np.unique(cls, return_inverse=True)
        self.cls, self.n_cls = cls, len(used)
        # a class is a run of token numbers
        self.lo = np.searchsorted(cls, np.arange(self.n_cls), "left")
        self.hi = np.searchsorted(cls, np.arange(self.n_cls), "right")
        rng = np.random.default_rng(seed)
        h = hidden
        mass = np.bincount(cls, weights=freq + 1.0)
        self.p = {
            "gate": (rng.normal(size=(v, 3 * h)) * 0.1).astype(np.float32),
            "turn": (rng.normal(size=(h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "cls_w": np.zeros((h, self.n_cls), np.float32),
            "cls_b": np.log(mass / mass.sum()).astype(np.float32),
            "out_w": np.zeros((h, v), np.float32),
            "out_b": np.log((freq + 1.0) / mass[cls]).astype(np.float32),
        }
        self.grown = {k: np.full_like(x, 0.1) for k, x in self.p.items()}

    # -- weights as one vector, for averaging ---------------------------------
    def vector(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, vector: np.ndarray) -> None:
        a = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = vector[a:a + n].astype(np.float32).reshape(self.p[k].shape)
            a += n

    # -- one window -------------------------------------------------------------
    def _forward(self, h, inputs, fresh, active, keep):
        """States after each step; ``keep`` also returns what the way back needs."""
        gate, turn, d = self.p["gate"], self.p["turn"], self.hidden
        states, cache = [], []
        for t in range(len(active)):
            n = active[t]
            if n < len(h):
                h = h[:n]
            h = np.where(fresh[t][:, None], np.float32(0), h)
            x = gate[inputs[t]]
            u = h @ turn
            zr = 1.0 / (1.0 + np.exp(-(x[:, :2 * d] + u[:, :2 * d])))
            z, r = zr[:, :d], zr[:, d:]
            a = u[:, 2 * d:]
            c = np.tanh(x[:, 2 * d:] + r * a)
            new = c + z * (h - c)
            if keep:
                cache.append((h, z, r, a, c))
            h = new
            states.append(h)
        return h, states, cache

    def _output(self, s, y, grads=None):
        """log P of each target; with ``grads`` also the gradient towards the states."""
        p, cls = self.p, self.cls[y]
        n = len(y)
        z = s @ p["cls_w"] + p["cls_b"]
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1)
        rows = np.arange(n)
        logp = z[rows, cls] - np.log(total)
        ds = None
        if grads is not None:
            e /= total[:, None]
            e[rows, cls] -= 1.0
            grads["cls_w"] = s.T @ e
            grads["cls_b"] = e.sum(axis=0)
            ds = e @ p["cls_w"].T
            grads["out_w"], grads["out_b"] = np.zeros_like(p["out_w"]), np.zeros_like(p["out_b"])
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(self.n_cls + 1))
        for c in range(self.n_cls):
            lo, hi = self.lo[c], self.hi[c]
            k = order[edge[c]:edge[c + 1]]
            if hi - lo < 2 or not len(k):
                continue
            sk = s[k]
            z = sk @ p["out_w"][:, lo:hi] + p["out_b"][lo:hi]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            total = e.sum(axis=1)
            at = (np.arange(len(k)), y[k] - lo)
            logp[k] += z[at] - np.log(total)
            if grads is not None:
                e /= total[:, None]
                e[at] -= 1.0
                grads["out_w"][:, lo:hi] = sk.T @ e
                grads["out_b"][lo:hi] = e.sum(axis=0)
                ds[k] += e @ p["out_w"][:, lo:hi].T
        return logp, ds

    def _back(self, states_grad, cache, inputs):
        d, turn = self.hidden, self.p["turn"]
        g_turn = np.zeros_like(turn)
        parts = []
        dh = np.zeros((0, d), np.float32)
        for t in range(len(cache) - 1, -1, -1):
            h, z, r, a, c = cache[t]
            g = states_grad[t]
            if len(dh):
                g = g.copy()
                g[:len(dh)] += dh
            dc = g * (1 - z) * (1 - c * c)
            back = np.concatenate([g * (h - c) * z * (1 - z), dc * a * r * (1 - r), dc * r], axis=1)
            g_turn += h.T @ back
            x = back.copy()
            x[:, 2 * d:] = dc
            parts.append(x)
            dh = g * z + back @ turn.T
            # a state that was set to zero has no past
            dh[~h.any(axis=1)] = 0
        tok = np.concatenate([inputs[t] for t in range(len(cache) - 1, -1, -1)])
        order = np.argsort(tok, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(tok[order]) != 0])
        rows = np.add.reduceat(np.concatenate(parts)[order], first, axis=0)
        return g_turn, tok[order][first], rows

    def _update(self, name, grad, rate, rows=slice(None)):
        g = np.clip(grad, -1.0, 1.0)
        self.grown[name][rows] += g * g
        self.p[name][rows] -= np.float32(rate) * g / np.sqrt(self.grown[name][rows])

    # -- texts --------------------------------------------------------------------
    def run(self, tokens: np.ndarray, offs: np.ndarray, train: bool = False,
            lanes: int | None = None, window: int = WINDOW) -> np.ndarray:
        """Natural log P of each text (each ends in the end token); ``train`` learns on the way."""
        lengths = np.diff(offs)
        if lanes is None:                                # fewer lanes are more, smaller steps
            lanes = int(np.clip(len(tokens) // 4000, 32, LANES)) if train else LANES
        rate = RATE * min(1.0, len(tokens) / RATE_TOKENS) ** 0.4
        out = np.zeros(len(lengths))
        plan = Lanes(lengths, lanes)
        end = self.v - 2
        by_lane = np.lexsort((plan.at, plan.lane))
        starts, lane_of = plan.at[by_lane], plan.lane[by_lane]
        first = np.searchsorted(lane_of, np.arange(len(plan.size) + 1))
        cursor = first[:-1].copy()                       # the text each lane is in
        h = np.zeros((len(plan.size), self.hidden), np.float32)
        lanes_at = np.arange(len(plan.size))
        for t0 in range(0, plan.steps, window):
            span = np.arange(t0, min(plan.steps, t0 + window))
            active = np.searchsorted(-plan.size, -span, "left")
            n0 = int(active[0])
            # which text and place each (step, lane) reads
            docs = np.empty((len(span), n0), np.int64)
            cur = cursor[:n0]
            for i, t in enumerate(span.tolist()):
                nxt = np.minimum(cur + 1, first[1:n0 + 1] - 1)
                step = (cur + 1 < first[1:n0 + 1]) & (starts[nxt] <= t)
                # texts may be one token long, never empty: one advance a step is enough
                cur = np.where(step, nxt, cur)
                docs[i] = by_lane[cur]
            cursor[:n0] = cur
            place = span[:, None] - plan.at[docs]
            valid = lanes_at[None, :n0] < active[:, None]
            pos = np.where(valid, offs[docs] + place, 0)
            fresh = place == 0
            target = tokens[pos]
            inputs = np.where(fresh, end, tokens[np.maximum(pos - 1, 0)])
            acts = active.tolist()
            ins = [inputs[i, :n] for i, n in enumerate(acts)]
            h, states, cache = self._forward(h[:n0], ins, [fresh[i, :n] for i, n in enumerate(acts)],
                                             acts, train)
            s = np.concatenate(states)
            y = np.concatenate([target[i, :n] for i, n in enumerate(acts)])
            grads = {} if train else None
            logp, ds = self._output(s, y, grads)
            np.add.at(out, np.concatenate([docs[i, :n] for i, n in enumerate(acts)]),
                      logp.astype(np.float64))
            if train:
                # the same for every window: one with few lanes left moves the weights less
                scale = np.float32(1.0 / np.sqrt(lanes * window))
                edge = np.cumsum([0, *acts])
                ds *= scale
                g_turn, rows, g_gate = self._back(
                    [ds[edge[i]:edge[i + 1]] for i in range(len(acts))], cache, ins)
                self._update("turn", g_turn, rate)
                self._update("gate", g_gate, rate, rows)
                for k, g in grads.items():
                    self._update(k, g * scale, rate)
        return out
