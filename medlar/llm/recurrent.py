"""A gated recurrent language model with a class-factored softmax, trained by truncated backpropagation in numpy.

Outputs are CLASSES x CLASSES: the frequent words, the end of a text, and BUCKETS sorts of all other words by their last
two bytes and length. An output's class is predicted first, then the output within its class.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 32
CLASSES = 32
OUTPUTS = CLASSES * CLASSES
BUCKETS = 256
END = 0
#: Steps that errors go back, and texts that run side by side.
WINDOW = 32
STREAMS = 64
#: Texts that run side by side where a task learns its share of a corpus.
WIDE = 128

_F = np.float32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _softmax(x: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, ln P of the wanted column of each row), in place of ``x``. Exponents are held below what single
    precision overflows at, instead of looking for each row's largest."""
    np.minimum(x, 60, out=x)
    likely = x[rows, wanted]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x *= (1 / total)[:, None]
    return x, likely - np.log(total)


def _by_class(group: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that sorts by class, and (class, begin, end) of the classes that there are."""
    order = np.argsort(group.astype(np.uint8), kind="stable")
    border = np.searchsorted(group[order], np.arange(CLASSES + 1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(border, border[1:], strict=False)) if a < b]


class Adam:
    """Running means of a model's gradients and of their squares."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.first = {k: np.zeros_like(v) for k, v in p.items()}
        self.second = {k: np.zeros_like(v) for k, v in p.items()}
        self.turn = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], pace: float) -> None:
        """Replace the parameters by those one step on; the gradient's norm is cut at 1."""
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        self.turn += 1
        for k, x in g.items():
            x = x * _F(min(1, 1 / (norm + 1e-9)))
            self.first[k] += _F(0.1) * (x - self.first[k])
            self.second[k] += _F(0.01) * (x * x - self.second[k])
            up = self.first[k] / _F(1 - 0.9**self.turn) / (np.sqrt(self.second[k] / _F(1 - 0.99**self.turn)) + _F(1e-6))
            p[k] = p[k] - _F(pace) * up


class GatedModel:
    """Parameters: embed (input), gates (recurrent), heads of classes and of the outputs in each class."""

    def __init__(self, seed: int = 10, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        self.p = {
            "x": rng.normal(0, 0.3, (OUTPUTS, 3 * hidden)).astype(_F),  # a token's part of update, reset and candidate
            "u": rng.normal(0, scale, (hidden, 2 * hidden)).astype(_F),
            "v": rng.normal(0, scale, (hidden, hidden)).astype(_F),
            "c": rng.normal(0, scale, (hidden, CLASSES)).astype(_F),
            "cb": np.zeros(CLASSES, _F),
            "w": rng.normal(0, scale, (CLASSES, hidden, CLASSES)).astype(_F),
            "wb": np.zeros((CLASSES, CLASSES), _F),
        }
        self.hidden = hidden

    def start(self, frequency: np.ndarray) -> None:
        """Biases from the outputs' counts."""
        f = frequency.reshape(CLASSES, CLASSES) + 0.5
        self.p["cb"] = np.log(f.sum(1) / f.sum()).astype(_F)
        self.p["wb"] = np.log(f / f.sum(1, keepdims=True)).astype(_F)

    def step(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
        """(next state, update gate, reset gate, candidate) after a token."""
        d, x = self.hidden, self.p["x"][token]
        gates = _sigmoid(x[:, : 2 * d] + h @ self.p["u"])
        z, r = gates[:, :d], gates[:, d:]
        n = np.tanh(x[:, 2 * d :] + (r * h) @ self.p["v"])
        return h + z * (n - h), z, r, n

    def log_probability(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """ln P(token | state): its class's and its own within the class."""
        group, own = token // CLASSES, token % CLASSES
        rows = np.arange(len(token))
        out = _softmax(h @ self.p["c"] + self.p["cb"], rows, group)[1]
        order, parts = _by_class(group)
        out[order] += _softmax(self._within(h[order], parts), rows, own[order])[1]
        return out

    def _within(self, states: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits of the outputs in each state's class, for states sorted by class."""
        out = np.empty((len(states), CLASSES), states.dtype)
        for k, a, b in parts:
            np.matmul(states[a:b], self.p["w"][k], out=out[a:b])
            out[a:b] += self.p["wb"][k]
        return out

    def _window(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], float]:
        """State after a window, gradients of the mean loss, and the loss. A state is cleared where the input is END."""
        d, p = self.hidden, self.p
        steps, n = inputs.shape
        cleared = [np.flatnonzero(row) for row in inputs == END]
        taken = p["x"][inputs]
        shape, kind = (steps, n, d), taken.dtype
        before, after, z, r, c = (np.empty(shape, kind) for _ in range(5))
        for t in range(steps):
            before[t] = h
            before[t, cleared[t]] = 0
            h = before[t]
            gates = _sigmoid(taken[t, :, : 2 * d] + h @ p["u"])
            z[t], r[t] = gates[:, :d], gates[:, d:]
            np.tanh(taken[t, :, 2 * d :] + (r[t] * h) @ p["v"], out=c[t])
            after[t] = h + z[t] * (c[t] - h)
            h = after[t]
        g = {k: np.zeros_like(v) for k, v in p.items()}
        states, target = after.reshape(-1, d), targets.reshape(-1)
        group, own, rows = target // CLASSES, target % CLASSES, np.arange(len(target))
        error, likely = _softmax(states @ p["c"] + p["cb"], rows, group)
        loss = -likely.sum()
        error[rows, group] -= 1
        error /= len(target)
        ones = np.ones(len(target), kind)
        g["c"], g["cb"] = states.T @ error, ones @ error
        back = error @ p["c"].T
        order, parts = _by_class(group)
        sorted_states = states[order]
        error, likely = _softmax(self._within(sorted_states, parts), rows, own[order])
        loss -= likely.sum()
        error[rows, own[order]] -= 1
        error /= len(target)
        inner = np.empty_like(sorted_states)
        for k, a, b in parts:
            g["w"][k], g["wb"][k] = sorted_states[a:b].T @ error[a:b], ones[a:b] @ error[a:b]
            np.matmul(error[a:b], p["w"][k].T, out=inner[a:b])
        back[order] += inner
        back = back.reshape(shape)
        to_new, to_update, to_reset, stays = z * (1 - c * c), (c - before) * z * (1 - z), before * r * (1 - r), 1 - z
        u_back, v_back = np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["v"].T)
        dh, dx = np.zeros((n, d), kind), np.empty((steps, n, 3 * d), kind)
        for t in range(steps - 1, -1, -1):
            dh = dh + back[t]
            dn = dh * to_new[t]
            drh = dn @ v_back
            dx[t, :, :d], dx[t, :, d : 2 * d], dx[t, :, 2 * d :] = dh * to_update[t], drh * to_reset[t], dn
            dh = dh * stays[t] + drh * r[t] + dx[t, :, : 2 * d] @ u_back
            dh[cleared[t]] = 0
        moves = dx.reshape(-1, 3 * d)
        g["u"], g["v"] = before.reshape(-1, d).T @ moves[:, : 2 * d], (r * before).reshape(-1, d).T @ moves[:, 2 * d :]
        order = np.argsort(inputs.reshape(-1).astype(np.uint16), kind="stable")
        tokens, first_at = np.unique(inputs.reshape(-1)[order], return_index=True)
        g["x"][tokens] = np.add.reduceat(moves[order], first_at, axis=0)
        return h, g, float(loss) / len(target)

    def fit(self, tokens: np.ndarray, epochs: int = 1, rate: float = 0.008) -> list[float]:
        """Adam over windows of parallel streams of ``tokens`` (texts behind one another, each ended by END); the state
        goes on from window to window. Returns the losses, in nats a token."""
        streams = max(1, min(STREAMS, len(tokens) // (2 * WINDOW)))
        length = len(tokens) // streams
        if length < 2:
            return []
        rows = tokens[: streams * length].reshape(streams, length).T
        adam = Adam(self.p)
        losses = []
        total = epochs * -(-(length - 1) // WINDOW)
        for _ in range(epochs):
            h = np.zeros((streams, self.hidden), _F)
            for a in range(0, length - 1, WINDOW):
                b = min(a + WINDOW, length - 1)
                h, g, loss = self._window(h, rows[a:b], rows[a + 1 : b + 1])
                losses.append(loss)
                turn = adam.turn + 1
                adam.step(self.p, g, rate * min(1, turn / 20) * (1 - 0.9 * turn / total))
        return losses

    def learn(self, tokens: np.ndarray, adam: Adam, rate: float) -> None:
        """One pass over all of ``tokens``, at one rate after the first steps: each is a target once. A window with fewer
        targets than others has a smaller step. There are WIDE streams, fewer if each had under 64 windows."""
        inputs = np.concatenate([np.array([END], tokens.dtype), tokens[:-1]])
        streams = max(1, min(WIDE, len(tokens) // (64 * WINDOW)))
        full, length = streams * WINDOW, len(tokens) // streams
        for n, a, b in ((streams, 0, streams * length), (1, streams * length, len(tokens))):
            x, y = inputs[a:b].reshape(n, -1).T, tokens[a:b].reshape(n, -1).T
            h = np.zeros((n, self.hidden), _F)
            for t in range(0, len(x), WINDOW):
                wanted = y[t : t + WINDOW]
                h, g, _ = self._window(h, x[t : t + WINDOW], wanted)
                adam.step(self.p, g, rate * min(1, (adam.turn + 1) / 20) * wanted.size / full)

    def text_log_probabilities(self, tokens: np.ndarray, counts: np.ndarray, side: int = 2048, window: int = WINDOW) -> np.ndarray:
        """ln P of each whole text; ``tokens`` has the texts behind one another, ``counts`` their lengths. Texts of
        similar length run side by side, and the state is carried from window to window to the text's end."""
        out = np.zeros(len(counts))
        begin = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        for a in range(0, len(order), side):
            own = order[a : a + side]
            own = own[counts[own] > 0]
            if not len(own):
                continue
            size, at = counts[own], begin[own]
            h = np.zeros((len(own), self.hidden), _F)
            last = np.full(len(own), END)
            for t0 in range(0, int(size[0]), window):
                states, wanted, whose = [], [], []
                for t in range(t0, min(t0 + window, int(size[0]))):
                    n = int(np.searchsorted(-size, -t, "left"))  # texts longer than t come first
                    h = self.step(h[:n], last[:n])[0]
                    last = tokens[at[:n] + t]
                    states.append(h)
                    wanted.append(last)
                    whose.append(own[:n])
                found = self.log_probability(np.concatenate(states), np.concatenate(wanted))
                out += np.bincount(np.concatenate(whose), found, len(out))
        return out
