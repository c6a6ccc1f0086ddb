"""A character tagger in numpy: a bidirectional LSTM with a CRF over its scores, trained from labelled spans.

All texts of a batch have the same length. Tags are 0 (outside) and, for each kind, one for its first character and one for the
others; transitions that no labelling can have are ruled out.
"""

from __future__ import annotations

import numpy as np

#: Characters are told apart as far as spans need it: digits and marks each by itself, letters by case, all else by class.
MARKS = "@.+-_%()/: ,\n"
ALPHABET = len(MARKS) + 5
#: Sizes: of a character's vector and of the state of each direction.
EMBEDDED, HIDDEN = 8, 12
NEVER = -1e4


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; 0 is padding."""
    table = np.full(256, 1, np.int64)
    for k in range(128):
        c = chr(k)
        table[k] = 2 if c.isdigit() else 3 if c.isupper() else 4 if c.islower() else MARKS.index(c) + 5 if c in MARKS else 1
    out = table[np.minimum(codes, 255)]
    return np.where(codes > 127, 4, out)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    def __init__(self, kinds: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.kinds, tags = kinds, 2 * kinds + 1
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.weights = {"embed": rng.normal(0, 0.5, (ALPHABET, EMBEDDED)).astype(np.float32), "out": scale(2 * HIDDEN, tags),
                        "bias": np.zeros(tags, np.float32), "moves": np.zeros((tags, tags), np.float32)}
        for side in "fb":
            self.weights |= {f"x{side}": scale(EMBEDDED, 4 * HIDDEN), f"h{side}": scale(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
        allowed = np.ones((tags, tags), bool)
        for k in range(kinds):
            allowed[:, 2 * k + 2] = False
            allowed[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
        self.barrier = np.where(allowed, 0, NEVER).astype(np.float32)

    def _direction(self, seen: np.ndarray, side: str, keep: bool):
        """States over time (time, batch, HIDDEN) and, for training, what each step had."""
        w = self.weights
        inputs = seen @ w[f"x{side}"] + w[f"c{side}"]
        time, batch = seen.shape[:2]
        h = c = np.zeros((batch, HIDDEN), np.float32)
        states, steps = np.empty((time, batch, HIDDEN), np.float32), []
        for t in range(time) if side == "f" else range(time - 1, -1, -1):
            z = inputs[t] + h @ w[f"h{side}"]
            gates, new = _sigmoid(z[:, :3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN:])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            before, held = c, h
            c = f * c + i * new
            tanh = np.tanh(c)
            h = o * tanh
            states[t] = h
            if keep:
                steps.append((t, i, f, o, new, before, held, tanh))
        return states, steps

    def scores(self, symbols: np.ndarray, keep: bool = False):
        """Scores (time, batch, tags) of symbols (batch, time)."""
        seen = self.weights["embed"][symbols.T]
        (forward, fs), (backward, bs) = (self._direction(seen, side, keep) for side in "fb")
        states = np.concatenate([forward, backward], 2)
        out = states @ self.weights["out"] + self.weights["bias"]
        return (out, (seen, states, fs, bs)) if keep else out

    def _back(self, slope: np.ndarray, steps: list, side: str, seen: np.ndarray, grads: dict) -> np.ndarray:
        w = self.weights
        to_seen = np.zeros_like(seen)
        dh = dc = np.zeros_like(slope[0])
        for t, i, f, o, new, before, held, tanh in reversed(steps):
            dh = dh + slope[t]
            dc = dc + dh * o * (1 - tanh * tanh)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tanh * o * (1 - o), dc * i * (1 - new * new)], 1)
            grads[f"h{side}"] += held.T @ dz
            grads[f"x{side}"] += seen[t].T @ dz
            grads[f"c{side}"] += dz.sum(0)
            to_seen[t] = dz @ w[f"x{side}"].T
            dh, dc = dz @ w[f"h{side}"].T, dc * f
        return to_seen

    def loss(self, symbols: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood per text, and its gradient; all characters count, padding too (as outside)."""
        emit, (seen, states, fs, bs) = self.scores(symbols, keep=True)
        moves = self.weights["moves"] + self.barrier
        time, batch, n = emit.shape
        gold = tags.T
        alpha = np.empty((time, batch, n))
        alpha[0] = emit[0]
        for t in range(1, time):
            x = alpha[t - 1][:, :, None] + moves
            top = x.max(1)
            alpha[t] = emit[t] + top + np.log(np.exp(x - top[:, None]).sum(1))
        top = alpha[-1].max(1)
        total = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        beta = np.zeros((batch, n))
        share, pairs = np.empty_like(emit), np.zeros((n, n))
        for t in range(time - 1, -1, -1):
            share[t] = np.exp(alpha[t] + beta - total[:, None])
            if t:
                ahead = emit[t] + beta
                pairs += np.exp(alpha[t - 1][:, :, None] + moves + ahead[:, None] - total[:, None, None]).sum(0)
                x = moves + ahead[:, None]
                top = x.max(2)
                beta = top + np.log(np.exp(x - top[:, :, None]).sum(2))
        one = np.eye(n, dtype=np.float32)
        path = (emit * one[gold]).sum() + moves[gold[:-1], gold[1:]].sum()
        np.subtract.at(pairs, (gold[:-1].ravel(), gold[1:].ravel()), 1)
        slope = ((share - one[gold]) / batch).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        grads["moves"] = (pairs / batch).astype(np.float32)
        grads["out"] = np.einsum("tbh,tbn->hn", states, slope)
        grads["bias"] = slope.sum((0, 1))
        down = slope @ self.weights["out"].T
        to_seen = self._back(down[:, :, :HIDDEN], fs, "f", seen, grads) + self._back(down[:, :, HIDDEN:], bs, "b", seen, grads)
        np.add.at(grads["embed"], symbols.T, to_seen)
        return float((total.sum() - path) / batch), grads

    def train(self, symbols: np.ndarray, tags: np.ndarray, rounds: int, batch: int = 64, rate: float = 0.02, seed: int = 5) -> list[float]:
        """Adam over random batches; the loss of each round is returned."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.weights.items()} for _ in range(2))
        losses, step = [], 0
        for _ in range(rounds):
            order, sums = rng.permutation(len(symbols)), []
            for begin in range(0, len(order), batch):
                rows = order[begin:begin + batch]
                loss, grads = self.loss(symbols[rows], tags[rows])
                sums.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.01 * (g * g - v[k])
                    self.weights[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
            losses.append(float(np.mean(sums)))
        return losses

    def decode(self, symbols: np.ndarray) -> np.ndarray:
        """The best tags (batch, time) of symbols (batch, time)."""
        emit = self.scores(symbols)
        moves = self.weights["moves"] + self.barrier
        time, batch, n = emit.shape
        best, back = emit[0], np.empty((time, batch, n), np.int8)
        for t in range(1, time):
            x = best[:, :, None] + moves
            back[t] = x.argmax(1)
            best = emit[t] + x.max(1)
        out = np.empty((batch, time), np.int8)
        out[:, -1] = best.argmax(1)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = np.take_along_axis(back[t], out[:, t, None].astype(np.int64), 1)[:, 0]
        return out
