"""A gated recurrent model over classes, in numpy, with truncated backpropagation."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

HIDDEN = 16
STREAMS = 256
STEPS = 32
NAMES = ("input", "recurrent", "bias", "output", "output_bias")
LN10 = float(np.log(10))


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def tanh(x: np.ndarray) -> np.ndarray:
    return 2 * sigmoid(2 * x) - 1


@dataclass
class Gru:
    """Weights: a row of ``input`` per class, and one for the start of a text.

    Update gate z, reset gate r and candidate n as usual; the state h becomes
    (1 - z) n + z h, and a softmax over ``output`` gives the next class.
    """

    input: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    output: np.ndarray
    output_bias: np.ndarray

    @classmethod
    def start(cls, shares: np.ndarray, hidden: int = HIDDEN, seed: int = 7, kind=np.float32) -> Gru:
        """Small random weights; the output starts from how frequent the classes are."""
        rnd, classes = np.random.default_rng(seed), len(shares)

        def small(*shape):
            return rnd.normal(0, 0.3 / hidden**0.5, shape).astype(kind)

        smooth = (shares + 1e-6) / (shares + 1e-6).sum()
        return cls(
            small(classes + 1, 3 * hidden),
            small(hidden, 3 * hidden),
            np.zeros(3 * hidden, kind),
            small(hidden, classes),
            np.log(smooth).astype(kind),
        )

    @property
    def hidden(self) -> int:
        return len(self.recurrent)

    @property
    def classes(self) -> int:
        return len(self.output_bias)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in NAMES])

    def filled(self, flat: np.ndarray) -> Gru:
        made, at = [], 0
        for n in NAMES:
            own = getattr(self, n)
            made.append(flat[at : at + own.size].reshape(own.shape).astype(own.dtype))
            at += own.size
        return Gru(*made)

    def forward(self, x: np.ndarray, keep: np.ndarray, state: np.ndarray):
        """States after each step of a window; x and keep are (steps, streams).

        ``keep`` is 0 where a text starts, which clears the state that came before.
        """
        steps, streams = x.shape
        h = self.hidden
        given = self.input[x]
        given += self.bias
        before = np.empty((steps, streams, h), state.dtype)
        gates = np.empty((steps, streams, 2 * h), state.dtype)
        inner = np.empty_like(before)
        new = np.empty_like(before)
        after = np.empty_like(before)
        for t in range(steps):
            np.multiply(state, keep[t][:, None], out=before[t])
            both = before[t] @ self.recurrent
            gates[t] = sigmoid(given[t, :, : 2 * h] + both[:, : 2 * h])
            inner[t] = both[:, 2 * h :]
            z, r = gates[t, :, :h], gates[t, :, h:]
            new[t] = tanh(given[t, :, 2 * h :] + r * inner[t])
            np.subtract(before[t], new[t], out=after[t])
            after[t] *= z
            after[t] += new[t]
            state = after[t]
        return before, gates, inner, new, after

    def shares(self, states: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes by state (rows), and the logarithm of each target's."""
        logits = states @ self.output
        logits += self.output_bias
        logits -= logits.max(axis=1, keepdims=True)
        own = logits[np.arange(len(target)), target]
        np.exp(logits, out=logits)
        total = logits.sum(axis=1)
        logits /= total[:, None]
        return logits, own - np.log(total)

    def gradient(self, x, y, keep, weight, state):
        """Loss (nats), gradient over one window, and the state to go on with.

        Backpropagation stops at the window's first step.
        """
        steps, streams = x.shape
        h, kind = self.hidden, state.dtype
        before, gates, inner, new, after = self.forward(x, keep, state)
        flat = after.reshape(-1, h)
        target, scale = y.ravel(), weight.ravel()
        wrong, logs = self.shares(flat, target)
        loss = float(-(logs * scale).sum())
        wrong[np.arange(len(target)), target] -= 1
        wrong *= scale[:, None]
        d_output, d_output_bias = flat.T @ wrong, wrong.sum(axis=0)
        d_states = (wrong @ self.output.T).reshape(steps, streams, h)
        given = np.empty((steps, streams, 3 * h), kind)
        mixed = np.empty((steps, streams, 3 * h), kind)
        back = np.zeros((streams, h), kind)
        turned = self.recurrent.T.copy()
        for t in range(steps - 1, -1, -1):
            d = d_states[t] + back
            z, r, n = gates[t, :, :h], gates[t, :, h:], new[t]
            d_new = d * (1 - z) * (1 - n * n)
            given[t, :, :h] = d * (before[t] - n) * z * (1 - z)
            given[t, :, h : 2 * h] = d_new * inner[t] * r * (1 - r)
            given[t, :, 2 * h :] = d_new
            mixed[t, :, : 2 * h] = given[t, :, : 2 * h]
            mixed[t, :, 2 * h :] = d_new * r
            back = (d * z + mixed[t] @ turned) * keep[t][:, None]
        rows = given.reshape(-1, 3 * h)
        d_recurrent = before.reshape(-1, h).T @ mixed.reshape(-1, 3 * h)
        # Rows of the input table are summed by class.
        order = np.argsort(x.ravel(), kind="stable")
        classes = x.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
        d_input = np.zeros_like(self.input)
        d_input[classes[first]] = np.add.reduceat(rows[order], first, axis=0)
        return loss, Gru(d_input, d_recurrent, rows.sum(axis=0), d_output, d_output_bias), after[-1]


class Adam:
    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.mean, self.square = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def step(self, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.mean += 0.1 * (gradient - self.mean)
        self.square += 0.01 * (gradient * gradient - self.square)
        mean = self.mean / (1 - 0.9**self.t)
        square = self.square / (1 - 0.99**self.t)
        return value - self.rate * mean / (np.sqrt(square) + 1e-8)


@dataclass
class Streams:
    """Whole texts side by side: each stream reads its texts one after the other.

    ``x`` is the class before, ``y`` the class to come, ``text`` the number of the
    text, all (steps, streams); ``keep`` is 0 at the first token of a text, ``weight``
    0 where a stream has ended.
    """

    x: np.ndarray
    y: np.ndarray
    keep: np.ndarray
    weight: np.ndarray
    text: np.ndarray


def lined_up(texts: list[np.ndarray], classes: int, streams: int = STREAMS) -> Streams:
    """Long texts first, each to the stream that is shortest so far.

    There are no more streams than the longest text leaves work for, so what is laid
    out grows with the tokens, whatever the lengths.
    """
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    total = sum(map(len, texts))
    lanes: list[list[int]] = [[] for _ in range(max(1, min(streams, total // len(texts[order[0]]))))]
    loads = [(0, k) for k in range(len(lanes))]
    for i in order:
        load, k = heapq.heappop(loads)
        lanes[k].append(i)
        heapq.heappush(loads, (load + len(texts[i]), k))
    steps = max(load for load, _ in loads)
    shape = (len(lanes), steps)
    x, y = np.full(shape, classes, np.int16), np.zeros(shape, np.int16)
    keep, weight = np.ones(shape, np.float32), np.zeros(shape, np.float32)
    text = np.zeros(shape, np.int32)
    for k, lane in enumerate(lanes):
        at = 0
        for i in lane:
            n = len(texts[i])
            y[k, at : at + n] = texts[i]
            x[k, at + 1 : at + n] = texts[i][:-1]
            keep[k, at], weight[k, at : at + n], text[k, at : at + n] = 0, 1, i
            at += n
    return Streams(*(np.ascontiguousarray(a.T) for a in (x, y, keep, weight, text)))


def train(model: Gru, texts: list[np.ndarray], optimiser: Adam, steps: int = STEPS) -> tuple[Gru, float]:
    """One pass over the texts, an update per window; the state goes on across windows."""
    lines = lined_up(texts, model.classes)
    state = np.zeros((lines.x.shape[1], model.hidden), model.recurrent.dtype)
    total, value = 0.0, model.flat()
    for at in range(0, len(lines.x), steps):
        cut = slice(at, at + steps)
        weight = lines.weight[cut]
        n = weight.sum()
        loss, gradient, state = model.gradient(
            lines.x[cut], lines.y[cut], lines.keep[cut], weight / n, state
        )
        total += loss * float(n)
        slope = gradient.flat()
        size = float(np.sqrt((slope * slope).sum()))
        value = optimiser.step(value, slope * min(1.0, 1.0 / max(size, 1e-9)))
        model = model.filled(value)
    return model, total


def log10_likelihoods(model: Gru, texts: list[np.ndarray], steps: int = 4 * STEPS) -> np.ndarray:
    """Sum over each whole text; the state goes on across windows until the text ends."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    lines = lined_up(texts, model.classes)
    state = np.zeros((lines.x.shape[1], model.hidden), model.recurrent.dtype)
    for at in range(0, len(lines.x), steps):
        cut = slice(at, at + steps)
        after = model.forward(lines.x[cut], lines.keep[cut], state)[-1]
        state = after[-1]
        target, text = lines.y[cut].ravel(), lines.text[cut].ravel()
        good = lines.weight[cut].ravel() > 0
        logs = model.shares(after.reshape(-1, model.hidden)[good], target[good])[1]
        out += np.bincount(text[good], logs, len(texts))
    return out / LN10
