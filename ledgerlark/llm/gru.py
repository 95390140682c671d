"""A gated recurrent language model in numpy: truncated backpropagation through time, class-factored output softmax, many texts side by side.

Words have numbers: the first ``CLASSES * WIDTH`` are the known ones, ``WIDTH`` to a class; those beyond stand for whole classes of other words. A word's probability is that of its class, given the state, times its
own within its class. Texts are laid end to end in lanes of nearly equal length; a lane's state is carried from window to window and cleared where a text begins, so a text's probability is that of the whole
text, however long. What is held besides the lanes is one window.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, CLASSES, WIDTH, OTHERS = 24, 32, 64, 64
WORDS = CLASSES * WIDTH
#: The input before a text's first word.
BEGIN = WORDS + OTHERS
STEPS, LANES, TRAIN_STEPS, TRAIN_LANES = 32, 256, 16, 64
RATE, START, SEED = 0.12, 1e-4, 13
#: A logarithm that stands for a word that doesn't exist.
NEVER = -30.0

#: A state has a one beside it, so that a bias is one more weight.
SHAPES = {"gates": (BEGIN + 1, 3 * HIDDEN), "recur": (HIDDEN, 3 * HIDDEN), "bias": (3 * HIDDEN,), "class_weights": (HIDDEN + 1, CLASSES + OTHERS), "word_weights": (CLASSES, WIDTH, HIDDEN + 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters within one array of ``SIZE`` numbers."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    words = out["word_weights"].reshape(WORDS, HIDDEN + 1)
    return out | {"to_class": out["class_weights"][:HIDDEN], "class_bias": out["class_weights"][HIDDEN], "to_word": words[:, :HIDDEN], "word_bias": words[:, HIDDEN]}


def initial(word_counts: np.ndarray, other_counts: np.ndarray) -> np.ndarray:
    """Parameters with which every word has about its share of the counts, whatever the state. A count below 0 marks a word that doesn't exist."""
    r = np.random.default_rng(SEED)
    flat = np.zeros(SIZE, dtype=np.float32)
    p = views(flat)
    p["gates"][:] = r.normal(0, 0.3, p["gates"].shape)
    p["recur"][:] = r.normal(0, 0.8 / np.sqrt(HIDDEN), p["recur"].shape)
    p["bias"][:HIDDEN] = 1.0  # to begin with, a state lasts
    p["to_class"][:] = r.normal(0, 0.02, p["to_class"].shape)
    p["to_word"][:] = r.normal(0, 0.02, p["to_word"].shape)
    there = word_counts >= 0
    p["word_bias"][:] = np.where(there, np.log(np.maximum(word_counts, 0) + 0.5), NEVER)
    mass = np.where(there, word_counts + 0.5, 0).reshape(CLASSES, WIDTH).sum(axis=1)
    p["class_bias"][:] = np.log(np.maximum(np.concatenate((mass, other_counts + 0.5)), np.exp(NEVER)))
    p["class_bias"] -= p["class_bias"].max()
    p["word_bias"] -= np.where(there, np.repeat(p["word_bias"].reshape(CLASSES, WIDTH).max(axis=1), WIDTH), 0)
    return flat


class Lanes:
    """Texts (``first[i]:first[i + 1]`` of the word numbers) end to end in lanes, the fullest lane first, window by window."""

    def __init__(self, words: np.ndarray, first: np.ndarray, lanes: int, steps: int):
        sizes = np.diff(first)
        loads, own = [(0, k) for k in range(min(lanes, len(sizes)))], [[] for _ in range(min(lanes, len(sizes)))]
        for i in np.argsort(-sizes, kind="stable"):
            load, k = heapq.heappop(loads)
            own[k].append(i)
            heapq.heappush(loads, (load + int(sizes[i]), k))
        order = sorted(range(len(own)), key=lambda k: -sum(int(sizes[i]) for i in own[k]))
        texts = np.array([i for k in order for i in own[k]], dtype=np.int64)
        n = sizes[texts]
        ends = np.cumsum(n)
        at = np.repeat(first[texts] - (ends - n), n) + np.arange(int(n.sum()))
        self.text, self.target = np.repeat(texts, n), words[at]
        self.begins = np.zeros(len(at), dtype=bool)
        self.begins[ends - n] = True
        self.input = np.concatenate(([BEGIN], self.target[:-1]))
        self.input[self.begins] = BEGIN
        self.size = np.array([sum(int(sizes[i]) for i in own[k]) for k in order], dtype=np.int64)
        self.start, self.steps = np.concatenate(([0], np.cumsum(self.size)[:-1])).astype(np.int64), steps

    def windows(self):
        """(places, valid), both steps by lanes; a window has the lanes that reach it."""
        for t in range(0, int(self.size.max(initial=0)), self.steps):
            n = int(np.searchsorted(-self.size, -t))
            step = t + np.arange(min(self.steps, int(self.size[0]) - t))[:, None]
            valid = step < self.size[:n]
            yield np.where(valid, self.start[:n] + step, 0), valid


def run(p: dict[str, np.ndarray], x: np.ndarray, begins: np.ndarray, h: np.ndarray, trace: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The states after each step, and the last. ``trace``: what ``back`` needs of each step."""
    gates, keep, cleared = p["gates"].take(x, axis=0), (~begins).astype(np.float32)[:, :, None], begins.any(axis=1)
    gates += p["bias"]
    states = np.empty((*x.shape, HIDDEN), dtype=np.float32)
    for t in range(len(x)):
        h = h * keep[t] if cleared[t] else h
        g, u = gates[t], h @ p["recur"]
        zr = g[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r, un = zr[:, :HIDDEN], zr[:, HIDDEN:], u[:, 2 * HIDDEN :]
        n = r * un
        n += g[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if trace is not None:
            trace.append((h, z, r, un, n, keep[t]))
        new = np.subtract(h, n, out=states[t])
        new *= z
        new += n
        h = new
    return states, h


def _shares(logits: np.ndarray, at: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """The logarithm of the wanted entry's share of its row, and the rows' sums; ``logits`` become their exponentials. Unless they are ``bounded``, a row's largest is taken off first, so that no sum overflows or vanishes."""
    if not bounded:
        logits -= logits.max(axis=1, keepdims=True)
    wanted = logits.reshape(-1).take(at)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], dtype=np.float32)
    return wanted - np.log(total), total


def outputs(p: dict[str, np.ndarray], states: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The natural logarithm of each target's probability; with ``grads``, which are filled, also the gradient of their mean loss by the states."""
    n, known = len(y), y < WORDS
    ones = np.empty((n, HIDDEN + 1), dtype=np.float32)
    ones[:, :HIDDEN], ones[:, HIDDEN] = states, 1
    cls = np.where(known, y // WIDTH, CLASSES + y - WORDS)
    largest = max(np.abs(p["class_weights"]).sum(axis=0).max(), np.abs(p["word_weights"]).sum(axis=2).max())  # of a logit, as a state is within -1 and 1
    bounded = largest < 60
    logits = ones @ p["class_weights"]
    at_class = np.arange(n) * logits.shape[1] + cls
    out, total = _shares(logits, at_class, bounded)
    d = None
    if grads is not None:
        logits *= (1 / (n * total))[:, None]
        logits.reshape(-1)[at_class] -= np.float32(1 / n)
        weights = ones.T @ logits
        grads["to_class"], grads["class_bias"], grads["class_weights"] = weights[:HIDDEN], weights[HIDDEN], weights
        d = logits @ p["class_weights"].T
    at = np.flatnonzero(known)
    at = at[np.argsort(cls[at], kind="stable")]
    edges = np.searchsorted(cls[at], np.arange(CLASSES + 1))
    parts = [(c, edges[c], edges[c + 1]) for c in np.flatnonzero(np.diff(edges))]
    own, logits = ones[at], np.empty((len(at), WIDTH), dtype=np.float32)
    for c, a, b in parts:
        np.matmul(own[a:b], p["word_weights"][c].T, out=logits[a:b])
    at_word = np.arange(len(at)) * WIDTH + y[at] % WIDTH
    found, total = _shares(logits, at_word, bounded)
    out = out.astype(np.float64)
    out[at] += found
    if grads is not None:
        logits *= (1 / (n * total))[:, None]
        logits.reshape(-1)[at_word] -= np.float32(1 / n)
        back_, weights = np.empty_like(own), np.empty((len(parts), WIDTH, HIDDEN + 1), dtype=np.float32)
        for k, (c, a, b) in enumerate(parts):
            np.matmul(logits[a:b].T, own[a:b], out=weights[k])
            np.matmul(logits[a:b], p["word_weights"][c], out=back_[a:b])
        d[at] += back_
        grads["classes"], grads["word_weights"] = [c for c, *_ in parts], weights
        grads["words"] = [(slice(c * WIDTH, (c + 1) * WIDTH), w[:, :HIDDEN], w[:, HIDDEN]) for (c, *_), w in zip(parts, weights)]
        d = d[:, :HIDDEN]
    return out, d


def back(p: dict[str, np.ndarray], x: np.ndarray, d: np.ndarray, trace: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The gradients of gates (by step and lane) and recur; the window's start is where they end."""
    d_gates, d_recur = np.empty((*x.shape, 3 * HIDDEN), dtype=np.float32), np.zeros_like(p["recur"])
    dh = np.zeros_like(d[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, un, n, keep = trace[t]
        dh = dh + d[t]
        dn = dh * (1 - z) * (1 - n * n)
        g = d_gates[t]
        g[:, :HIDDEN] = dh * (h - n) * z * (1 - z)
        g[:, HIDDEN : 2 * HIDDEN] = dn * un * r * (1 - r)
        g[:, 2 * HIDDEN :] = dn
        u = g.copy()
        u[:, 2 * HIDDEN :] *= r
        d_recur += h.T @ u
        dh = (dh * z + u @ p["recur"].T) * keep
    return d_gates, d_recur


class Trainer:
    """Adagrad from given parameters."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.p, self.seen = views(self.flat), views(np.full(SIZE, START, dtype=np.float32))
        self.words = 0

    def _move(self, name: str, at, g: np.ndarray) -> None:
        seen = self.seen[name][at] + g * g
        self.seen[name][at] = seen
        self.p[name][at] -= RATE * g / np.sqrt(seen)

    def learn(self, words: np.ndarray, first: np.ndarray) -> None:
        lanes = Lanes(words, first, TRAIN_LANES, TRAIN_STEPS)
        h = np.zeros((len(lanes.size), HIDDEN), dtype=np.float32)
        with np.errstate(over="ignore"):
            for places, valid in lanes.windows():
                x, trace, grads = lanes.input[places], [], {}
                states, last = run(self.p, x, lanes.begins[places], h[: x.shape[1]], trace)
                d = np.zeros_like(states)
                _, d[valid] = outputs(self.p, states[valid], lanes.target[places[valid]], grads)
                d_gates, d_recur = back(self.p, x, d, trace)
                flat_x, flat_g = x[valid], d_gates[valid]
                order = np.argsort(flat_x, kind="stable")
                heads = np.flatnonzero(np.concatenate(([True], flat_x[order][1:] != flat_x[order][:-1])))
                self._move("gates", flat_x[order][heads], np.add.reduceat(flat_g[order], heads))
                self._move("recur", slice(None), d_recur)
                self._move("bias", slice(None), flat_g.sum(axis=0))
                self._move("class_weights", slice(None), grads["class_weights"])
                self._move("word_weights", grads["classes"], grads["word_weights"])
                h = last
        self.words += len(words)


def log10_probabilities(p: dict[str, np.ndarray], words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The base-ten logarithm of each text's probability: the sum over its words of that of a known word, or of another word's class."""
    lanes = Lanes(words, first, LANES, STEPS)
    h = np.zeros((len(lanes.size), HIDDEN), dtype=np.float32)
    out = np.zeros(len(first) - 1)
    with np.errstate(over="ignore"):
        for places, valid in lanes.windows():
            states, h = run(p, lanes.input[places], lanes.begins[places], h[: places.shape[1]])
            at = places[valid]
            out += np.bincount(lanes.text[at], outputs(p, states[valid], lanes.target[at])[0], minlength=len(out))
    return out / np.log(10)
