"""Averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy.

A word is the mean of the vectors of its character n-grams and of the whole word (all hashed into a fixed number of rows);
a bag of words is the mean of its words; a linear softmax gives the class. Vectors and softmax are learned together. A bag
is a whole text, or each run of `window` words of it: then a text is as much of class 1 as its highest run, and after the
first round only runs that the model itself finds stay positive examples. As the model is linear in the vectors,
scoring needs only each row's contribution to each class (`Model.parts`), of a fixed size.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np

ROWS = 1 << 18
DIM = 8
#: Words that a scorer remembers before it starts anew.
CACHE_WORDS = 250_000


def grams(word: str, rows: int, low: int = 3, high: int = 5) -> list[int]:
    """Rows of the whole word and of its n-grams, with marks at both ends."""
    s, crc = f"<{word}>", zlib.crc32
    if s.isascii():
        s = s.encode()
        return [crc(s) % rows, *[crc(s[i : i + n], n) % rows for n in range(low, min(high + 1, len(s))) for i in range(len(s) - n + 1)]]
    out = [crc(s.encode("utf-8", "surrogatepass")) % rows]
    for n in range(low, min(high + 1, len(s))):
        out += [crc(s[i : i + n].encode("utf-8", "surrogatepass"), n) % rows for i in range(len(s) - n + 1)]
    return out


def runs(n: int, window: int) -> np.ndarray:
    """Starts of the half-overlapping runs of `window` of `n` words; the last ends with the text."""
    return np.unique(np.append(np.arange(0, max(1, n - window + 1), window // 2), max(0, n - window)))


@dataclass
class Model:
    """`parts`: each row's contribution to each class; a bag's logits are their mean over its words, plus bias.

    A text's logits are those of its bag (or highest bag) times `slope` plus `shift` on the last class.
    """

    classes: list
    pattern: str
    parts: np.ndarray
    bias: np.ndarray
    window: int | None = None
    slope: float = 1.0
    shift: float = 0.0
    #: Confidence under which the operators reject; from held-back training rows.
    reject_below: float = 0.0

    def scorer(self) -> Scorer:
        """A new one, to go with its task: what a worker kept from task to task would add up."""
        return Scorer(self)


class Scorer(dict):
    """Class probabilities of texts; remembers words."""

    def __init__(self, model: Model):
        self.m, self.find = model, re.compile(model.pattern).findall
        self.known = np.zeros((1024, model.parts.shape[1]))

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        if i >= len(self.known):
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        rows = grams(word, len(self.m.parts))
        self.known[i] = self.m.parts.take(rows, axis=0).sum(axis=0) / len(rows)
        return i

    def logits(self, text: str | None) -> tuple[np.ndarray, int]:
        """Of the text before `slope` and `shift`, and its number of words."""
        if len(self) > CACHE_WORDS:
            self.clear()
        found = self.find((text or "").lower())
        n, w = len(found), self.m.window
        if not n:
            return self.m.bias.astype(np.float64), 0
        ids = np.fromiter(map(self.__getitem__, found), np.int64, n)
        values = self.known[ids]
        if w is None or n <= w:
            return values.mean(axis=0) + self.m.bias, n
        total, at = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)]), runs(n, w)
        bags = (total[at + w] - total[at]) / w
        return bags[np.argmax(bags[:, -1] - bags[:, 0])] + self.m.bias, n

    def __call__(self, text: str | None) -> tuple[np.ndarray, int]:
        """Probabilities, and the number of words."""
        z, n = self.logits(text)
        z = z * self.m.slope
        z[-1] += self.m.shift
        p = np.exp(z - z.max())
        return p / p.sum(), n


class _Words:
    """Words of the training texts by number, one text after the other, and each word's rows."""

    def __init__(self, texts: list[str], pattern: str, rows: int):
        find, numbers, of_word, docs = re.compile(pattern).findall, {}, [], []
        for t in texts:
            found = find((t or "").lower())
            for w in found:
                if w not in numbers:
                    numbers[w] = len(numbers)
                    of_word.append(np.array(grams(w, rows), dtype=np.int32))
            docs.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        self.tokens, self.n = np.concatenate(docs), np.array([len(d) for d in docs], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.n)[:-1]])
        self.size = np.array([len(g) for g in of_word], dtype=np.int64)
        self.flat, self.first = np.concatenate(of_word), np.concatenate([[0], np.cumsum(self.size)[:-1]])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, .. start + n - 1 of each."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class _State:
    """Vectors, softmax and their squared gradients."""

    def __init__(self, rows: int, dim: int, classes: int, rng: np.random.Generator, damp: float):
        self.E = (rng.random((rows, dim), dtype=np.float32) - 0.5) / dim
        self.W, self.b = rng.normal(0, 0.3, (dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
        self.E2, self.W2, self.b2 = np.full(rows, damp, np.float32), np.full_like(self.W, 1e-6), np.full_like(self.b, 1e-6)

    def step(self, words: _Words, start: np.ndarray, lens: np.ndarray, y: np.ndarray, lr: float, scale: float) -> None:
        """One batch of bags: runs of `lens` tokens from `start`."""
        k = len(start)
        uniq, inv = np.unique(words.tokens[_ranges(start, lens)], return_inverse=True)
        n = words.size[uniq]
        gram, at = words.flat[_ranges(words.first[uniq], n)], np.concatenate([[0], np.cumsum(n)[:-1]])
        vec = np.add.reduceat(self.E[gram], at, axis=0) / n[:, None].astype(np.float32)
        cell = np.repeat(np.arange(k) * len(uniq), lens) + inv
        A = np.bincount(cell, weights=np.repeat(1 / lens, lens), minlength=k * len(uniq)).reshape(k, len(uniq)).astype(np.float32)
        h = scale * (A @ vec)
        p = h @ self.W + self.b
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(k), y] -= 1
        p /= k
        dW, db = h.T @ p, p.sum(axis=0)
        each = np.repeat((A.T @ (p @ (scale * self.W.T))) / n[:, None].astype(np.float32), n, axis=0)
        o = np.argsort(gram, kind="stable")
        gram = gram[o]
        edge = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        row, g = gram[edge], np.add.reduceat(each[o], edge, axis=0)
        self.E2[row] += (g * g).mean(axis=1)
        self.E[row] -= lr * g / np.sqrt(self.E2[row])[:, None]
        self.W2 += dW * dW
        self.W -= lr * dW / np.sqrt(self.W2)
        self.b2 += db * db
        self.b -= lr * db / np.sqrt(self.b2)

    def fit(self, words: _Words, start: np.ndarray, lens: np.ndarray, y: np.ndarray, steps: int, batch: int, rate: float, scale: float, rng: np.random.Generator) -> None:
        order, at = rng.permutation(len(start)), 0
        for k in range(steps):
            if at >= len(order):
                order, at = rng.permutation(len(start)), 0
            part = order[at : at + batch]
            at += batch
            self.step(words, start[part], lens[part], y[part], rate * (1 - k / steps), scale)

    def margins(self, words: _Words, scale: float) -> np.ndarray:
        """What each word adds for class 1 over class 0, without bias."""
        direction = (self.W[:, 1] - self.W[:, 0]) * scale
        return np.add.reduceat((self.E @ direction)[words.flat], words.first) / words.size


def train(texts: list[str], labels: list, pattern: str, prior: dict | None = None, window: int | None = None, steps: int = 600, batch: int = 32, rate: float = 0.3, scale: float = 30.0, damp: float = 1e-7, rounds: int = 3, rows: int = ROWS, dim: int = DIM, seed: int = 7) -> Model:
    """Fit a model; a fifth of the texts is held back for `slope`, `shift` and the rejection threshold.

    `prior`: true shares of the classes where the rows were drawn otherwise. Without rows, words or a second class the
    model gives the only class there is (none: no class). `window` takes two classes.
    """
    classes = sorted(set(labels))
    k = len(classes)
    if k < 2 or not any(re.search(pattern, (t or "").lower()) for t in texts):
        return Model(classes, pattern, np.zeros((rows, max(1, k)), np.float32), np.zeros(max(1, k), np.float32))
    if window and k > 2:
        raise ValueError("runs of words take two classes")
    rng = np.random.default_rng(seed)
    y, words = np.array([classes.index(v) for v in labels], dtype=np.int64), _Words(texts, pattern, rows)
    order = rng.permutation(np.flatnonzero(words.n))
    kept = order[: len(order) // 5] if len(order) >= 50 else order
    fit = order[len(order) // 5 :] if len(order) >= 50 else order
    state = _State(rows, dim, k, rng, damp)
    if window is None:
        state.fit(words, words.begin[fit], words.n[fit], y[fit], steps, batch, rate, scale, rng)
    else:
        at = [runs(int(n), window) for n in words.n[fit]]
        of = np.repeat(fit, [len(a) for a in at])
        start = words.begin[of] + np.concatenate(at)
        lens = np.minimum(window, words.n[of])
        use = np.arange(len(start))
        for r in range(rounds):
            # as many steps as pass over the runs, between a half and twice `steps`
            n = int(np.clip(len(use) // batch, steps // 2, 2 * steps))
            state.fit(words, start[use], lens[use], y[of[use]], n, batch, rate / (1 + r), scale, rng)
            total = np.concatenate([[0.0], np.cumsum(state.margins(words, scale)[words.tokens].astype(np.float64))])
            score = (total[start + lens] - total[start]) / lens + state.b[1] - state.b[0]
            top = np.full(len(texts), -np.inf)
            np.maximum.at(top, of, score)
            hard = (y[of] == 0) & ((score > -4) | (rng.random(len(start)) < 0.5))
            use = np.flatnonzero(hard | (y[of] == 1) & ((score > 0) | (score >= top[of])))
    share = np.bincount(y, minlength=k) / len(y)
    b = state.b + (0 if not prior or window else np.log(np.array([max(prior.get(c, 0), 1e-9) for c in classes])) - np.log(share))
    model = Model(classes, pattern, (scale * (state.E @ state.W)).astype(np.float32), b.astype(np.float32), window)
    _calibrate(model, [texts[i] for i in kept], y[kept], prior and np.array([prior.get(c, 0) for c in classes]) / share)
    return model


def _calibrate(model: Model, texts: list[str], y: np.ndarray, weight: np.ndarray | None) -> None:
    """Set `slope` (and, with runs, `shift`) for the least loss, and the confidence from which 99 of 100 are right."""
    score = model.scorer()
    logits = np.array([score.logits(t)[0] for t in texts])
    w = (weight if weight is not None else np.ones(len(model.classes)))[y]

    def spread(slope: float, shift: float) -> np.ndarray:
        q = logits * slope
        q[:, -1] += shift
        q -= q.max(axis=1, keepdims=True)
        return q - np.log(np.exp(q).sum(axis=1, keepdims=True))

    shifts = np.linspace(-24, 24, 97) if model.window else [0.0]
    model.slope, model.shift = min(((a, c) for a in np.geomspace(0.1, 4, 23) for c in shifts), key=lambda x: -float((w * spread(*x)[np.arange(len(y)), y]).sum()))
    p = np.exp(spread(model.slope, model.shift))
    right, conf = p.argmax(axis=1) == y, p.max(axis=1)
    order = np.argsort(-conf, kind="stable")
    ok = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= 0.99)
    model.reject_below = float(conf[order][ok[-1]]) if len(ok) else 1.0
