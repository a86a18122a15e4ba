"""A small gated recurrent language model in numpy: windows of many texts side by side, forwards and backwards.

Tokens are numbers. The first `words` of them are words of their own, `size` to a class; every number after them
is a class without own words, of which only the class is predicted here. A step from state h, after token x:

    z, r = sigmoid(E[x] + h U)        n = tanh(E[x] + r * (h U + b))        h' = (1 - z) n + z h

and a token's probability is that of its class, softmax(h' C + c), times that of the word in its class,
softmax(h' W[class] + w[class]).
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np


@dataclass
class Weights:
    embed: np.ndarray  # tokens, 3 * state: what a token adds to the gates z, r and n
    recur: np.ndarray  # state, 3 * state
    inner: np.ndarray  # state: the bias inside the reset
    to_class: np.ndarray  # state, classes
    class_bias: np.ndarray
    to_word: np.ndarray  # classes with words, state, size
    word_bias: np.ndarray  # classes with words, size

    @property
    def state(self) -> int:
        return len(self.inner)

    @property
    def size(self) -> int:
        return self.word_bias.shape[1]

    @property
    def words(self) -> int:
        return self.word_bias.size

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def copy(self) -> Weights:
        return Weights(*(a.copy() for a in self.arrays()))

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def from_flat(self, flat: np.ndarray) -> Weights:
        """Weights of the same shapes from one array."""
        out, start = [], 0
        for a in self.arrays():
            out.append(flat[start : start + a.size].reshape(a.shape).astype(a.dtype))
            start += a.size
        return Weights(*out)


def initial(counts: np.ndarray, words: int, size: int, state: int, seed: int = 13) -> Weights:
    """Small random weights whose output is the frequency of the tokens, whatever the state.

    counts: of every token; words is a multiple of size.
    """
    rng = np.random.default_rng(seed)
    some = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    counts = counts.astype(np.float64) + 0.1
    inside = counts[:words].reshape(-1, size)
    classes = np.concatenate([inside.sum(axis=1), counts[words:]])
    return Weights(
        some(len(counts), 3 * state),
        (rng.standard_normal((state, 3 * state)) / np.sqrt(state)).astype(np.float32),
        np.zeros(state, np.float32),
        some(state, len(classes)) * np.float32(0.1),
        np.log(classes / classes.sum()).astype(np.float32),
        some(len(inside), state, size) * np.float32(0.1),
        np.log(inside / inside.sum(axis=1, keepdims=True)).astype(np.float32),
    )


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


#: Logits beyond this are shifted before they are exponentiated.
_LARGE = 50.0


def _sums(logits: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Wanted logits less the logarithms of the sums, and the sums; the logits become their exponentials, in place."""
    if len(logits) and (logits.max() > _LARGE or logits.min() < -_LARGE):
        logits -= logits.max(axis=1, keepdims=True)
    out = logits[np.arange(len(wanted)), wanted].astype(np.float64)
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return out - np.log(sums), sums


def _shares(logits: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Natural logarithms of the shares of the wanted columns; the logits become the shares, in place."""
    out, sums = _sums(logits, wanted)
    logits /= sums[:, None]
    return out


def _states(w: Weights, tokens: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """The states after each step of a window; (gates and states before) too, to go back."""
    steps, lanes = tokens.shape
    n = w.state
    given = w.embed[tokens]
    states = np.empty((steps, lanes, n), np.float32)
    kept = []
    for t in range(steps):
        if fresh[t].any():
            h = np.where(fresh[t][:, None], np.float32(0), h)
        inner = h @ w.recur
        gates = _sigmoid(given[t, :, : 2 * n] + inner[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        held = inner[:, 2 * n :] + w.inner
        new = r * held
        new += given[t, :, 2 * n :]
        np.tanh(new, out=new)
        if keep:
            kept.append((h, z, r, held, new))
        h = new + z * (h - new)
        states[t] = h
    return states, kept


def _classes(w: Weights, targets: np.ndarray) -> np.ndarray:
    """The class of each token."""
    own = w.words // w.size
    return np.where(targets < w.words, targets // w.size, targets - w.words + own)


def log_likelihood(w: Weights, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms of the probabilities of the targets, and the last states.

    tokens, targets, fresh: (steps, lanes); fresh tells where a text begins and the state with it.
    """
    states, _ = _states(w, tokens, fresh, h, keep=False)
    flat, wanted = states.reshape(-1, w.state), targets.ravel()
    kinds = _classes(w, wanted)
    logits = flat @ w.to_class
    logits += w.class_bias
    out, _ = _sums(logits, kinds)
    for at, kind in _by_class(w, wanted, kinds):
        logits = flat[at] @ w.to_word[kind]
        logits += w.word_bias[kind]
        out[at] += _sums(logits, wanted[at] - kind * w.size)[0]
    return out.reshape(targets.shape), states[-1]


def _by_class(w: Weights, targets: np.ndarray, kinds: np.ndarray):
    """Positions of the words of each class that has words of its own."""
    own = np.flatnonzero(targets < w.words)
    if not len(own):
        return
    order = own[np.argsort(kinds[own], kind="stable")]
    starts = np.flatnonzero(np.diff(kinds[order], prepend=-1))
    for start, stop in zip(starts, np.append(starts[1:], len(order)), strict=True):
        yield order[start:stop], int(kinds[order[start]])


def gradients(
    w: Weights, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray
) -> tuple[float, Weights, np.ndarray, np.ndarray]:
    """Summed loss, gradients of it, the last states, and the tokens whose embeddings have a gradient.

    Only valid places count. Nothing flows back beyond the window. The gradient of `embed` has a row for each of
    these tokens only.
    """
    states, kept = _states(w, tokens, fresh, h, keep=True)
    steps, lanes = tokens.shape
    n = w.state
    flat, wanted = states.reshape(-1, n), targets.ravel()
    kinds, counted = _classes(w, wanted), valid.ravel()
    d = flat @ w.to_class
    d += w.class_bias
    loss = -_shares(d, kinds)[counted].sum()
    d[np.arange(len(wanted)), kinds] -= 1
    if not counted.all():
        d[~counted] = 0
    to_class, class_bias = flat.T @ d, d.sum(axis=0)
    back = d @ w.to_class.T
    to_word, word_bias = np.zeros_like(w.to_word), np.zeros_like(w.word_bias)
    for at, kind in _by_class(w, np.where(counted, wanted, w.words), kinds):
        here = flat[at]
        d = here @ w.to_word[kind]
        d += w.word_bias[kind]
        word = wanted[at] - kind * w.size
        loss -= _shares(d, word).sum()
        d[np.arange(len(at)), word] -= 1
        to_word[kind], word_bias[kind] = here.T @ d, d.sum(axis=0)
        back[at] += d @ w.to_word[kind].T
    back = back.reshape(steps, lanes, n)

    given = np.empty((steps, lanes, 3 * n), np.float32)
    recur, inner = np.zeros_like(w.recur), np.zeros_like(w.inner)
    later = np.zeros((lanes, n), np.float32)
    turned = np.ascontiguousarray(w.recur.T)
    for t in reversed(range(steps)):
        before, z, r, held, new = kept[t]
        dh = back[t] + later
        dnew = dh * (1 - z) * (1 - new * new)
        dheld = dnew * r
        d = given[t]
        d[:, :n] = dh * (before - new) * z * (1 - z)
        d[:, n : 2 * n] = dnew * held * r * (1 - r)
        d[:, 2 * n :] = dnew
        inside = np.concatenate([d[:, : 2 * n], dheld], axis=1)
        recur += before.T @ inside
        inner += dheld.sum(axis=0)
        later = dh * z + inside @ turned
        if fresh[t].any():
            later[fresh[t]] = 0
    flat_tokens = tokens.ravel()
    order = np.argsort(flat_tokens, kind="stable")
    starts = np.flatnonzero(np.diff(flat_tokens[order], prepend=-1))
    embed = np.add.reduceat(given.reshape(-1, 3 * n)[order], starts, axis=0)
    seen = flat_tokens[order[starts]]
    return loss, Weights(embed, recur, inner, to_class, class_bias, to_word, word_bias), states[-1], seen


class Learner:
    """Adagrad steps on copies of the weights; gradients are per token and cut to a length."""

    def __init__(self, weights: Weights, rate: float, longest: float = 5.0):
        self.weights, self.rate, self.longest = weights.copy(), rate, longest
        self.squares = [np.full_like(a, 1e-3) for a in self.weights.arrays()]

    def step(self, tokens: np.ndarray, targets: np.ndarray, fresh: np.ndarray, valid: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        loss, found, h, seen = gradients(self.weights, tokens, targets, fresh, valid, h)
        grads = found.arrays()
        scale = 1 / np.sqrt(max(1, int(valid.sum())))
        length = np.sqrt(sum(float((g * g).sum()) for g in grads)) * scale
        scale *= min(1.0, self.longest / max(length, 1e-30))
        for k, (a, s, g) in enumerate(zip(self.weights.arrays(), self.squares, grads, strict=True)):
            g *= np.float32(scale)
            if k:
                s += g * g
                a -= np.float32(self.rate) * g / np.sqrt(s)
            else:
                s[seen] += g * g
                a[seen] -= np.float32(self.rate) * g / np.sqrt(s[seen])
        return loss, h
