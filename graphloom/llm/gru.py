"""A gated recurrent network in numpy that predicts the next of a bounded number of tokens, its softmax factored by classes.

Tokens are numbered so that classes are runs of numbers: the probability of a token is that of its class, given the state,
times its own within the class, given the state.  Training cuts the gradient at windows (truncated backpropagation) and
carries the state on; ``log_likelihood`` carries it from a text's first token to its last, whatever its length.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Units of the state, steps of a window, sequences trained together and their longest length.
HIDDEN, WINDOW, TOGETHER, LONGEST = 16, 32, 512, 512
NAMES = ("inputs", "recurrent", "classes", "class_bias", "words", "word_bias")


def class_bounds(weights: np.ndarray, singles: int, classes: int) -> np.ndarray:
    """Where classes begin and end: the first ``singles`` tokens are classes of their own, the rest (by falling weight) share
    out the sum of the weights' square roots."""
    rest = np.sqrt(np.maximum(weights[singles:], 1e-12))
    part = np.minimum((np.cumsum(rest) / rest.sum() * classes).astype(int), classes - 1) if rest.size else np.zeros(0, int)
    return np.concatenate([np.arange(singles), singles + np.flatnonzero(np.diff(part, prepend=-1)), [len(weights)]])


def fresh(weights: np.ndarray, bounds: np.ndarray, hidden: int = HIDDEN, seed: int = 11) -> dict[str, np.ndarray]:
    """A network that gives every token its share of ``weights`` whatever came before; training starts here.

    What a token and the state add to the update gate, the reset gate and the candidate are blocks of their own, so that every
    step works on memory without gaps."""
    draw, n = np.random.default_rng(seed), len(weights)
    shares = np.maximum(weights, 1e-9) / np.maximum(weights, 1e-9).sum()
    by_class = np.add.reduceat(shares, bounds[:-1])
    found = {
        "inputs": draw.normal(0, 0.3, (3, n, hidden)), "recurrent": draw.normal(0, 1 / np.sqrt(hidden), (3, hidden, hidden)),
        "classes": np.zeros((hidden, len(by_class))), "class_bias": np.log(by_class), "words": np.zeros((n, hidden)), "word_bias": np.log(shares),
    }
    return {k: v.astype(np.float32) for k, v in found.items()}


class Sequences:
    """Token ids of texts, one after the other, the longest text first, between an end token before and one after each."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, end: int = 0):
        self.order = np.argsort(-lengths, kind="stable")
        self.steps = lengths[self.order] + 1
        self.starts = np.concatenate([[0], np.cumsum(self.steps + 1)])[:-1]
        self.flat = np.full(int((self.steps + 1).sum()), end, np.int32)
        at = np.cumsum(lengths) - lengths
        self.flat[ranges(self.starts + 1, lengths[self.order])] = ids[ranges(at[self.order], lengths[self.order])]

    def windows(self, width: int = WINDOW):
        """(active, inputs, targets, mask) of each window: how many texts go on at each step, (steps, texts) ids, and which of
        them are within their text."""
        last = int(self.steps[0]) if len(self.steps) else 0
        for begin in range(0, last, width):
            t = np.arange(begin, min(begin + width, last))
            active = np.searchsorted(-self.steps, -t, "left")  # texts with more than t steps
            places = self.starts[None, : active[0]] + t[:, None]
            mask = np.arange(active[0])[None, :] < active[:, None]
            np.minimum(places, len(self.flat) - 2, out=places)
            yield active, self.flat[places], self.flat[places + 1], mask


def _forward(net: dict, inputs: np.ndarray, state: np.ndarray, active: np.ndarray, trace: list | None = None) -> np.ndarray:
    """States after each step of a window of (steps, texts) token ids; ``state`` is moved on in place."""
    x, out = np.take(net["inputs"], inputs, axis=1), np.zeros((*inputs.shape, state.shape[1]), net["inputs"].dtype)
    for t, n in enumerate(active):
        h = state[:n]
        a = np.matmul(h, net["recurrent"])
        gates, candidate = a[:2], a[2]
        gates += x[:2, t, :n]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        if trace is not None:
            trace.append((h.copy(), a, candidate.copy()))
        candidate *= a[1]
        candidate += x[2, t, :n]
        np.tanh(candidate, out=candidate)
        h -= candidate
        h *= a[0]
        h += candidate
        out[t, :n] = h
    return out


def _shares(logits: np.ndarray, wanted: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-shares of the ``wanted`` column of each row, exp of the logits (in place) and its sums; rows are only shifted by their
    greatest logit where a bound on logits (``most``) does not make that needless."""
    if most > 80:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(logits)), wanted]
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return own - np.log(total), logits, total


def _most(weights: np.ndarray, bias: np.ndarray) -> float:
    """A bound on logits, as no state has a component beyond 1."""
    return float((np.abs(weights).sum(axis=0) + np.abs(bias)).max(initial=0))


def _predict(net: dict, bounds: np.ndarray, of_class: np.ndarray, states: np.ndarray, targets: np.ndarray, gradient: dict | None = None):
    """Natural log-probabilities of ``targets`` after ``states``; with ``gradient``, what to change is added to it and the
    states' part returned."""
    # in the order of classes, so that a class's rows lie together
    order = np.argsort(of_class[targets], kind="stable")
    states, targets = states[order], targets[order]
    cls = of_class[targets]
    found, logits, total = _shares(states @ net["classes"] + net["class_bias"], cls, _most(net["classes"], net["class_bias"]))
    if gradient is not None:
        logits /= total[:, None]
        logits[np.arange(len(targets)), cls] -= 1
        gradient["classes"] += states.T @ logits
        gradient["class_bias"] += logits.sum(axis=0)
        back = logits @ net["classes"].T
    most, cuts = _most(net["words"].T, net["word_bias"]), np.searchsorted(cls, np.arange(len(bounds)))
    for c in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(bounds) > 1)):
        mine, begin, end = slice(cuts[c], cuts[c + 1]), bounds[c], bounds[c + 1]
        seen, wanted = states[mine], targets[mine] - begin
        own, within, total = _shares(seen @ net["words"][begin:end].T + net["word_bias"][begin:end], wanted, most)
        found[mine] += own
        if gradient is not None:
            within /= total[:, None]
            within[np.arange(len(wanted)), wanted] -= 1
            gradient["words"][begin:end] += within.T @ seen
            gradient["word_bias"][begin:end] += within.sum(axis=0)
            back[mine] += within @ net["words"][begin:end]
    out = np.empty_like(found)
    out[order] = found
    if gradient is None:
        return out
    at_states = np.empty_like(back)
    at_states[order] = back
    return out, at_states


def class_of(bounds: np.ndarray) -> np.ndarray:
    """The class of each token; a narrow type, so that sorting by class takes time in proportion."""
    return np.repeat(np.arange(len(bounds) - 1, dtype=np.int16), np.diff(bounds))


def log_likelihood(net: dict, bounds: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The natural log-probability of each text and its end.  Texts of like length go together."""
    of_class, hidden = class_of(bounds), net["recurrent"].shape[1]
    begin, out = np.cumsum(lengths) - lengths, np.empty(len(lengths))
    order = np.argsort(-lengths, kind="stable")
    for at in range(0, len(order), TOGETHER):
        some = order[at : at + TOGETHER]
        texts = Sequences(ids[ranges(begin[some], lengths[some])], lengths[some])
        state, sums = np.zeros((len(some), hidden), np.float32), np.zeros(len(some))
        for active, inputs, targets, mask in texts.windows():
            states = _forward(net, inputs, state, active)
            if active[-1] == active[0]:
                found = _predict(net, bounds, of_class, states.reshape(-1, hidden), targets.ravel())
                sums[: active[0]] += found.reshape(targets.shape).sum(axis=0, dtype=float)
            else:
                found = _predict(net, bounds, of_class, states[mask], targets[mask])
                sums[: active[0]] += np.bincount(np.nonzero(mask)[1], found, active[0])
        out[some[texts.order]] = sums
    return out


class Trainer:
    """Truncated backpropagation with moving averages of the gradient and its square (Adam)."""

    def __init__(self, net: dict, bounds: np.ndarray, rate: float):
        self.net, self.bounds, self.rate, self.done, self.tokens = {k: v.copy() for k, v in net.items()}, bounds, rate, 0, 0
        self.of_class = class_of(bounds)
        self.first, self.second = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))

    def texts(self, ids: np.ndarray, lengths: np.ndarray, together: int = TOGETHER) -> None:
        """One pass over texts, in stretches of at most ``LONGEST`` tokens, each from an empty state."""
        whole = np.concatenate([[0], np.cumsum(lengths)])
        pieces = np.maximum(1, -(-lengths // LONGEST))
        nth = ranges(np.zeros(len(lengths), np.int64), pieces)
        begin = np.repeat(whole[:-1], pieces) + nth * LONGEST
        size = np.minimum(LONGEST, np.repeat(whole[1:], pieces) - begin)
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), together):
            some = order[at : at + together]
            self._batch(Sequences(ids[ranges(begin[some], size[some])], size[some]))

    def _batch(self, texts: Sequences) -> None:
        state = np.zeros((len(texts.steps), self.net["recurrent"].shape[1]), np.float32)
        for window in texts.windows():
            self._update(self.gradient(state, *window)[0])

    def gradient(self, state: np.ndarray, active: np.ndarray, inputs: np.ndarray, targets: np.ndarray, mask: np.ndarray) -> tuple[dict, float]:
        """The gradient of a window's mean negative log-likelihood, and its sum; ``state`` is moved on."""
        net, trace = self.net, []
        states = _forward(net, inputs, state, active, trace)
        out = {k: np.zeros_like(v) for k, v in net.items()}
        found, at_states = _predict(net, self.bounds, self.of_class, states[mask], targets[mask], out)
        back = np.zeros_like(states)
        back[mask] = at_states
        # what moves the gates and the candidate, and the candidate's part that comes by the state
        later, moved, inner = np.zeros_like(states[0]), np.zeros((3, *states.shape), states.dtype), np.zeros((3, *states.shape), states.dtype)
        before, turned = np.zeros_like(states), net["recurrent"].transpose(0, 2, 1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            before[t, :n], (z, r, c), held = trace[t]
            d = later[:n] + back[t, :n]
            m, i = moved[:, t, :n], inner[:, t, :n]
            keep = 1 - z
            dc = d * keep
            m[0] = (before[t, :n] - c) * dc * z * 2
            dc *= 1 - c * c
            m[1] = dc * held * r * (1 - r) * 2
            m[2] = dc
            i[:2] = m[:2]
            i[2] = dc * r
            d *= z
            d += np.matmul(i, turned).sum(axis=0)
            later[:n] = d
        width = before.shape[-1]
        out["recurrent"] += np.matmul(before.reshape(-1, width).T, inner.reshape(3, -1, width))
        rows = np.flatnonzero(mask.ravel())
        used = inputs.ravel()[rows]
        order = np.argsort(used, kind="stable")
        used = used[order]
        first = np.flatnonzero(np.diff(used, prepend=-1))
        out["inputs"][:, used[first]] = np.add.reduceat(np.take(moved.reshape(3, -1, width), rows[order], axis=1), first, axis=1)
        self.tokens += len(found)
        for v in out.values():
            v /= len(found)
        return out, -float(found.sum(dtype=float))

    def _update(self, gradient: dict) -> None:
        self.done += 1
        rate = self.rate * np.sqrt(1 - 0.99**self.done) / (1 - 0.9**self.done)
        size = np.sqrt(sum(float((g * g).sum()) for g in gradient.values()))
        for k, g in gradient.items():
            if size > 5:
                g *= 5 / size
            self.first[k] += 0.1 * (g - self.first[k])
            self.second[k] += 0.01 * (g * g - self.second[k])
            self.net[k] -= (rate * self.first[k] / (np.sqrt(self.second[k]) + 1e-7)).astype(np.float32)


def packed(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in NAMES])


def unpacked(flat: np.ndarray, like: dict) -> dict[str, np.ndarray]:
    cuts = np.cumsum([like[k].size for k in NAMES])[:-1]
    return {k: x.reshape(like[k].shape).astype(np.float32) for k, x in zip(NAMES, np.split(flat, cuts), strict=True)}
