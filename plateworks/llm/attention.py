"""A small causal self-attention model over symbols, trained and run in numpy.

A symbol and its place in the window give a vector; one masked attention head mixes those of the symbols before it; a hidden layer of both
predicts the next symbol in two steps, its class and then the member of the class. Symbols with like neighbours are in one class.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np

#: Width of vectors and of the hidden layer; symbols in a window, of which so many are context that the window before has scored.
WIDTH, HIDDEN, WINDOW, CONTEXT = 16, 32, 32, 8
CLASSES = MEMBERS = 32
SYMBOLS = CLASSES * MEMBERS
STEPS, BATCH, RATE = 1500, 64, 0.02
#: Windows that go through the attention together, so that what they need stays in a core's cache, and through the last layer.
TOGETHER, AT_ONCE = 64, 256
#: Part of a probability that is the symbol's share of all symbols whatever stands before it, so that none is next to impossible.
PLAIN = 0.01
_TOP = np.float32(80.0)  # exp of more is too much for a float


def alike(pairs: np.ndarray, classes: int = CLASSES) -> np.ndarray:
    """The symbols in an order in which each run of len / classes ones has like columns of ``pairs`` (counts: before, after).

    Groups are halved along their first principal component, so that all end up equal in size; classes is a power of two.
    """
    share = pairs / np.maximum(pairs.sum(axis=0, keepdims=True), 1)
    groups, rows = [np.arange(pairs.shape[1])], np.sqrt(share.T)
    while len(groups) < classes:
        halves = []
        for g in groups:
            x = rows[g] - rows[g].mean(axis=0)
            values, vectors = np.linalg.eigh(x.T @ x)
            v = vectors[:, -1] * np.sign(vectors[np.abs(vectors[:, -1]).argmax(), -1] or 1)
            order = g[np.argsort(x @ v, kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        groups = halves
    return np.concatenate(groups)


class Attention:
    """Parameters by name, with the forward and backward pass. Symbols are codes: class * MEMBERS + member."""

    def __init__(self, counts: np.ndarray, seed: int = 11):
        """counts of each code: the biases begin with its share; a code that never occurs gets next to nothing."""
        rng = np.random.default_rng(seed)
        some = lambda *shape: (rng.standard_normal(shape) / math.sqrt(shape[-2])).astype(np.float32)
        by_class = counts.reshape(CLASSES, MEMBERS).astype(float)
        self.adam: Adam | None = None
        self.share = (counts + 1) / (counts.sum() + SYMBOLS)
        log = lambda share: np.maximum(np.log(np.maximum(share, 1e-13)), -30).astype(np.float32)
        self.p = {
            "symbol": (rng.standard_normal((SYMBOLS, WIDTH)) * 0.5).astype(np.float32),
            "place": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
            "qkv": some(WIDTH, 3 * WIDTH),
            "hidden": some(2 * WIDTH, HIDDEN),
            "hidden0": np.zeros(HIDDEN, np.float32),
            "class": some(HIDDEN, CLASSES) * np.float32(0.1),
            "class0": log(by_class.sum(axis=1) / max(counts.sum(), 1)),
            "member": some(CLASSES, HIDDEN, MEMBERS) * np.float32(0.1),
            "member0": log(by_class / np.maximum(by_class.sum(axis=1, keepdims=True), 1)),
        }

    def mixed(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the hidden layer gets for each place of windows (windows, places), and what the backward pass needs."""
        p, (n, w) = self.p, codes.shape
        symbol, place = np.zeros((SYMBOLS, 2 * WIDTH), p["symbol"].dtype), np.zeros((w, 2 * WIDTH), p["place"].dtype)
        symbol[:, :WIDTH], place[:, :WIDTH] = p["symbol"], p["place"][:w]
        qkv = p["qkv"].copy()
        qkv[:, :WIDTH] *= np.float32(1 / math.sqrt(WIDTH))
        mixed, linear, a = (np.empty((n, w, size), symbol.dtype) for size in (2 * WIDTH, 3 * WIDTH, w))
        mask, ones = np.tri(w, dtype=symbol.dtype), np.ones(w, symbol.dtype)
        for at in range(0, n, TOGETHER):
            part, e, many = mixed[at : at + TOGETHER], a[at : at + TOGETHER], linear[at : at + TOGETHER]
            np.add(symbol.take(codes[at : at + TOGETHER], axis=0), place, out=part)
            np.matmul(part.reshape(-1, 2 * WIDTH)[:, :WIDTH], qkv, out=many.reshape(-1, 3 * WIDTH))
            np.matmul(many[..., :WIDTH], many[..., WIDTH : 2 * WIDTH].transpose(0, 2, 1), out=e)
            _exp(e)
            e *= mask  # no place sees a later one
            e *= (1 / (e @ ones))[..., None]
            np.matmul(e, many[..., 2 * WIDTH :], out=part[..., WIDTH:])
        return mixed, linear, a, qkv

    def hidden(self, mixed: np.ndarray) -> np.ndarray:
        z = mixed @ self.p["hidden"]
        z += self.p["hidden0"]
        return np.maximum(z, np.zeros_like(z), out=z)

    def last(self) -> tuple[np.ndarray, np.ndarray]:
        """For each class the layer of classes and that of its members side by side: weights and biases."""
        p, kind = self.p, self.p["class"].dtype
        weights, biases = np.empty((CLASSES, HIDDEN, CLASSES + MEMBERS), kind), np.empty((CLASSES, CLASSES + MEMBERS), kind)
        weights[..., :CLASSES], weights[..., CLASSES:] = p["class"], p["member"]
        biases[:, :CLASSES], biases[:, CLASSES:] = p["class0"], p["member0"]
        return weights, biases

    def gradient(self, codes: np.ndarray, target: np.ndarray, use: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the places to use (a mask), and its gradient. Work goes in parts that stay in a core's cache."""
        p, (n, w) = self.p, codes.shape
        mixed, linear, a, qkv = self.mixed(codes)
        rows = mixed.reshape(n * w, 2 * WIDTH)
        # Places are taken class by class, so that each class has its members' part in one run.
        places = np.flatnonzero(use)
        t = target.ravel().take(places)
        m, group = len(t), (t // MEMBERS).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        places, t, group = places.take(order), t.take(order), group.take(order)
        last, last0 = self.last()
        dlast, dlast0 = np.zeros_like(last), np.zeros_like(last0)
        g = {k: np.zeros_like(p[k]) for k in ("qkv", "hidden", "hidden0", "place")}
        ones = np.ones(max(m, n * w), mixed.dtype)
        dz = np.zeros((m + 1, HIDDEN), mixed.dtype)  # a row more, for places that are not used
        loss = 0.0
        for i, j, runs in _parts(group):
            flat, d, back = rows.take(places[i:j], axis=0), np.empty((j - i, CLASSES + MEMBERS), mixed.dtype), dz[i:j]
            z = self.hidden(flat)
            for c, x, y in runs:
                some = np.matmul(z[x:y], last[c], out=d[x:y])
                some += last0[c]
            loss += _missed(d, *_places(group[i:j], t[i:j]))
            for c, x, y in runs:
                np.matmul(z[x:y].T, d[x:y], out=dlast[c])
                np.matmul(ones[: y - x], d[x:y], out=dlast0[c])
                np.matmul(d[x:y], last[c].T, out=back[x:y])
            back *= z > 0
            g["hidden"] += flat.T @ back
        g["hidden0"] = ones[:m] @ dz[:m]
        g["class"], g["class0"] = dlast[..., :CLASSES].sum(axis=0), dlast0[:, :CLASSES].sum(axis=0)
        g["member"], g["member0"] = dlast[..., CLASSES:], dlast0[:, CLASSES:]
        where = np.full(n * w, m)
        where[places] = np.arange(m)
        dx = np.empty((n, w, WIDTH), mixed.dtype)
        for at in range(0, n, TOGETHER):
            part, e, many = mixed[at : at + TOGETHER], a[at : at + TOGETHER], linear[at : at + TOGETHER]
            dpart = (dz.take(where[at * w : (at + TOGETHER) * w], axis=0) @ p["hidden"].T).reshape(part.shape)
            dout = dpart[..., WIDTH:]
            ds = np.matmul(dout, many[..., 2 * WIDTH :].transpose(0, 2, 1))
            ds -= np.einsum("nij,nij->ni", dout, part[..., WIDTH:])[..., None]
            ds *= e
            back = np.empty_like(many)
            np.matmul(ds, many[..., WIDTH : 2 * WIDTH], out=back[..., :WIDTH])
            np.matmul(ds.transpose(0, 2, 1), many[..., :WIDTH], out=back[..., WIDTH : 2 * WIDTH])
            np.matmul(e.transpose(0, 2, 1), dout, out=back[..., 2 * WIDTH :])
            back = back.reshape(-1, 3 * WIDTH)
            g["qkv"] += part.reshape(-1, 2 * WIDTH)[:, :WIDTH].T @ back
            np.add(dpart[..., :WIDTH], (back @ qkv.T).reshape(-1, w, WIDTH), out=dx[at : at + TOGETHER])
        g["qkv"][:, :WIDTH] *= np.float32(1 / math.sqrt(WIDTH))
        at = np.arange(SYMBOLS * WIDTH).reshape(SYMBOLS, WIDTH).take(codes.ravel(), axis=0)
        g["symbol"] = np.bincount(at.ravel(), weights=dx.ravel(), minlength=SYMBOLS * WIDTH).reshape(SYMBOLS, WIDTH)
        g["place"][:w] = dx.sum(axis=0)
        return float(loss) / max(m, 1), {k: v / np.float32(max(m, 1)) for k, v in g.items()}

    def train(self, sequences: list[np.ndarray], steps: int = STEPS, seed: int = 12, rates: tuple[float, float] = (RATE, RATE / 10), batch: int = BATCH) -> list[float]:
        """Adam over the windows of the sequences of codes, all of them in each pass, in as many passes as it takes to make so many steps; the loss of each step.

        rates: of the first step and of the last. What Adam keeps stays for the next call.
        """
        np.empty(1 << 24, np.uint8)  # once such a block is freed, the allocator keeps what the steps free, which would cost page faults again
        windows, rng = Windows(sequences, batch), np.random.default_rng(seed)
        passes = max(1, -(-steps // max(1, windows.batches)))
        whole, losses = passes * windows.batches, []
        self.adam = self.adam or Adam(self.p)
        for _ in range(passes):
            for drawn in windows.drawn(rng):
                loss, g = self.gradient(*drawn)
                losses.append(loss)
                self.adam.step(g, rates[0] + (rates[1] - rates[0]) * len(losses) / whole)
        return losses

    def vector(self) -> np.ndarray:
        """All parameters in a row."""
        return np.concatenate([v.ravel() for v in self.p.values()]).astype(float)

    def load(self, vector: np.ndarray) -> None:
        """Parameters as vector() gives them."""
        cuts = np.cumsum([v.size for v in self.p.values()])[:-1]
        self.p = {k: part.reshape(v.shape).astype(v.dtype) for (k, v), part in zip(self.p.items(), np.split(vector, cuts), strict=True)}
        self.adam = None

    def tables(self) -> "Tables":
        return Tables(self)


class Windows:
    """Sequences cut into windows, in which each symbol but a sequence's first is predicted once."""

    def __init__(self, sequences: list[np.ndarray], batch: int):
        self.batch = batch
        length = np.array([max(0, len(s) - 1) for s in sequences], np.int64)
        begin = np.append(0, np.cumsum([len(s) for s in sequences]))[:-1].astype(np.int64)
        windows = -(-length // WINDOW)
        nth = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        self.start, self.size = np.repeat(begin, windows) + nth * WINDOW, np.minimum(WINDOW, np.repeat(length, windows) - nth * WINDOW)
        self.stream = np.concatenate([*sequences, np.zeros(WINDOW + 1, np.int64)]).astype(np.int32)
        self.batches = -(-len(self.start) // batch)

    def drawn(self, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, targets, places to use) of all windows once, a batch at a time, in random order."""
        order = rng.permutation(len(self.start))
        for at in range(0, len(order), self.batch):
            some = order[at : at + self.batch]
            part = self.stream.take(self.start[some, None] + np.arange(WINDOW + 1))
            yield part[:, :-1], part[:, 1:], np.arange(WINDOW) < self.size[some, None]


class Adam:
    """Steps on parameters by name, which change in place."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, self.n = p, 0
        self.m1, self.m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in "12")

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        fair, least = np.float32(rate * math.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)), np.float32(1e-8 * math.sqrt(1 - 0.99**self.n))
        for k, v in g.items():
            m1, m2, v = self.m1[k], self.m2[k], v.astype(np.float32, copy=False)
            m1 += np.float32(0.1) * (v - m1)
            v *= v
            v -= m2
            v *= np.float32(0.01)
            m2 += v
            d = np.sqrt(m2)
            d += least
            np.divide(m1, d, out=d)
            d *= fair
            self.p[k] -= d


class Tables:
    """The model laid out for scoring: all that is linear in a symbol or a place is worked out beforehand."""

    def __init__(self, model: Attention):
        p = model.p
        self.model = model
        q, k, v = p["qkv"][:, :WIDTH] * np.float32(1 / math.sqrt(WIDTH)), p["qkv"][:, WIDTH : 2 * WIDTH], p["qkv"][:, 2 * WIDTH :] @ p["hidden"][WIDTH:]
        # What a place asks and adds itself, and what the others get of it.
        parts = {"own": np.hstack([q, p["hidden"][:WIDTH]]), "given": np.hstack([k, v])}
        self.symbol = {n: np.ascontiguousarray(p["symbol"] @ m) for n, m in parts.items()}
        self.place = {n: np.ascontiguousarray(p["place"] @ m) for n, m in parts.items()}
        self.place["own"][:, WIDTH:] += p["hidden0"]
        self.mask = np.tri(WINDOW, dtype=np.float32)
        self.ones = np.ones(WINDOW, np.float32)
        self.last, self.last0 = model.last()
        self.plain = PLAIN * model.share

    def hidden(self, codes: np.ndarray, lead: int) -> np.ndarray:
        """The hidden layer at the places of windows from lead on: (windows, places, HIDDEN)."""
        w = codes.shape[1]
        own, given = self.symbol["own"].take(codes[:, lead:], axis=0), self.symbol["given"].take(codes, axis=0)
        own += self.place["own"][lead:w]
        given += self.place["given"][:w]
        e = np.matmul(own[..., :WIDTH], given[..., :WIDTH].transpose(0, 2, 1))
        _exp(e)
        e *= self.mask[lead:w, :w]
        e *= (1 / (e @ self.ones[:w]))[..., None]
        z = np.matmul(e, given[..., WIDTH:])
        z += own[..., WIDTH:]
        return np.maximum(z, np.zeros_like(z), out=z)

    def log_share(self, z: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The natural logarithm of the probability of each target (int32), given the hidden layer at the place before it."""
        group = (target // np.int32(MEMBERS)).astype(np.uint8)
        order = np.argsort(group, kind="stable")
        sorted_target, group, share = target.take(order), group.take(order), np.empty(len(target))
        for i, j, runs in _parts(group):
            some, d = z.take(order[i:j], axis=0), np.empty((j - i, CLASSES + MEMBERS), np.float32)
            for c, x, y in runs:
                part = np.matmul(some[x:y], self.last[c], out=d[x:y])
                part += self.last0[c]
            _exp(d)
            sums = (d @ _halves(d.dtype)).astype(float)
            one, two = _places(group[i:j], sorted_target[i:j])
            flat = d.reshape(-1)
            share[i:j] = flat.take(one).astype(float) * flat.take(two) / (sums[:, 0] * sums[:, 1])
        out = np.empty(len(target))
        out[order] = np.log((1 - PLAIN) * share + self.plain.take(sorted_target))
        return out

    def score(self, stream: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log10 probabilities of the sequences that a stream of codes holds one after another.

        Sequence i lies from begins[i] to begins[i + 1] and has the code of an end at both places. Windows overlap by CONTEXT places,
        which only the one before scores, so that each symbol is scored once.
        """
        length, step, stream = np.diff(begins), WINDOW - CONTEXT, stream.astype(np.int32)
        windows = 1 + np.maximum(0, -(-(length - WINDOW) // step))
        owner = np.repeat(np.arange(len(length)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        start, size = begins[owner] + nth * step, np.minimum(WINDOW, length[owner] - nth * step)
        total, last = np.zeros(len(owner)), len(stream) - 1
        for lead, mine in ((0, nth == 0), (CONTEXT, nth > 0)):
            order = np.flatnonzero(mine)
            order = order[np.argsort(-size[order], kind="stable")]
            for at in range(0, len(order), AT_ONCE):
                many = order[at : at + AT_ONCE]
                hidden, targets = [], []
                for w in (many[i : i + TOGETHER] for i in range(0, len(many), TOGETHER)):
                    width, least = int(size[w[0]]), int(size[w[-1]])
                    # A place more than there are: what is predicted at the last one.
                    places = np.minimum(start[w, None] + np.arange(width + 1), last)
                    codes = stream.take(places)
                    z, target = self.hidden(codes[:, :-1], lead), codes[:, lead + 1 :]
                    if least < width:
                        scored = np.arange(lead, width) < size[w, None]
                        z, target = z[scored], target[scored]
                    hidden.append(z.reshape(-1, HIDDEN))
                    targets.append(target.ravel())
                said = self.log_share(np.concatenate(hidden), np.concatenate(targets))
                counts = size[many] - lead
                total[many] = np.add.reduceat(said, np.cumsum(counts) - counts)
        return np.bincount(owner, weights=total, minlength=len(length)) / math.log(10)


def _exp(x: np.ndarray) -> None:
    """exp in place, of _TOP where it would be too much. The largest is asked for first, as a minimum takes longer."""
    if x.size and x.max() > _TOP:
        np.minimum(x, _TOP, out=x)
    np.exp(x, out=x)


@functools.cache
def _halves(kind: np.dtype) -> np.ndarray:
    """Times this, a row of classes and members becomes the sums of both; times its transpose, sums become such a row again."""
    return np.kron(np.eye(2), np.ones((MEMBERS, 1))).astype(kind)


def _parts(group: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Sorted classes in parts that stay in a core's cache, if no class alone is larger: from, to, and each class with its run in the part."""
    cuts, first = np.searchsorted(group, np.arange(CLASSES + 1)).tolist(), 0
    while first < CLASSES:
        end = first + 1
        while end < CLASSES and cuts[end + 1] - cuts[first] <= TOGETHER * WINDOW:
            end += 1
        i, j = cuts[first], cuts[end]
        if i < j:
            yield i, j, [(c, cuts[c] - i, cuts[c + 1] - i) for c in range(first, end) if cuts[c] < cuts[c + 1]]
        first = end


def _places(group: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the targets' classes and members are among rows of classes and members side by side."""
    begin = np.arange(len(target)) * (CLASSES + MEMBERS)
    return begin + group, begin + (CLASSES + target % np.int32(MEMBERS))


def _missed(logits: np.ndarray, one: np.ndarray, two: np.ndarray) -> float:
    """The loss of the targets' classes and members at these places; the logits become its gradient."""
    _exp(logits)
    halves = _halves(logits.dtype)
    logits *= (1 / (logits @ halves)) @ halves.T
    flat = logits.reshape(-1)
    loss = -np.log(np.maximum(flat[one] * flat[two], 1e-30)).sum()
    flat[one] -= 1
    flat[two] -= 1
    return float(loss)
