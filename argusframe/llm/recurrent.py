"""A small gated recurrent language model with a class-factored softmax, in numpy.

Sequences run side by side in lanes; a lane holds whole documents one after another, its state is
carried from window to window and starts anew with every document, so a document's likelihood
covers all of it whatever its length. Training is truncated backpropagation: gradients stay
inside a window, states do not.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, fields
from itertools import chain, pairwise

import numpy as np

HIDDEN = 16
WINDOW = 32
#: Rests of lanes that go on beside the next documents: tokens of one lane, and of all.
LONGEST_REST, MOST_REST = 1 << 15, 1 << 20
F32 = np.float32
#: Logits nearer to 0 need no shift: sums of their exponentials neither overflow nor vanish.
PLAIN = 60


@dataclass
class Classes:
    """Items sorted by frequency, cut into classes; items of a class are consecutive."""

    start: np.ndarray  # first item of each class, and the number of items at the end
    of: np.ndarray  # class of each item

    @staticmethod
    def by_frequency(counts: np.ndarray, n: int) -> Classes:
        """About n classes of equal sums of square-rooted counts."""
        weight = np.sqrt(np.maximum(counts, 1.0))
        share = np.cumsum(weight) / weight.sum()
        of = np.minimum((share * n - 1e-9).astype(np.int64), n - 1)
        of = np.unique(of, return_inverse=True)[1]
        start = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
        return Classes(start, of)


@dataclass
class Net:
    """Parameters. Gates are reset, update and candidate, side by side."""

    gate: np.ndarray  # (items, 3H): what a token brings to the gates
    loop: np.ndarray  # (H, 3H)
    to_class: np.ndarray  # (H + 1, classes); the last row is the bias
    to_item: np.ndarray  # (H + 1, items)

    @staticmethod
    def fresh(items: int, counts: np.ndarray, classes: Classes, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        h, c = HIDDEN, len(classes.start) - 1
        net = Net(
            rng.normal(0, 0.3, (items, 3 * h)).astype(F32), rng.normal(0, 0.25, (h, 3 * h)).astype(F32),
            np.zeros((h + 1, c), F32), np.zeros((h + 1, items), F32),
        )
        # start from the unigram distribution
        p = (counts + 0.5) / (counts + 0.5).sum()
        net.to_item[-1] = np.log(p)
        net.to_class[-1] = np.log(np.add.reduceat(p, classes.start[:-1]))
        return net

    def parts(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def vector(self) -> np.ndarray:
        return np.concatenate([p.reshape(-1) for p in self.parts()])

    def load(self, vector: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = vector[at : at + p.size].reshape(p.shape)
            at += p.size


def lanes(size: np.ndarray, width: int, held: int = 0) -> list[list[int]]:
    """Documents dealt to lanes, longest first, each to the shortest lane; longest lane first.

    The first `held` are begun already: each is the first of a lane of its own.
    """
    import heapq

    width = max(1, held, min(width, len(size)))
    out: list[list[int]] = [[i] if i < held else [] for i in range(width)]
    heap = [(int(size[i]) if i < held else 0, i) for i in range(width)]
    heapq.heapify(heap)
    for d in (np.argsort(-size[held:], kind="stable") + held).tolist():
        total, i = heapq.heappop(heap)
        out[i].append(d)
        heapq.heappush(heap, (total + int(size[d]), i))
    return sorted(out, key=lambda ds: -sum(int(size[d]) for d in ds))


class Lanes:
    """Documents that run side by side, chunk after chunk.

    As soon as a lane is over, what is left of the others goes on beside the documents of the next
    chunk, so that few windows have few lanes. Documents are numbered through all chunks.
    """

    def __init__(self, width: int, end: int):
        self.width, self.end, self.known = width, end, 0
        # targets, inputs, starts and documents of the rests, lane after lane
        none = np.zeros(0, np.int64)
        self.rest, self.size = (none, none, np.zeros(0, bool), none), none
        self.where = none  # row of the last state that each of them goes on from

    def least_open(self) -> int:
        """The least document that is not over."""
        return int(self.rest[3].min(initial=self.known))

    def windows(self, items: np.ndarray, new: np.ndarray, last: bool) -> Iterator[tuple]:
        """(targets, inputs, starts, document of each target) of shape (WINDOW, lanes in use), and a turn.

        items: targets of all documents, each closing with `end`; new: targets per document. Where a
        lane is over, the document is -1. The first window has a turn, the others None: for each
        lane the row of the last state that it goes on from (-1: none). After the last chunk no rest stays.
        """
        first = np.cumsum(new) - new
        previous = np.empty_like(items)
        previous[1:] = items[:-1]
        previous[first] = self.end
        fresh = np.zeros(len(items), bool)
        fresh[first] = True
        came = items, previous, fresh, np.repeat(np.arange(self.known, self.known + len(new)), new)
        self.known += len(new)
        items, previous, fresh, doc = (np.concatenate(x) for x in zip(self.rest, came, strict=True))
        size, held = np.concatenate((self.size, new)), len(self.size)
        dealt = lanes(size, self.width, held)
        where = np.array([self.where[ds[0]] if ds and ds[0] < held else -1 for ds in dealt], np.int64)
        turn = where
        # the places of all lanes one after another, and where each lane lies among them
        first = np.cumsum(size) - size
        order = np.fromiter((d for ds in dealt for d in ds), np.int64)
        long = size[order]
        flat = np.repeat(first[order] - (np.cumsum(long) - long), long) + np.arange(len(items))
        lane_size = np.array([sum(int(size[d]) for d in ds) for ds in dealt], np.int64)
        lane_first = np.cumsum(lane_size) - lane_size
        steps = np.arange(WINDOW)[:, None]
        at, use = 0, int((lane_size > 0).sum())
        while use:
            short = use < self.width and lane_size[0] - at <= LONGEST_REST
            if not last and short and int(lane_size[:use].sum()) - use * at <= MOST_REST:
                break
            over = at + steps >= lane_size[:use]
            index = flat[np.minimum(lane_first[:use] + at + steps, len(flat) - 1)]
            target, source, begins, of = items[index], previous[index], fresh[index], doc[index]
            if over.any():
                target[over], source[over], begins[over], of[over] = self.end, self.end, False, -1
            yield target, source, begins, of, turn
            turn, where = None, np.arange(use)
            at += WINDOW
            use = int(np.searchsorted(-lane_size, -at, "left"))
        left = [flat[f + at : f + n] for f, n in zip(lane_first[:use], lane_size[:use], strict=True)]
        left = np.concatenate(left) if left else np.zeros(0, np.int64)
        self.rest = items[left], previous[left], fresh[left], doc[left]
        self.size, self.where = lane_size[:use] - at, where[:use]


def _windows(items: np.ndarray, size: np.ndarray, width: int, end: int) -> Iterator[tuple]:
    """Windows of one chunk, without turns."""
    for *window, _ in Lanes(width, end).windows(items, size, last=True):
        yield tuple(window)


def _taken(state: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The rows of the last state that lanes go on from; zeros for lanes that begin."""
    out = np.zeros((len(where), HIDDEN), F32)
    out[where >= 0] = state[where[where >= 0]]
    return out


def _by_gate(weights: np.ndarray) -> np.ndarray:
    """(rows, 3H) as (3, rows, H), so that the values of one gate lie side by side."""
    return np.ascontiguousarray(weights.reshape(len(weights), 3, HIDDEN).transpose(1, 0, 2))


def _forward(net: Net, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = True) -> tuple:
    """Hidden states after each step, and, if kept, what the backward pass needs."""
    h = HIDDEN
    steps, n = inputs.shape
    brought = np.take(_by_gate(net.gate), inputs, axis=1)
    loop = _by_gate(net.loop)
    states = np.empty((steps, n, h), F32)
    # before, turn, both gates and candidate of each step; one step's place if they are not kept
    held = steps if keep else 1
    before, turn, gates, candidate = (np.empty(x, F32) for x in ((held, n, h), (held, 3, n, h), (2, held, n, h), (held, n, h)))
    begins = fresh.any(1)
    with np.errstate(over="ignore"):  # a saturated gate is 0
        for t in range(steps):
            at = t if keep else 0
            was, new, both, cand = before[at], turn[at], gates[:, at], candidate[at]
            was[...] = state
            if begins[t]:
                was[fresh[t]] = 0
            np.matmul(was, loop, out=new)
            np.add(brought[:2, t], new[:2], out=both)
            np.negative(both, out=both)
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            np.multiply(both[0], new[2], out=cand)
            cand += brought[2, t]
            np.tanh(cand, out=cand)
            state = np.subtract(was, cand, out=states[t])
            state *= both[1]
            state += cand
    if not keep:
        return states, (), state
    return states, (before, turn[:, 2], gates[0], gates[1], candidate), state


def _plain(weights: np.ndarray) -> bool:
    """Whether no logit can need a shift: states are between -1 and 1."""
    return bool(np.abs(weights).sum(0).max(initial=0) < PLAIN)


def _exponentials(logits: np.ndarray, target: np.ndarray, plain: bool) -> tuple:
    """Turns logits into exponentials in place; the targets' logits, the sums, and where the targets are."""
    if not plain and not (logits.max(initial=0) < PLAIN and logits.min(initial=0) > -PLAIN):
        logits -= logits.max(1, keepdims=True)
    places = np.arange(0, logits.size, logits.shape[1])
    places += target
    chosen = logits.take(places)
    np.exp(logits, out=logits)
    return chosen, logits @ np.ones(logits.shape[1], F32), places


def _with_bias(states: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The states in an order, with a last column of ones that meets the bias."""
    x = np.empty((len(order), HIDDEN + 1), F32)
    x[:, :-1] = states.reshape(-1, HIDDEN)[order]
    x[:, -1] = 1
    return x


def _groups(classes: Classes, target: np.ndarray) -> tuple:
    of = classes.of[target]
    order = np.argsort(of.astype(np.int16), kind="stable")
    bounds = np.searchsorted(of[order], np.arange(len(classes.start)))
    return of, order, bounds


def _present(classes: Classes, bounds: np.ndarray) -> Iterator[tuple]:
    """(class, first item, end of its items, its targets) of the classes of two items or more that have targets."""
    for c, ((a, b), (first, last)) in enumerate(zip(pairwise(classes.start.tolist()), pairwise(bounds.tolist()), strict=True)):
        if first < last and b - a > 1:
            yield c, a, b, slice(first, last)


class Running:
    """Natural-log likelihoods of whole documents that come in chunks."""

    def __init__(self, net: Net, classes: Classes, end: int, width: int):
        self.net, self.classes, self.lanes = net, classes, Lanes(width, end)
        self.state = np.zeros((0, HIDDEN), F32)
        self.sizes: deque[int] = deque()  # documents of each chunk that is not over
        self.out, self.low = np.zeros(0), 0  # of the documents from number `low` on
        self.to_item = [np.ascontiguousarray(net.to_item[:, a:b]) for a, b in pairwise(classes.start.tolist())]
        self.plain = _plain(net.to_class), _plain(net.to_item)

    def add(self, items: np.ndarray, size: np.ndarray, last: bool = False) -> np.ndarray:
        """Likelihoods of all chunks, in their order, that are over with this one's windows."""
        self.sizes.append(len(size))
        self.out = np.concatenate((self.out, np.zeros(len(size))))
        for target, inputs, fresh, doc, turn in self.lanes.windows(items, size, last):
            if turn is not None:
                self.state = _taken(self.state, turn)
            states, _, self.state = _forward(self.net, inputs, fresh, self.state[: target.shape[1]], keep=False)
            d = doc.reshape(-1)
            places = np.flatnonzero(d >= 0)
            got, order = self._likelihoods(states, target.reshape(-1)[places], places)
            self.out += np.bincount(d[order] - self.low, got, len(self.out))
        over, least = 0, self.lanes.least_open() - self.low
        while self.sizes and over + self.sizes[0] <= least:
            over += self.sizes.popleft()
        done, self.out = self.out[:over], self.out[over:]
        self.low += over
        return done

    def _likelihoods(self, states: np.ndarray, y: np.ndarray, places: np.ndarray) -> tuple:
        """Of the targets at some places, those of a class side by side; and the places in that order."""
        of, order, bounds = _groups(self.classes, y)
        y, of, order = y[order], of[order], places[order]
        x = _with_bias(states, order)
        chosen, total, _ = _exponentials(x @ self.net.to_class, of, self.plain[0])
        got = chosen.astype(np.float64) - np.log(total)
        chosen, total = np.zeros(len(y), F32), np.ones(len(y), F32)
        for c, a, _, rows in _present(self.classes, bounds):
            chosen[rows], total[rows], _ = _exponentials(x[rows] @ self.to_item[c], y[rows] - a, self.plain[1])
        got += chosen
        got -= np.log(total)
        return got, order


def score(
    net: Net, classes: Classes, items: np.ndarray, size: np.ndarray, end: int, width: int = 512,
    running: Running | None = None,
) -> np.ndarray:
    """Natural-log likelihood of each whole document; with `running`, of those over (see there)."""
    if running is None:
        return Running(net, classes, end, width).add(items, size, last=True)
    return running.add(items, size)


class Trainer:
    """Adaptive steps by truncated backpropagation."""

    def __init__(self, net: Net, classes: Classes, rate: float, squares: list | None = None):
        self.net, self.classes, self.rate = net, classes, rate
        self.squares = squares or [np.full(p.shape, 1e-4, F32) for p in net.parts()]
        self.tokens = 0

    def learn(self, items: np.ndarray, size: np.ndarray, end: int, width: int) -> float:
        """One pass over documents, every window of which gives a gradient; returns the summed log likelihood."""
        return self.learn_all(iter([(items, size)]), end, width)

    def learn_all(self, chunks: Iterator[tuple], end: int, width: int) -> float:
        """`learn` over chunks of documents; what is left of long ones goes on beside the next chunk."""
        beside = Lanes(width, end)
        none = np.zeros(0, np.int64)
        state = np.zeros((0, HIDDEN), F32)
        total = 0.0
        windows = chain(
            chain.from_iterable(beside.windows(items, size, last=False) for items, size in chunks),
            beside.windows(none, none, last=True),
        )
        for target, inputs, fresh, doc, turn in windows:
            if turn is not None:
                state = _taken(state, turn)
            inside = doc >= 0
            got, grads, state = self._window(target, inputs, fresh, inside, state[: target.shape[1]])
            total += got
            self.tokens += int(inside.sum())
            # items that bring nothing have no gradient at the gates
            used = np.flatnonzero(np.bincount(inputs.reshape(-1), minlength=len(self.net.gate)))
            places = (used, ..., ..., ...)
            for p, g, s, at in zip(self.net.parts(), grads, self.squares, places, strict=True):
                g = g[at]
                s[at] += g * g
                g *= self.rate
                g /= np.sqrt(s[at])
                p[at] -= g
        return total

    def _window(self, target, inputs, fresh, inside, state) -> tuple:
        net, classes, h = self.net, self.classes, HIDDEN
        states, kept, state = _forward(net, inputs, fresh, state)
        # targets of a class side by side, without those beyond the end of a lane
        places = np.flatnonzero(inside)
        y = target.reshape(-1)[places]
        of, order, bounds = _groups(classes, y)
        y, of, order = y[order], of[order], places[order]
        scale = F32(1 / max(1, len(places)))
        x = _with_bias(states, order)
        # each target's gradient is scaled once, in its row of the products
        p = x @ net.to_class
        chosen, total, at = _exponentials(p, of, _plain(net.to_class))
        p *= (scale / total)[:, None]
        p.reshape(-1)[at] -= scale
        g_class = x.T @ p
        sorted_back = p @ net.to_class[:-1].T
        g_item = np.zeros_like(net.to_item)
        item_chosen, item_total = np.zeros(len(y), F32), np.ones(len(y), F32)
        plain = _plain(net.to_item)
        for _, a, b, rows in _present(classes, bounds):
            own, weights = x[rows], net.to_item[:, a:b]
            q = own @ weights
            item_chosen[rows], sums, at = _exponentials(q, y[rows] - a, plain)
            item_total[rows] = sums
            q *= (scale / sums)[:, None]
            q.reshape(-1)[at] -= scale
            np.matmul(own.T, q, out=g_item[:, a:b])
            sorted_back[rows] += q @ weights[:-1].T
        got = float(chosen.sum(dtype=np.float64) + item_chosen.sum(dtype=np.float64))
        got -= float(np.log(total).sum(dtype=np.float64) + np.log(item_total).sum(dtype=np.float64))
        back = np.zeros((target.size, h), F32)
        back[order] = sorted_back
        back = back.reshape(states.shape)
        before, turn, reset, update, candidate = kept
        # what a step's own gradient is multiplied by on its way to the gates
        to_cand = candidate * candidate
        np.subtract(1, to_cand, out=to_cand)
        rest = 1 - update
        to_cand *= rest
        to_update = before - candidate
        to_update *= update
        to_update *= rest
        to_reset = np.subtract(1, reset, out=rest)
        to_reset *= reset
        to_reset *= turn
        steps, n = inputs.shape
        through = np.empty((steps, 3, n, h), F32)
        g_cand = np.empty((steps, n, h), F32)
        loop_back = np.ascontiguousarray(_by_gate(net.loop).transpose(0, 2, 1))
        ahead, sent = np.zeros_like(states[0]), np.empty((3, n, h), F32)
        ends = fresh.any(1)
        for t in range(steps - 1, -1, -1):
            g, own, to_gates = back[t], g_cand[t], through[t]
            g += ahead
            np.multiply(g, to_cand[t], out=own)
            np.multiply(own, to_reset[t], out=to_gates[0])
            np.multiply(g, to_update[t], out=to_gates[1])
            np.multiply(own, reset[t], out=to_gates[2])
            np.matmul(to_gates, loop_back, out=sent)
            np.multiply(g, update[t], out=ahead)
            for x in sent:
                ahead += x
            if ends[t]:
                ahead[fresh[t]] = 0
        flat = before.reshape(-1, h)
        g_loop = np.concatenate([flat.T @ through[:, k].reshape(-1, h) for k in range(3)], 1)
        # gradients of what the tokens brought, side by side and in the order of items
        flat_in = inputs.reshape(-1)
        order = np.argsort(flat_in.astype(np.uint16) if len(net.gate) <= 1 << 16 else flat_in, kind="stable")
        at = np.flatnonzero(np.diff(flat_in[order], prepend=-1))
        rows = np.empty((target.size, 3, h), F32)
        for k, g in enumerate((through[:, 0], through[:, 1], g_cand)):
            rows.reshape(steps, n, 3, h)[:, :, k] = g
        g_gate = np.zeros_like(net.gate)
        g_gate[flat_in[order[at]]] = np.add.reduceat(rows.reshape(-1, 3 * h)[order], at, axis=0)
        return got, [g_gate, g_loop, g_class, g_item], state
