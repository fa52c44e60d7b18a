"""Character-level bidirectional LSTM with CRF transitions.

Each character is one of a few symbols (digits are one symbol, accents are
dropped, case is kept) with a short vector each. A step costs one product of a
matrix with the hidden states, the vectors and a constant, all windows of a batch
side by side; onnxruntime takes the steps where it is installed (``pii_graph``), else
numpy does. Emissions of overlapping windows are reconciled by taking, for each
character, the window in which it lies farthest from an edge; one Viterbi pass over
the whole text decodes them. Texts in which no item can beat "outside everywhere"
skip that pass, by an exact bound, without any change of the result.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from colloquy.llm import pii_graph

KINDS = ["email", "phone", "id_number", "address", "name"]
#: Tag 0 is outside, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
#: The symbols, in order; everything else is the last one, padding is 0.
SYMBOLS = " 0abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?'\"()[]<>@+-_/&%$#*=\n"
PAD, OTHER = 0, len(SYMBOLS) + 1
WINDOW, MARGIN, EMBEDDED = 640, 48, 8
#: The tags but outside: the begin tags of all kinds, then their inside tags.
BEGIN, INSIDE = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
MARKED, KEPT = np.concatenate([BEGIN, INSIDE]), len(KINDS)
#: Windows in a product at most (products of up to a million steps are faster), in a batch, and characters in a batch and at a time.
COLUMNS, WINDOWS, CELLS, AT_ONCE = 304, 752, 1 << 18, 1 << 22


def _table() -> np.ndarray:
    table = np.full(0x10000, OTHER, np.uint8)
    for code in range(0x10000):
        char = chr(code)
        if char.isdigit():
            char = "0"
        elif char.isspace() and char != "\n":
            char = " "
        elif char not in SYMBOLS and not 0xD800 <= code < 0xE000:
            base = unicodedata.normalize("NFKD", char)[:1]
            char = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "ß": "s", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "æ": "a", "œ": "o"}.get(char, base)
        if char in SYMBOLS and char:
            table[code] = SYMBOLS.index(char) + 1
    return table


_TABLE = _table()


def symbols(text: str) -> np.ndarray:
    """One symbol per character (code point)."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _TABLE[np.where(codes < 0x10000, codes, 0xFFFF)]


def allowed() -> np.ndarray:
    """Which tag may follow which: inside only after begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


BARRED = np.where(allowed(), 0.0, -1e4).astype(np.float32)


@dataclass
class Weights:
    """``embed`` (symbols, E), ``project`` (2, E, 4H), ``shift`` (2, 4H), ``recurrent`` (2, H, 4H), ``out`` (2H, tags), ``bias``, ``transitions``, ``start``."""

    embed: np.ndarray
    project: np.ndarray
    shift: np.ndarray
    recurrent: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    packed: np.ndarray | None = field(default=None, repr=False)
    stepper: pii_graph.Stepper | None = field(default=None, repr=False)

    NAMES = ("embed", "project", "shift", "recurrent", "out", "bias", "transitions", "start")

    @classmethod
    def fresh(cls, hidden: int, seed: int, size: int = EMBEDDED) -> Weights:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.5, (OTHER + 1, size)).astype(np.float32)
        project = rng.normal(0, 0.3, (2, size, 4 * hidden)).astype(np.float32)
        shift = np.zeros((2, 4 * hidden), np.float32)
        shift[:, hidden : 2 * hidden] = 1.0  # remember at first
        recurrent = (rng.normal(0, 1, (2, hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        bias = np.zeros(TAGS, np.float32)
        bias[0] = 2.0
        return cls(embed, project, shift, recurrent, rng.normal(0, 0.2, (2 * hidden, TAGS)).astype(np.float32), bias, np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32))

    @classmethod
    def load(cls, file) -> Weights:
        with np.load(file) as stored:
            return cls(*(stored[n].astype(np.float32) for n in cls.NAMES))

    def save(self, file) -> None:
        np.savez_compressed(file, **{n: getattr(self, n).astype(np.float32) for n in self.NAMES})

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[1]

    @property
    def inputs(self) -> np.ndarray:
        """The input part of the gates of each symbol (2, symbols, 4H)."""
        return self.embed @ self.project + self.shift[:, None]

    def fused(self) -> np.ndarray:
        """One matrix a direction (2, 1, 4H + gains, H + E + 1) for state, embedding and a constant.

        Its last rows give the gains of the state that goes in, so those of a step come
        with the gates of the next. Sigmoids are taken by half-angle tangents,
        sigmoid(x) = (1 + tanh(x / 2)) / 2, and the hidden state is kept doubled, which
        its columns take back.
        """
        if self.packed is None:
            hidden = self.hidden
            factor = np.full(4 * hidden, 0.5, np.float32)
            factor[3 * hidden :] = 1.0
            whole = np.concatenate([self.recurrent * np.float32(0.5), self.project, self.shift[:, None]], axis=1) * factor
            told = np.zeros((2, whole.shape[1], len(MARKED)), np.float32)
            told[:, :hidden] = (self.out[:, MARKED] - self.out[:, :1]).reshape(2, hidden, -1) * np.float32(0.5)
            told[0, -1] = self.bias[MARKED] - self.bias[0]
            told[0, -1, KEPT:] += self.stay
            self.packed = np.ascontiguousarray(np.concatenate([whole, told], axis=2).transpose(0, 2, 1), np.float32)[:, None]
        return self.packed

    def steps(self) -> pii_graph.Stepper | None:
        """The steps as graphs; None where their runtime isn't installed."""
        if self.stepper is None and pii_graph.runtime():
            told = (self.out[:, MARKED] - self.out[:, :1]).reshape(2, self.hidden, -1).transpose(0, 2, 1)
            self.stepper = pii_graph.Stepper(self.embed, self.project, self.shift, self.recurrent, told, PAD)
        return self.stepper

    @property
    def stay(self) -> np.ndarray:
        """The most that a step to an inside tag gains over one from outside to outside."""
        step = self.transitions + BARRED
        return np.maximum(step[BEGIN, INSIDE], step[INSIDE, INSIDE]) - step[0, 0]


class Room:
    """Memory for the arrays of one batch after the other; a new array under a name takes the place of the last."""

    def __init__(self) -> None:
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, np.float32)
        return self.held[name][:size].reshape(shape)


def gains(weights: Weights, streams: np.ndarray, lengths: np.ndarray, room: Room) -> np.ndarray:
    """What the tags MARKED gain over the outside tag in windows of symbols (time, windows): (time, tags, columns).

    Inside tags have ``stay`` added. Only the states of a few steps are held. Columns past
    the last window repeat it; places past a window's end have -1e9. The result stays
    until ``room`` is used again.
    """
    out = (gains_by_graph if weights.steps() else gains_by_numpy)(weights, streams, lengths, room)
    full, fill = int(lengths.min()), np.minimum(np.arange(out.shape[2]), len(lengths) - 1)
    most = np.where(np.arange(full, len(out))[:, None] < lengths[fill], np.float32(np.inf), np.float32(-1e9))
    np.minimum(out[full:], most[:, None], out=out[full:])
    return out


def gains_by_graph(weights: Weights, streams: np.ndarray, lengths: np.ndarray, room: Room) -> np.ndarray:
    """Gains as the graphs of ``pii_graph`` make them, one direction after the other; places past a window's end have any value."""
    steps, (time, count) = weights.steps(), streams.shape
    whole = -(-time // pii_graph.STEPS) * pii_graph.STEPS
    places = np.full((whole, count), PAD, np.intp)
    places[:time] = streams
    looked, row = room("looked", whole, len(steps.table), count), room("row", whole, count)
    for k, values in enumerate(steps.table[:-1]):
        np.take(values, places, mode="clip", out=row)
        looked[:, k] = row
    looked[:, -1] = 1.0
    out = room("out", whole, len(MARKED), count)
    bias = weights.bias[MARKED] - weights.bias[0]
    bias[KEPT:] += weights.stay
    starts = range(0, whole, pii_graph.STEPS)
    for backward in (False, True):
        state = cell = np.zeros((weights.hidden, count), np.float32)
        for low in reversed(starts) if backward else starts:
            told, state, cell = steps.run(backward, looked[low : low + pii_graph.STEPS], state, cell)
            place = out[low : low + pii_graph.STEPS]
            np.add(told, place if backward else bias[:, None], out=place)
    return out[:time]


def gains_by_numpy(weights: Weights, streams: np.ndarray, lengths: np.ndarray, room: Room) -> np.ndarray:
    """Gains by products and tangents of numpy, both directions side by side; places past a window's end have any value."""
    matrix, hidden = weights.fused(), weights.hidden
    time, count = streams.shape
    groups = -(-count // COLUMNS)
    each = -(-count // groups)
    columns = groups * each
    fill = np.minimum(np.arange(columns), count - 1)
    looked = room("looked", weights.embed.shape[1], time, columns)
    np.take(np.ascontiguousarray(weights.embed.T), streams[:, fill], axis=1, mode="clip", out=looked)
    full = int(lengths.min())
    inside = (np.arange(full, time)[:, None] < lengths[fill]).astype(np.float32)
    # Windows are columns and rows hold both directions, so that each gate is one stretch of memory; the products are taken a direction and group.
    joint, products = room("joint", matrix.shape[3], 2, columns), room("products", matrix.shape[2], 2, columns)
    given, made = (x.reshape(-1, 2, groups, each).transpose(1, 2, 0, 3) for x in (joint, products))
    joint[:hidden], joint[-1] = 0.0, 1.0
    state, forward, backward = joint[:hidden], joint[hidden:-1, 0], joint[hidden:-1, 1]
    cell, bent = room("cell", hidden, 2, columns), room("bent", hidden, 2, columns)
    cell[:] = 0.0
    gates, ahead, behind = products[: 4 * hidden], products[4 * hidden :, 0], products[4 * hidden :, 1]
    sigmoids, (let, keep, show, new) = gates[: 3 * hidden], (gates[k * hidden : (k + 1) * hidden] for k in range(4))
    out = room("out", time, len(MARKED), columns)
    one, half = np.float32(1.0), np.float32(0.5)
    for t in range(time + 1):
        # The backward direction reads the windows from the end; its state stays zero until a window begins.
        back = time - 1 - t
        if t < time:
            forward[:], backward[:] = looked[:, t], looked[:, back]
        np.matmul(matrix, given, out=made)
        if t:
            early = t - 1 <= back
            for place, told, fresh in ((out[t - 1], ahead, early or t - 1 == back + 1), (out[back + 1], behind, early)):
                if fresh:
                    place[:] = told
                else:
                    np.add(place, told, out=place)
        if t == time:
            break
        np.tanh(gates, out=gates)
        # cell = sigmoid(keep) * cell + sigmoid(let) * new, with the halves taken together
        np.add(sigmoids, one, out=sigmoids)
        np.multiply(cell, keep, out=cell)
        np.multiply(let, new, out=let)
        np.add(cell, let, out=cell)
        np.multiply(cell, half, out=cell)
        np.tanh(cell, out=bent)
        np.multiply(bent, show, out=state)  # twice the hidden state
        if back >= full:
            np.multiply(state[:, 1], inside[back - full], out=state[:, 1])
            np.multiply(cell[:, 1], inside[back - full], out=cell[:, 1])
    return out


def scores_of(weights: Weights, own: np.ndarray) -> np.ndarray:
    """Emission scores (..., tags) from gains (..., tags MARKED); the outside tag has 0."""
    scores = np.zeros((*own.shape[:-1], TAGS), np.float32)
    scores[..., MARKED] = own
    scores[..., INSIDE] -= weights.stay
    return scores


def emissions(weights: Weights, batch: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Emission scores (time, windows, tags) of padded windows of symbols, over those of the outside tag."""
    return scores_of(weights, gains(weights, batch.T, lengths, Room()).transpose(0, 2, 1)[:, : len(batch)])


def viterbi(weights: Weights, scores: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Best tags of each text from padded emissions (texts, time, tags)."""
    step = weights.transitions + BARRED
    order = np.argsort(lengths, kind="stable")
    ends = lengths[order]
    rows = np.ascontiguousarray(scores[order].transpose(1, 2, 0))  # texts are columns, the longest last
    time, _, count = rows.shape
    best = np.empty_like(rows)
    best[0] = rows[0] + (weights.start + BARRED[0])[:, None]
    # An inside tag follows two tags only; the others may follow any.
    free = np.array([0, *BEGIN])
    from_any = np.ascontiguousarray(step[:, free])[:, :, None]
    from_begin, from_inside = step[BEGIN, INSIDE][:, None], step[INSIDE, INSIDE][:, None]
    for t in range(1, time):
        live = np.searchsorted(ends, t, side="right")
        last, now = best[t - 1, :, live:], best[t, :, live:]
        now[free] = (last[:, None] + from_any).max(axis=0)
        now[INSIDE] = np.maximum(last[BEGIN] + from_begin, last[INSIDE] + from_inside)
        now += rows[t, :, live:]
    tags = np.zeros((time, count), np.int8)
    into = step.T
    for t in range(time - 1, -1, -1):
        live, longer = np.searchsorted(ends, (t, t + 1), side="right")
        tags[t, live:longer] = best[t, :, live:longer].argmax(axis=0)
        if longer < count:  # what led to the tag of the next place
            tags[t, longer:] = (best[t, :, longer:].T + into[tags[t + 1, longer:]]).argmax(axis=1)
    out: list = [None] * count
    for column, row in enumerate(order.tolist()):
        out[row] = tags[: ends[column], column]
    return out


def may_leave(weights: Weights, own: np.ndarray) -> np.ndarray:
    """Which windows, from gains (time, tags, windows), have a stretch that may beat staying outside; for the others the best path is outside everywhere.

    Every item is one begin tag and a run of inside tags of its kind. The most a
    stretch can gain over the outside tag, with the best transitions anywhere, is
    found backwards for all windows and kinds together; a path gains at most the
    sum over its items, so if no single item can gain none can.
    """
    step = weights.transitions + BARRED
    enter = step[:, BEGIN].max(axis=0) - step[0, 0]
    leave = np.maximum(0, np.maximum(step[BEGIN, 0], step[INSIDE, 0]) - step[0, 0])
    first = np.maximum(0, weights.start[BEGIN] - weights.start[0] - enter)
    begins, stays, none = own[:, :KEPT], own[:, KEPT:], np.float32(0.0)
    ahead, best = np.zeros_like(begins[0]), np.empty_like(begins[0])
    top = np.full_like(best, -np.inf)
    for t in range(len(own) - 1, 0, -1):
        np.add(begins[t], ahead, out=best)
        np.maximum(top, best, out=top)
        np.add(ahead, stays[t], out=ahead)
        np.maximum(ahead, none, out=ahead)
    np.maximum(top, begins[0] + ahead + first[:, None], out=top)
    return (top + (enter + leave)[:, None] >= 0).any(axis=0)


def spans_of(tags: np.ndarray) -> list[tuple[int, int, str]]:
    """(first, end, kind) of each item."""
    out, start, kind = [], None, -1
    for t, tag in enumerate(tags.tolist()):
        if start is not None and (tag == 0 or tag % 2 == 1):
            out.append((start, t, KINDS[kind]))
            start = None
        if tag and tag % 2 == 1:
            start, kind = t, (tag - 1) // 2
    if start is not None:
        out.append((start, len(tags), KINDS[kind]))
    return out


def windows_of(length: int, window: int = WINDOW, margin: int = MARGIN) -> list[tuple[int, int]]:
    """Overlapping windows of a text; neighbours share ``2 * margin`` characters."""
    if length <= window:
        return [(0, length)]
    stride = window - 2 * margin
    starts = list(range(0, length - window, stride)) + [length - window]
    return [(s, s + window) for s in starts]


def padded(parts: list[np.ndarray], rest: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of different lengths as one, with the lengths."""
    lengths = np.array([len(x) for x in parts])
    out = np.full((len(parts), int(lengths.max()), *parts[0].shape[1:]), rest, parts[0].dtype)
    for row, part in enumerate(parts):
        out[row, : len(part)] = part
    return out, lengths


def find_spans(weights: Weights, texts: list[str], batch_windows: int = WINDOWS, window: int = WINDOW, margin: int = MARGIN) -> list[list[tuple[int, int, str]]]:
    """The personal items of each text as character spans; blank texts have none."""
    found: list[list[tuple[int, int, str]]] = []
    room, at = Room(), 0
    while at < len(texts):
        start, size = at, 0
        while at < len(texts) and (at == start or size + len(texts[at] or "") <= AT_ONCE):
            size += len(texts[at] or "")
            at += 1
        found += _find(weights, texts[start:at], batch_windows, window, margin, room)
    return found


def _find(weights: Weights, texts: list[str], batch_windows: int, window: int, margin: int, room: Room) -> list[list[tuple[int, int, str]]]:
    live = [t if t and not t.isspace() else "" for t in texts]
    coded = symbols("".join(live))
    sizes = np.array([len(t) for t in live], np.int64)
    starts = np.cumsum(sizes) - sizes
    short, long_ = np.flatnonzero((sizes > 0) & (sizes <= window)), np.flatnonzero(sizes > window)
    cut = np.array([(i, low, high - low) for i in long_.tolist() for low, high in windows_of(int(sizes[i]), window, margin)], np.int64).reshape(-1, 3)
    owner, low, length = (np.concatenate(x) for x in ((short, cut[:, 0]), (np.zeros_like(short), cut[:, 1]), (sizes[short], cut[:, 2])))
    order = np.argsort(length, kind="stable")
    parts: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    open_: dict[int, np.ndarray] = {}
    at = 0
    while at < len(order):
        # Fewer windows at a time where they are long; their number is no multiple of a power of two, at which rows would take each other's place in the cache.
        chunk = order[at : at + batch_windows]
        chunk = chunk[: max(16, CELLS // int(length[chunk[-1]]) // 32 * 32 - 16)]
        at += len(chunk)
        own_length = length[chunk]
        places = np.arange(int(own_length[-1]))[:, None]
        streams = np.where(places < own_length, coded.take((starts[owner[chunk]] + low[chunk]) + places, mode="clip"), np.uint8(PAD))
        own = gains(weights, streams, own_length, room)
        leaves, whole = may_leave(weights, own)[: len(chunk)], own_length == sizes[owner[chunk]]
        for row in np.flatnonzero(leaves | ~whole).tolist():
            i, first, size = int(owner[chunk[row]]), int(low[chunk[row]]), int(own_length[row])
            taken = own[:size, :, row].copy()
            if whole[row]:
                open_[i] = taken
            else:
                parts.setdefault(i, []).append((first, first + size, taken))
    for chunk in batches_by_length(parts, sizes, batch_windows):
        joined = [stitched(sorted(parts.pop(i), key=lambda p: p[0])) for i in chunk]
        own = padded(joined, -1e9)[0].transpose(1, 2, 0)
        for row in np.flatnonzero(may_leave(weights, np.ascontiguousarray(own))):
            open_[chunk[row]] = joined[row]
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for chunk in batches_by_length(open_, sizes, batch_windows):
        own, lengths = padded([open_[i] for i in chunk])
        for i, tags in zip(chunk, viterbi(weights, scores_of(weights, own), lengths)):
            found[i] = spans_of(tags)
    return found


def batches_by_length(which, sizes: np.ndarray, most: int) -> Iterator[list[int]]:
    """Texts of like length together; few at a time where they are long."""
    order = sorted(which, key=lambda i: sizes[i])
    at = 0
    while at < len(order):
        size = max(1, min(most, (1 << 18) // int(sizes[order[min(at + most, len(order)) - 1]])))
        yield order[at : at + size]
        at += size


def stitched(parts: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """The gains of a text from those of its windows; the seam of two lies in the middle of what they share."""
    whole = np.empty((parts[-1][1], len(MARKED)), np.float32)
    for k, (low, high, scores) in enumerate(parts):
        start = low if k == 0 else (low + parts[k - 1][1]) // 2
        whole[start:high] = scores[start - low :]
    return whole
