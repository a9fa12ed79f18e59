"""Numpy part of the context mixing model: quantised counts of contexts, gated mixer, adaptive refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

END = 255  # never occurs in UTF-8; ends a text and stands for what is before it
ORDERS = 6  # contexts of 0 to 5 bytes
SLOT_BITS = (8, 16, 24)  # a slot for every context of 0 to 2 bytes and node; longer ones are counted from their codes
DENSE = len(SLOT_BITS)
RANGE_BITS = 18  # counts travel by ranges of so many slots
GATES = 64
BINS = 33
PARAMS = GATES * (ORDERS + 1) + 256 * ORDERS
_K = np.uint64(0x9E3779B97F4A7C15)
_R = np.uint64(0xD6E8FEB86659FD93)

# counts of 0 to 31 are exact, larger ones have steps of 6 %
_STEPS = np.concatenate([np.arange(32.0), 32 * 1.06 ** np.arange(1, 225)])


def quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of each slot in 16 bits; large pairs are scaled down together."""
    top = np.maximum(zeros, ones)
    scale = np.where(top > 1e7, 1e7 / np.maximum(top, 1), 1.0)
    put = lambda n: np.searchsorted(_STEPS, n * scale, "right") - 1
    return (put(zeros) | (put(ones) << 8)).astype(np.uint16)


def _lookups() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit pair, as it is, and without one zero or one one: stretched probability, and confidence 0 to 3."""
    q = np.arange(1 << 16)
    n0, n1 = _STEPS[q & 255], _STEPS[q >> 8]
    st, cf = [], []
    for less0, less1 in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(n0 - less0, 0), np.maximum(n1 - less1, 0)
        st.append(np.log((b + 0.1) / (a + 0.1)))
        cf.append(np.digitize(a + b, [1, 3, 16]))
    return np.array(st, np.float32), np.array(cf, np.int8)


ST, CF = _lookups()


def codes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 48-bit code (5 bytes of context, then the byte) for each byte of each text and for its end; and each text's number of codes."""
    pad = bytes([END]) * 5
    b = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    code = b[:-5].astype(np.int64)
    for j in range(1, 6):
        code <<= 8
        code |= b[j : len(b) - 5 + j]
    # windows that begin in one text and end in the next text's padding
    keep = np.ones(len(code), bool)
    ends = np.cumsum(lengths + 5) - 5
    for j in range(5):
        at = ends[:-1] + j
        keep[at] = False
    return code[keep], lengths


def starts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and how often each occurs."""
    code = np.sort(code)
    first = starts_of(code)
    return code[first], np.diff(np.append(first, len(code)))


def slots(code: np.ndarray, node: np.ndarray, order: int) -> np.ndarray:
    """Slot of (last `order` bytes, bits of the byte so far)."""
    return (((code >> 8) & ((1 << 8 * order) - 1)) << 8) | node


def kin(code: np.ndarray) -> np.ndarray:
    """Hash of the last 3 bytes of context: codes that share a context of 3 bytes or more share it."""
    return (((code >> 8) & 0xFFFFFF).astype(np.uint64) + np.uint64(1)) * _K


def slices(code: np.ndarray, size: int = 1 << 17) -> Iterator[np.ndarray]:
    """Positions of the codes in parts of about `size`, none of which cuts a context of 3 bytes."""
    h = kin(code)
    order = np.argsort(h, kind="stable")
    h = h[order]
    starts = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
    at = 0
    while at < len(h):
        end = int(starts[min(np.searchsorted(starts, at + size), len(starts) - 1)])
        yield order[at:end]
        at = end


def cells(code: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Quantised counts of each code's contexts of 3 to 5 bytes (order, decision, code), exact when all codes of these contexts are given."""
    out = np.empty((ORDERS - DENSE, 8, len(code)), np.uint16)
    for k in range(DENSE, ORDERS):
        key = code & ((1 << 8 * (k + 1)) - 1)
        order = np.argsort(key, kind="stable")
        key, n = key[order], count[order].astype(float)
        for j in range(8):
            group = key >> (8 - j)
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(key)])
            ones, both = (np.add.reduceat(x, first) if len(first) else n for x in (n * ((key >> (7 - j)) & 1), n))
            out[k - DENSE, j, order] = np.repeat(quantised(both - ones, ones), np.diff(np.append(first, len(key))))
    return out


def bits_of(code: np.ndarray):
    """The eight decisions of each code's byte: node (bits so far, behind a leading 1) and bit."""
    byte = code & 255
    for j in range(8):
        yield (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


@dataclass
class Model:
    tables: list[np.ndarray]  # uint16 for each order below DENSE
    params: np.ndarray = field(default_factory=lambda: start_params())
    refine: np.ndarray | None = None  # probability for each (node, bin)

    def inputs(self, code: np.ndarray, node: np.ndarray, bit: np.ndarray | None, longer: np.ndarray):
        """Stretched predictions of all orders, and the gate. With bit, the code's own occurrence is left out. longer: cells of the longer orders."""
        st = np.empty((ORDERS, len(code)), np.float32)
        gate = np.zeros(len(code), np.int64)
        for k in range(ORDERS):
            q = self.tables[k][slots(code, node, k)] if k < DENSE else longer[k - DENSE]
            if bit is None:
                st[k] = ST[0][q]
                cf = CF[0][q] if k >= 3 else None
            else:
                own = np.where(bit == 1, 2, 1)
                st[k] = ST[own, q]
                cf = CF[own, q] if k >= 3 else None
            if k >= 3:
                gate = gate * 4 + cf
        return st, gate

    def mixed(self, st: np.ndarray, gate: np.ndarray, node: np.ndarray) -> np.ndarray:
        by_gate = self.params[: GATES * (ORDERS + 1)].reshape(GATES, ORDERS + 1)
        by_node = self.params[GATES * (ORDERS + 1) :].reshape(256, ORDERS)
        x = by_gate[gate, ORDERS].copy()
        for k in range(ORDERS):
            x += (by_gate[gate, k] + by_node[node, k]) * st[k]
        return x

    def probability(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Of a 1, after refinement."""
        p = _squash(x)
        if self.refine is not None:
            p = (p + self.refine[node, bin_of(x)]) / 2
        return np.clip(p, 1e-6, 1 - 1e-6)

    def costs(self, code: np.ndarray, count: np.ndarray | None = None) -> np.ndarray:
        """log10 probability of each code's byte after its context. count: occurrences in training; codes must hold all of their longer contexts' then."""
        out = np.zeros(len(code))
        for at in slices(code):
            c = code[at]
            longer = cells(c, np.zeros(len(c)) if count is None else count[at])
            for j, (node, bit) in enumerate(bits_of(c)):
                st, gate = self.inputs(c, node, None, longer[:, j])
                p = self.probability(self.mixed(st, gate, node), node)
                out[at] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def start_params() -> np.ndarray:
    by_gate = np.zeros((GATES, ORDERS + 1))
    by_gate[:, :ORDERS] = 0.25
    return np.concatenate([by_gate.reshape(-1), np.zeros(256 * ORDERS)])


def bin_of(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x * 2), -16, 16).astype(np.int64) + 16


def learn(model: Model, code: np.ndarray, count: np.ndarray, batch: int = 1024, rate: float = 0.15, passes: int = 2) -> None:
    """Online gradient steps (scaled by past gradients) over the codes in hashed order, each weighed by its occurrences.

    The codes must hold all of their contexts of 3 bytes.
    """
    past = np.full(PARAMS, 1e-6)
    for _ in range(passes):
        for part in slices(code):
            _learn_part(model, code[part], count[part], past, batch, rate)


def _learn_part(model: Model, code: np.ndarray, count: np.ndarray, past: np.ndarray, batch: int, rate: float) -> None:
    order = np.argsort((code.astype(np.uint64) + np.uint64(1)) * _K * _R)
    longer = cells(code, count)
    cut = GATES * (ORDERS + 1)
    for at in range(0, len(code), batch):
        own = order[at : at + batch]
        c = np.repeat(code[own], 8)
        w = np.repeat(count[own].astype(float), 8)
        byte, j = c & 255, np.tile(np.arange(8), len(own))
        node, bit = (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1
        st, gate = model.inputs(c, node, bit, longer[:, :, own].transpose(0, 2, 1).reshape(ORDERS - DENSE, -1))
        err = (_squash(model.mixed(st, gate, node)) - bit) * (w / w.sum() * 8)
        grad = np.zeros(PARAMS)
        for k in range(ORDERS):
            e = err * st[k]
            grad[:cut].reshape(GATES, ORDERS + 1)[:, k] = np.bincount(gate, e, GATES)
            grad[cut:].reshape(256, ORDERS)[:, k] = np.bincount(node, e, 256)
        grad[:cut].reshape(GATES, ORDERS + 1)[:, ORDERS] = np.bincount(gate, err, GATES)
        past += grad * grad
        model.params -= rate * grad / np.sqrt(past)


def refinement(model: Model, code: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ones, all) for each (node, bin of the mixer's output), occurrences counted, own ones left out of the prediction."""
    ones, total = np.zeros(256 * BINS), np.zeros(256 * BINS)
    for part in slices(code):
        c, w = code[part], count[part].astype(float)
        longer = cells(c, w)
        for j, (node, bit) in enumerate(bits_of(c)):
            st, gate = model.inputs(c, node, bit, longer[:, j])
            i = node * BINS + bin_of(model.mixed(st, gate, node))
            total += np.bincount(i, w, 256 * BINS)
            ones += np.bincount(i, w * bit, 256 * BINS)
    return ones, total


def refined(ones: np.ndarray, total: np.ndarray, weight: float = 50.0) -> np.ndarray:
    prior = np.tile(_squash((np.arange(BINS) - 16) / 2), 256)
    return ((ones + weight * prior) / (total + weight)).reshape(256, BINS)
