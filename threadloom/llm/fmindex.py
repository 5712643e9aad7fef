"""A compressed full-text index over sequences of 64-bit symbols: suffix order kept as bit-packed psi, backward search, sampled locate.

The text is all sequences, each closed by the separator 0. psi maps the row of a suffix to the row of the suffix one
symbol shorter; within the rows of one symbol it rises, so a rank is a binary search and a step of backward search needs
two of them. Where a suffix starts is known for every `every`-th place and found from there by following psi. The index
holds its text: following psi from the first row of a sequence reads it off. All numbers take as many bits as the largest
needs and stay packed in memory; only the alphabet (distinct symbols and their first rows) is plain.
"""

from __future__ import annotations

import io

import numpy as np


class Packed:
    """Whole numbers of a fixed number of bits, read at any places without unpacking the rest."""

    def __init__(self, data: np.ndarray, width: int) -> None:
        self.data, self.width = data, int(width)
        self.words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.tobytes(), strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray) -> Packed:
        width = max(1, int(values.max(initial=0)).bit_length())
        parts = []
        for i in range(0, len(values), 1 << 16):  # a multiple of eight, so parts end with whole bytes
            bits = (values[i : i + (1 << 16), None].astype(np.uint64) >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            parts.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"))
        return cls(np.concatenate([*parts, np.zeros(8, np.uint8)]), width)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        bit = np.asarray(at, np.int64) * self.width
        return ((self.words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)).astype(np.int64)


def suffix_order(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; text holds small integers."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (rank.max() + 2 if n else 1) + nxt
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])] if n else order
        rank = np.empty(n, np.int64)
        rank[order] = new
        if not n or new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Index:
    PACKED = ("psi", "doc", "place", "first", "lengths")
    PLAIN = ("alphabet", "start", "marks", "before")

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        for name in self.PACKED:
            setattr(self, name, Packed(parts[name], parts[f"{name}_width"]))
        for name in self.PLAIN:
            setattr(self, name, parts[name])
        self.rows = int(self.start[-1])

    @classmethod
    def build(cls, values: np.ndarray, lengths: np.ndarray, every: int = 4) -> Index:
        """values: the symbols of all sequences one after another; sequence d has lengths[d] of them."""
        alphabet, ids = np.unique(values, return_inverse=True)
        text = np.insert(ids + 1, np.cumsum(lengths), 0)
        order = suffix_order(text)
        row_of = np.empty(len(text), np.int64)
        row_of[order] = np.arange(len(text))
        begin = np.cumsum(lengths + 1) - lengths - 1
        doc = np.repeat(np.arange(len(lengths)), lengths + 1)
        place = np.arange(len(text)) - np.repeat(begin, lengths + 1)
        sampled = (place[order] % every == 0) | (text[order] == 0)
        bits = np.packbits(np.r_[sampled, np.zeros(-len(sampled) % 64, bool)], bitorder="little").view("<u8")
        parts = {"alphabet": alphabet, "start": np.searchsorted(text[order], np.arange(len(alphabet) + 2)).astype(np.int64), "marks": bits}
        parts["before"] = (np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)).astype(np.uint32)
        numbers = {"psi": row_of[(order + 1) % max(1, len(text))], "doc": doc[order[sampled]], "place": place[order[sampled]], "first": row_of[begin], "lengths": lengths}
        for name, x in numbers.items():
            packed = Packed.of(x)
            parts |= {name: packed.data, f"{name}_width": np.array(packed.width)}
        return cls(parts)

    def symbols(self, values: np.ndarray) -> np.ndarray:
        """Ids of symbols, -1 for those the index doesn't have."""
        if not len(self.alphabet):
            return np.full(len(values), -1)
        at = np.minimum(np.searchsorted(self.alphabet, values), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == values, at + 1, -1)

    def _first_from(self, symbol: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first row of each symbol whose psi is at least so large."""
        lo, hi = self.start[symbol], self.start[symbol + 1]
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            open_ = lo < hi
            less = open_ & (self.psi[np.minimum(mid, self.rows - 1)] < least)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        return lo

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of symbol + pattern, from those of pattern."""
        return self._first_from(symbol, low), self._first_from(symbol, high)

    def locate(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place of the suffixes of these rows."""
        steps = np.zeros(len(row), np.int64)
        at = np.array(row, np.int64)
        while (open_ := np.flatnonzero(~self._sampled(at))).size:
            at[open_] = self.psi[at[open_]]
            steps[open_] += 1
        word = self.marks[at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        k = self.before[at >> 6].astype(np.int64) + np.bitwise_count(word)
        return self.doc[k], self.place[k] - steps

    def _sampled(self, at: np.ndarray) -> np.ndarray:
        return (self.marks[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def read(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of these sequences one after another, and how many each has; read off psi."""
        n = self.lengths[doc]
        out, begin = np.zeros(n.sum(), np.int64), np.cumsum(n) - n
        row, step, left = self.first[doc], 0, np.flatnonzero(n > 0)
        while left.size:
            out[begin[left] + step] = np.searchsorted(self.start, row[left], side="right") - 1
            row[left] = self.psi[row[left]]
            step += 1
            left = left[n[left] > step]
        return out, n

    def dump(self) -> bytes:
        out = io.BytesIO()
        packed = {k: v for name in self.PACKED for k, v in ((name, getattr(self, name).data), (f"{name}_width", np.array(getattr(self, name).width)))}
        np.savez(out, **packed, **{name: getattr(self, name) for name in self.PLAIN})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Index:
        with np.load(io.BytesIO(data)) as z:
            return cls({k: z[k] for k in z.files})
