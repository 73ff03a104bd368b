"""Small dictionaries that a task keeps while it encodes: numbers of words, and lists of ids by number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Odd factors of the mixing of 64 bits, and the seeds of the two halves of a digest. Fixed values.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def digests(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each string, as two arrays: sums of mixed (place, byte), taken over the whole buffer at once."""
    if not len(words):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    offset = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offset[0] : offset[-1]]
    offset = offset - offset[0]
    size = np.diff(offset)
    place = (np.arange(len(data)) - np.repeat(offset[:-1], size)).astype(np.uint64)
    cell, out = (place << np.uint64(8)) | data, []
    for seed in SEEDS:
        upto = np.r_[np.uint64(0), np.cumsum(mixed(cell + np.uint64(seed)))]
        out.append(mixed(upto[offset[1:]] - upto[offset[:-1]] + size.astype(np.uint64)))
    return out[0], out[1]


class Numbers:
    """Numbers of words in order of arrival, by a digest of 128 bits: 20 bytes a word."""

    def __init__(self):
        self.high, self.low, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)

    def __len__(self) -> int:
        return len(self.number)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of distinct words, and the places of those that are new."""
        high, low = digests(words)
        order = np.argsort(high)  # sorted look-ups meet the table in order
        h, w = high[order], low[order]
        place = np.searchsorted(self.high, h)
        found = np.zeros(len(h), bool)
        if len(self):
            near = np.minimum(place, len(self) - 1)
            found = (self.high[near] == h) & (self.low[near] == w)
        number = np.empty(len(h), np.int32)
        number[order[found]] = self.number[near[found]] if len(self) else 0
        fresh = ~found
        new = np.sort(order[fresh])
        number[new] = len(self) + np.arange(len(new))
        place = place[fresh]
        self.high, self.low, self.number = (np.insert(own, place, x) for own, x in ((self.high, h[fresh]), (self.low, w[fresh]), (self.number, number[order[fresh]])))
        return number, new


class Lists:
    """Lists of ids in one flat array, numbered in order of arrival."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray, at: np.ndarray | None = None, more: np.ndarray | None = None, more_size: np.ndarray | None = None) -> None:
        """Lists of the given sizes, laid out in flat; those at the places `at` are empty there and laid out in `more`."""
        start = len(self.flat) + np.cumsum(size) - size
        if at is not None and len(at):
            size[at], start[at] = more_size, len(self.flat) + len(flat) + np.cumsum(more_size) - more_size
            flat = np.r_[flat, more.astype(np.uint32)]
        self.flat, self.start, self.size = np.r_[self.flat, flat.astype(np.uint32)], np.r_[self.start, start], np.r_[self.size, size]

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists, in a row, and their numbers."""
        size = self.size[which]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.arange(total) - np.repeat(end - size, size) + np.repeat(self.start[which], size)], size
