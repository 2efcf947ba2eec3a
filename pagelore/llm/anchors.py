"""Anchored runs: windows of a text, told apart by content and independent of position.

Each window of a sequence is represented by its anchor, the leftmost lowest
gram (by hash) inside it; grams known to be frequent come last. Equal windows
have equal anchors at equal places, so windows can only be equal if their
anchors are; consecutive windows with one anchor form a run, and runs are a few
per window length.
"""

from __future__ import annotations

import numpy as np

from pagelore.llm.common import SpanHash, mix

#: Windows that are scanned at a time; positions fit the low bits of a scan key.
CHUNK = 1 << 20
LOW = np.uint64((1 << 24) - 1)
LAST = np.uint64(1 << 63)


def groups(*keys: np.ndarray) -> np.ndarray:
    """Whether a row begins a group, for rows sorted by keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Frequent:
    """A set of gram hashes; most others are told by a small table."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.sort(hashes)
        self.shift = np.uint64(64 - max(10, (16 * len(hashes)).bit_length()))
        self.maybe = np.zeros(1 << int(64 - int(self.shift)), bool)
        self.maybe[(self.hashes >> self.shift).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        if len(self.hashes):
            at = np.flatnonzero(self.maybe[(h >> self.shift).astype(np.int64)])
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            out[at] = self.hashes[i] == h[at]
        return out


def gram_hashes(symbols: np.ndarray, first: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram that lies inside a text, and its text."""
    size = np.maximum(np.diff(first) - gram + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + first[:-1][text]
    return mix(SpanHash(symbols)(at, at + gram)), text


class Runs:
    """Runs of all windows of a batch of texts: arrays at (place of the first window), text, start (in the text), count and anchor hash."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, window: int, gram: int, frequent: Frequent):
        """symbols: uint64, one for each symbol; first: where texts begin (n + 1)."""
        n = len(symbols)
        hashed = SpanHash(symbols)
        windows = np.maximum(np.diff(first) - window + 1, 0)
        starts, anchors, new = [], [], []
        span = window - gram + 1
        ok = np.zeros(n + 1, np.int8)
        some = windows > 0
        np.add.at(ok, first[:-1][some], 1)
        np.add.at(ok, (first[:-1] + windows)[some], -1)
        valid = np.cumsum(ok[:n], dtype=np.int8).astype(bool)
        for lo in range(0, n, CHUNK):
            hi = min(lo + CHUNK, n - window + 1)
            if hi <= lo:
                break
            at = np.arange(lo, hi + span - 1)
            h = mix(hashed(at, at + gram))
            key = ((h >> np.uint64(1)) & ~LOW) | (at - lo).astype(np.uint64)
            key[frequent(h)] |= LAST
            width = 1
            while 2 * width <= span:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            key = np.minimum(key[: hi - lo], key[span - width :][: hi - lo])
            anchor = (key & LOW).astype(np.int64) + lo
            good = valid[lo:hi]
            cut = np.ones(hi - lo, bool)
            cut[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1])
            cut = np.flatnonzero(cut)
            end = np.append(cut[1:], hi - lo)
            use = good[cut]
            starts.append(cut[use] + lo)
            new.append((end - cut)[use])
            anchors.append(anchor[cut[use]])
        empty = [np.zeros(0, np.int64)]
        self.at, self.count, anchor = (np.concatenate(x or empty) for x in (starts, new, anchors))
        self.text = np.searchsorted(first, self.at, "right") - 1
        self.start = self.at - first[self.text]
        self.anchor = mix(hashed(anchor, anchor + gram))
