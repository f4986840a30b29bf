"""Words of byte strings as 64-bit hashes, found with array operations a bounded slice at a time."""

from __future__ import annotations

import re

import numpy as np

from pulseframe.llm.chunks import mixed
from pulseframe.llm.substrings import BYTE_BASE, powers

SLICE_BYTES = 1 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class WordHashes:
    """Finds maximal runs of the bytes in ``members`` and hashes each; two different words agree
    by chance once in 2^64."""

    def __init__(self, members: bytes) -> None:
        self.member = np.zeros(256, bool)
        self.member[list(members)] = True
        self.outside = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in range(256) if not self.member[c]) + b"]")
        self.up = self.down = np.zeros(0, np.uint64)

    def _cuts(self, data: bytes) -> list[tuple[int, int]]:
        """Slices that end where no word does go on; a longer word makes a longer slice."""
        cuts, low = [], 0
        while low < len(data):
            end = self.outside.search(data, low + SLICE_BYTES)
            cuts.append((low, end.start() if end else len(data)))
            low = cuts[-1][1]
        return cuts

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, stop and hash of each word, in order."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for low, high in self._cuts(data):
            part = np.frombuffer(data, np.uint8, high - low, low)
            if len(self.up) < len(part):
                reach = max(len(part), SLICE_BYTES + 4096)
                self.up, self.down = powers(BYTE_BASE, reach), powers(pow(BYTE_BASE, -1, 1 << 64), reach)
            edges = np.diff(self.member[part].astype(np.int8), prepend=0, append=0)
            starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)], out=sums[1:])
            hashes = mixed((sums[stops] - sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))
            found.append((starts + low, stops + low, hashes))
        return tuple(np.concatenate(x) for x in zip(*found))
