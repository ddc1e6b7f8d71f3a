"""Exact resampling with replacement by splitting draws down a tree of blocks.

``n`` draws of each replicate are divided between two halves of the rows by a
binomial with the left half's share, then inside each half, down to blocks of
BLOCK rows; inside a block they fall on rows uniformly.  That is a multinomial
over all rows: each replicate's weights sum to ``n``.  A node's division
depends only on the seed and on its range of blocks, so any task finds the weights
of its own rows by walking from the root, and a repeated task finds the same.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024


class DrawTree:
    """Draws of ``replicates`` resamples of as many rows as there are.  Rows lie in
    slices of ``sizes`` rows, blocks do not cross slices."""

    def __init__(self, sizes: list[int], replicates: int, seed: int, block: int = BLOCK):
        self.sizes = np.asarray(sizes, np.int64)
        self.rows_before = np.concatenate(([0], np.cumsum(self.sizes)))
        self.blocks_before = np.concatenate(([0], np.cumsum(-(-self.sizes // block))))
        self.replicates, self.seed, self.block = replicates, seed, block
        root = np.full(replicates, self.rows_before[-1], np.int64)
        self.path = [(0, int(self.blocks_before[-1]), root)]

    def number(self, slice_: int, at: int) -> int:
        """The block of a row."""
        return int(self.blocks_before[slice_]) + at // self.block

    def _start(self, b: int) -> int:
        """Rows before block ``b``."""
        s = int(np.searchsorted(self.blocks_before, b, "right")) - 1
        if s >= len(self.sizes):
            return int(self.rows_before[-1])
        return int(self.rows_before[s] + min((b - self.blocks_before[s]) * self.block, self.sizes[s]))

    def draws(self, b: int) -> np.ndarray:
        """How many draws of each replicate fall on block ``b``.  The path to the
        last block asked for is kept, so neighbours share their walk."""
        while not self.path[-1][0] <= b < self.path[-1][1]:
            self.path.pop()
        while self.path[-1][1] - self.path[-1][0] > 1:
            lo, hi, here = self.path[-1]
            mid = (lo + hi) // 2
            first, last = self._start(lo), self._start(hi)
            share = (self._start(mid) - first) / (last - first)
            left = np.random.default_rng([self.seed, lo, hi]).binomial(here, share)
            self.path.append((lo, mid, left) if b < mid else (mid, hi, here - left))
        return self.path[-1][2]

    def weights(self, b: int) -> np.ndarray:
        """(replicates, rows of block b): how often each row is drawn."""
        draws, size = self.draws(b), self._start(b + 1) - self._start(b)
        picks = np.random.default_rng([self.seed, b]).integers(0, size, int(draws.sum()))
        where = np.repeat(np.arange(self.replicates, dtype=np.int64) * size, draws) + picks
        return np.bincount(where, minlength=self.replicates * size).reshape(self.replicates, size)
