"""Circles held in cells of the plane, for streams that compare each new one with those around it."""

from __future__ import annotations

from collections import defaultdict
from math import floor, sqrt

import pyarrow as pa


class Leaders:
    """Clusters in the order in which they were founded; each lies in the cell of its running mean and moves with it."""

    def __init__(self, centre: float, radius: float) -> None:
        self.centre, self.radius = centre, radius
        self.sums: list[list[float]] = []  # n, x, y, r
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.cell_of: list[tuple[int, int]] = []

    def _cell(self, x: float, y: float) -> tuple[int, int]:
        return floor(x / self.centre), floor(y / self.centre)

    def take(self, x: float, y: float, r: float) -> int:
        """The cluster that the detection joins: the first that is near, or a new one."""
        i, j = self._cell(x, y)
        best = -1
        for a in (i - 1, i, i + 1):
            for b in (j - 1, j, j + 1):
                for c in self.cells.get((a, b), ()):
                    if best < 0 or c < best:
                        n, sx, sy, sr = self.sums[c]
                        if sqrt((x - sx / n) ** 2 + (y - sy / n) ** 2) <= self.centre and abs(r - sr / n) <= self.radius:
                            best = c
        if best < 0:
            best = len(self.sums)
            self.sums.append([1, x, y, r])
            self.cell_of.append((i, j))
            self.cells[i, j].append(best)
            return best
        own = self.sums[best]
        own[0] += 1
        own[1] += x
        own[2] += y
        own[3] += r
        now = self._cell(own[1] / own[0], own[2] / own[0])
        if now != self.cell_of[best]:
            self.cells[self.cell_of[best]].remove(best)
            self.cells[now].append(best)
            self.cell_of[best] = now
        return best

    def rows(self, of: pa.RecordBatch, key: list[str]) -> pa.RecordBatch:
        """A row for every cluster, under the key of the first row of ``of``."""
        n = len(self.sums)
        owner = of.take(pa.array([0] * n, pa.int64()))
        means = [pa.array([s[i] / s[0] for s in self.sums], pa.float64()) for i in (1, 2, 3)]
        columns = [*(owner[k] for k in key), pa.array(range(n), pa.int64()), pa.nulls(n, pa.int64()), pa.array([s[0] for s in self.sums], pa.int64()), *means]
        return pa.RecordBatch.from_arrays(columns, [*key, "cluster", "f", "n", "x", "y", "r"])


class Apart:
    """Circles kept because they lie apart: from each other by ``factor`` times the smaller radius, or by a distance that the new one brings."""

    def __init__(self, factor: float | None) -> None:
        self.factor = factor
        self.kept: list[tuple[float, float, float]] = []
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        self.side = 0.0

    def take(self, x: float, y: float, r: float, gap: float) -> bool:
        """Whether the circle is kept."""
        reach = self.factor * r if self.factor is not None else gap  # no kept circle beyond conflicts
        self.side = self.side or max(reach, 1.0)
        i, j, span = floor(x / self.side), floor(y / self.side), floor(max(reach, 0.0) / self.side) + 1
        if (2 * span + 1) ** 2 > len(self.kept):
            around = range(len(self.kept))
        else:
            around = (c for a in range(i - span, i + span + 1) for b in range(j - span, j + span + 1) for c in self.cells.get((a, b), ()))
        for c in around:
            kx, ky, kr = self.kept[c]
            if sqrt((kx - x) ** 2 + (ky - y) ** 2) < (self.factor * min(kr, r) if self.factor is not None else gap):
                return False
        self.cells[i, j].append(len(self.kept))
        self.kept.append((x, y, r))
        return True
