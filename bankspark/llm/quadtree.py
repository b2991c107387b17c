"""K-squared quadtrees (K = 2) of count matrices, and the joint traversal of two groups' rows.

A tile of SIDE rows and SIDE columns is halved in both directions again and again; only quadrants that hold a
count are kept, as a number in bit-interleaved order, with the first of its children and a mask of which there are.
"""

from __future__ import annotations

import numpy as np

HEIGHT = 6
SIDE = 1 << HEIGHT
# Pairs of quadrants that are looked at together.
ITEMS_AT_ONCE = 1 << 19
_PARTS = 1_000_000_000


def price(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (n + 1) / total) in whole numbers, for totals below 9 * 10 ** 15."""
    if len(total) and int(total.max()) > (1 << 63) // 1000:
        raise OverflowError("totals above 9 * 10 ** 15")
    out, rest = np.zeros(len(n), np.int64), n + 1
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q)."""
    return (p - q) ** 2 // q


def _spread(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for bit in range(HEIGHT):
        out |= (x >> bit & 1) << 2 * bit
    return out


class Quadtree:
    """Tree over some tiles of a matrix, from its cells: tile, row and column in the tile, and a value each."""

    def __init__(self, tile: np.ndarray, row: np.ndarray, column: np.ndarray, values: np.ndarray):
        code = tile << 2 * HEIGHT | _spread(row) << 1 | _spread(column)
        order = np.argsort(code, kind="stable")
        self.values = values[order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        codes = code[order]
        for _ in range(HEIGHT):
            up = codes >> 2
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(up)), bool), up[1:] != up[:-1])))
            mask = np.bitwise_or.reduceat(np.int64(1) << (codes & 3), first) if len(first) else np.empty(0, np.int64)
            self.levels.append((first, mask))
            codes = up[first]
        self.tiles = codes

    def roots(self, tiles: np.ndarray) -> np.ndarray:
        """Node of each tile, -1 for a tile without a cell."""
        if not len(self.tiles):
            return np.full(len(tiles), -1, np.int64)
        at = np.minimum(np.searchsorted(self.tiles, tiles), len(self.tiles) - 1)
        return np.where(self.tiles[at] == tiles, at, -1)

    def child(self, level: int, node: np.ndarray, quadrant: int) -> np.ndarray:
        """The node's child in a quadrant (row half, column half), -1 if that is all zero."""
        first, mask = self.levels[level - 1]
        if not len(first):
            return np.full(len(node), -1, np.int64)
        there = (node >= 0) & (mask[node] >> quadrant & 1 == 1)
        lower = np.bitwise_count(mask[node] & ((1 << quadrant) - 1)).astype(np.int64)
        return np.where(there, first[node] + lower, -1)


def pair_gaps(a: Quadtree, b: Quadtree, rows: tuple[int, int], empty: tuple[np.ndarray, np.ndarray], tiles: np.ndarray,
              columns: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of ``gap`` over the columns of some tiles, for each two rows of two trees (or each two of one tree).

    Values of the trees are prices; ``empty`` holds the price of a cell without a count in each row, ``columns``
    the number of columns of each tile. Gives (SIDE, SIDE) arrays: the gaps of a's rows from b's, those of b's
    from a's, and how many columns were left out because both rows are empty there.
    """
    one, other, blank = (np.zeros((SIDE, SIDE), np.int64) for _ in range(3))
    step = max(1, ITEMS_AT_ONCE // (max(1, rows[0] * rows[1]) * SIDE))
    for k in range(0, len(tiles), step):
        chosen, wide = tiles[k : k + step], columns[k : k + step]
        zero = np.zeros(len(chosen), np.int64)
        # Both nodes, first row of each, first column in the tile, number of columns of the tile.
        items = [a.roots(chosen), b.roots(chosen), zero, zero, zero, wide]
        for level in range(HEIGHT, 0, -1):
            half, found = 1 << (level - 1), []
            nodes = [[a.child(level, items[0], q) for q in range(4)], [b.child(level, items[1], q) for q in range(4)]]
            for quadrant in range(8):
                down, across, right = quadrant >> 2, quadrant >> 1 & 1, quadrant & 1
                x, y = items[2] + down * half, items[3] + across * half
                column = items[4] + right * half
                there = (x < rows[0]) & (y < rows[1]) & (column < items[5])
                if same:
                    there &= (x < y) if level == 1 else (x <= y)
                if not there.any():
                    continue
                child = [nodes[0][2 * down + right][there], nodes[1][2 * across + right][there]]
                x, y, column, of = x[there], y[there], column[there], items[5][there]
                nothing = (child[0] < 0) & (child[1] < 0)
                if nothing.any():
                    # Every cell of such a pair of quadrants has the same two prices.
                    area = np.zeros((SIDE // half, SIDE // half), np.int64)
                    place = x[nothing] // half * len(area) + y[nothing] // half
                    np.add.at(area.reshape(-1), place, np.minimum(of[nothing] - column[nothing], half))
                    blank += np.repeat(np.repeat(area, half, 0), half, 1)
                some = ~nothing
                found.append([child[0][some], child[1][some], x[some], y[some], column[some], of[some]])
            items = [np.concatenate(z) for z in zip(*found)] if found else [np.empty(0, np.int64)] * 6
        if not len(items[0]):
            continue
        p = empty[0][items[2]]
        p[items[0] >= 0] = a.values[items[0][items[0] >= 0]]
        q = empty[1][items[3]]
        q[items[1] >= 0] = b.values[items[1][items[1] >= 0]]
        square = (p - q) ** 2
        place = items[2] * SIDE + items[3]
        np.add.at(one.reshape(-1), place, square // q)
        np.add.at(other.reshape(-1), place, square // p)
    return one, other, blank
