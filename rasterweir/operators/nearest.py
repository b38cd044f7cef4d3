"""Exact nearest prototypes with the triangle inequality, for any number of prototypes."""

from __future__ import annotations

import numpy as np

#: Prototypes up to which there is one group and nothing to skip.
ONE_GROUP = 256
#: Distances that are held at a time.
BLOCK_VALUES = 1 << 21


class PrototypeIndex:
    """Prototypes in about sqrt(P) groups around pivots, each with a radius.

    A sample's distance to a pivot less the group's radius bounds its distance to all of the group's prototypes from below; groups whose bound
    is beyond the best so far are skipped. Distances come from matrix products; those within their rounding of the best are taken again as sums of squared
    differences, so the answer is that of a plain search, with ties going to the prototype that comes first. Equal prototypes are one.
    """

    def __init__(self, w: np.ndarray):
        w = np.asarray(w, float)
        self.size = len(w)
        _, first = np.unique(w, axis=0, return_index=True)
        self.order = np.sort(first)  # places in w of the distinct ones
        own = w[self.order]
        groups = 1 if len(own) <= ONE_GROUP else int(np.ceil(np.sqrt(len(own))))
        self.pivots = own[np.linspace(0, len(own) - 1, groups).astype(int)] if groups > 1 else own.mean(axis=0, keepdims=True)
        step = max(1, BLOCK_VALUES // groups)
        home = np.concatenate([_products(own[i : i + step], self.pivots).argmin(axis=1) for i in range(0, len(own), step)])
        self.groups = [(self.order[m], own[m], float(np.sqrt(((own[m] - self.pivots[g]) ** 2).sum(axis=1).max()))) for g in range(groups) if len(m := np.flatnonzero(home == g))]
        self.pivots = self.pivots[np.unique(home)]
        self.scale = float((own**2).sum(axis=1).max())

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Place of the nearest prototype, its squared distance, and how many distances were taken, for rows without NaN."""
        at, d2, taken = np.zeros(len(x), np.int64), np.zeros(len(x)), 0
        step = max(1, BLOCK_VALUES // max(len(self.groups), max(len(g[0]) for g in self.groups)))
        for i in range(0, len(x), step):
            at[i : i + step], d2[i : i + step], n = self._block(x[i : i + step])
            taken += n
        return at, d2, taken

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        slack = 1e-9 * ((x * x).sum(axis=1) + self.scale + 1)
        far = np.sqrt(np.maximum(_products(x, self.pivots), 0)) if len(self.groups) > 1 else np.zeros((len(x), 1))
        best, taken, held = np.full(len(x), np.inf), 0, []

        def visit(g: int, rows: np.ndarray) -> int:
            place, w, _ = self.groups[g]
            d = _products(x[rows], w)
            best[rows] = np.minimum(best[rows], d.min(axis=1))
            r, c = np.nonzero(d <= (best[rows] + slack[rows])[:, None])
            held.append((rows[r], place[c], d[r, c]))
            return d.size

        first = far.argmin(axis=1)
        for g in np.unique(first):
            taken += visit(int(g), np.flatnonzero(first == g))
        radius = np.array([g[2] for g in self.groups])
        for g in np.argsort(far.min(axis=0) - radius) if len(self.groups) > 1 else ():
            bound = np.maximum(0, far[:, g] - radius[g])
            rows = np.flatnonzero((first != g) & (bound * bound <= best + slack))
            if len(rows):
                taken += visit(int(g), rows)
        row, place, d = (np.concatenate(v) for v in zip(*held, strict=True))
        near = d <= best[row] + slack[row]
        row, place = row[near], place[near]
        exact = ((x[row] - self._w(place)) ** 2).sum(axis=1)
        order = np.lexsort((place, exact, row))
        row, place, exact = row[order], place[order], exact[order]
        pick = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        return place[pick], exact[pick], taken

    def _w(self, place: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_all"):
            self._all = np.zeros((self.size, self.pivots.shape[1]))
            for p, w, _ in self.groups:
                self._all[p] = w
        return self._all[place]


def _products(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances as |x|^2 - 2 x w + |w|^2."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ w.T) + (w * w).sum(axis=1)[None, :]
