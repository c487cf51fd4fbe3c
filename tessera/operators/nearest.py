"""The k nearest rows of streamed blocks, for a held chunk of rows.

A tile of cheap bounds (one product of single precision, or sums of small
integers) rules out all but the pairs that can be among the k nearest so far;
these are measured directly in double precision, so that results and ties do not
depend on the bounds.  What is held is the chunk, its k nearest and one tile.

* l2, cosine (as l2 of rows of length one), jeffreys: bounds are the distances
  within rounding.
* jensen_shannon: its square lies between ln 2 times the squared Hellinger
  distance and that distance, coordinate by coordinate.
* l1: coordinates as steps of a grid; what a row loses by that is added.
* Of few coordinates (l1, l2), rows are laid in cells, and cells that are too far
  from each other are left out.
"""

from __future__ import annotations

import numpy as np

from ..functions.vectors import TINY

SINGLE = float(np.finfo(np.float32).eps)
ROUNDING = float(np.finfo(np.float64).eps)
PIECE = 1 << 12  # pairs that are measured at once
FEW = 4  # coordinates of which cells are made
GATHER = 1 << 16  # rows of few coordinates that are laid in cells together


def logs(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, TINY))


def measured(metric: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of ``x`` to the same rows of ``y`` (or of one to all), without cancellation."""
    if metric == "l2":
        return np.sqrt(((y - x) ** 2).sum(1))
    if metric == "l1":
        return np.abs(y - x).sum(1)
    if metric == "cosine":
        return 1 - (y * x).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
    lx, ly = logs(x), logs(y)
    if metric == "jeffreys":
        return ((y - x) * (ly - lx)).sum(1)
    m = logs((x + y) / 2)
    return np.sqrt(np.maximum((x * (lx - m) + y * (ly - m)).sum(1) / 2, 0))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def _size(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(1))


class Products:
    """Bounds by one product a tile: ``tile`` + ``const`` is a distance's monotone value (l2: its square) within ``margin``."""

    def __init__(self, metric: str, a: np.ndarray):
        self.metric = metric
        self.centre = [_finite(x).mean(0) for x in self._parts(a)]
        x = [p - c for p, c in zip(self._parts(a), self.centre, strict=True)]
        if metric == "jeffreys":
            left, self.const, self.sizes = np.hstack([-x[0], -x[1]]), (x[0] * x[1]).sum(1), [_size(x[0]), _size(x[1])]
        else:
            left, self.const, self.sizes = -2 * x[0], (x[0] * x[0]).sum(1), [_size(x[0])]
        self.scale = max(float(_finite(s).max(initial=0.0)) for s in self.sizes) or 1.0
        self.left = np.hstack([left, np.full((len(a), 1), self.scale)]).astype(np.float32)

    def _parts(self, a: np.ndarray) -> list[np.ndarray]:
        if self.metric == "jeffreys":
            return [a, logs(a)]
        if self.metric == "jensen_shannon":
            return [np.sqrt(a)]
        if self.metric == "cosine":
            return [a / _size(a)[:, None]]
        return [a]

    def take(self, b: np.ndarray) -> None:
        """The rows of the coming tiles' columns."""
        y = self._parts(b)
        raw = max(float(_finite(np.abs(p)).max(initial=0.0)) for p in y)
        y = [p - c for p, c in zip(y, self.centre, strict=True)]
        if self.metric == "jeffreys":
            right, const = np.hstack([y[1], y[0]]), (y[0] * y[1]).sum(1)
            size = self.sizes[0] * _finite(_size(y[1])).max(initial=0.0) + self.sizes[1] * _finite(_size(y[0])).max(initial=0.0)
        else:
            right, const = y[0], (y[0] * y[0]).sum(1)
            size = 2 * self.sizes[0] * _finite(_size(y[0])).max(initial=0.0)
        self.right = np.ascontiguousarray(np.hstack([right, const[:, None] / self.scale]).astype(np.float32).T)
        size = size + _finite(np.abs(const)).max(initial=0.0)
        # the last term: the shift to the centre, what is measured and logarithms, in double precision
        raw = (raw + max(float(np.abs(c).max(initial=0.0)) for c in self.centre)) ** 2
        self.margin = (right.shape[1] + 8) * (SINGLE * size + 16 * ROUNDING * (size + self.const + raw)) + 1e-37

    def tile(self, rows: slice, out: np.ndarray) -> np.ndarray:
        return np.matmul(self.left[rows], self.right, out=out)

    def limit(self, rows: slice, far: np.ndarray) -> np.ndarray:
        """What a tile's entry is at most if the distance is at most ``far``."""
        if self.metric == "jensen_shannon":
            value = 2 * far * far * (1 + 1e-12) / np.log(2)
        else:
            value = far * far if self.metric == "l2" else 2 * far if self.metric == "cosine" else far
        return _up(value - self.const[rows] + self.margin[rows])

    def upper(self, rows: slice, entry: np.ndarray) -> np.ndarray:
        """What the distance is at most if the tile's entry is at most ``entry``."""
        value = entry.astype(np.float64) + self.const[rows] + self.margin[rows]
        if self.metric == "jensen_shannon":
            return np.sqrt(np.maximum(value, 0) / 2) * (1 + 1e-12)
        if self.metric == "l2":
            return np.sqrt(np.maximum(value, 0)) * (1 + 1e-12)
        return value / 2 if self.metric == "cosine" else value


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


class Steps:
    """Bounds of l1: 2 * step * (tile's entry + ``base``) is at most the distance; coordinates are whole steps, kept in 16 bits with their sums."""

    MOST = 32767

    def __init__(self, a: np.ndarray):
        self.levels = self.MOST // max(a.shape[1], 1)
        with np.errstate(all="ignore"):
            low, high = np.nanquantile(a, [0.001, 0.999], axis=0)
        self.low = np.where(np.isfinite(low), low, 0.0)
        self.step = float(np.where(np.isfinite(high), high - self.low, 0.0).max(initial=0.0)) / self.levels or 1.0
        self.q, self.total, self.lost = self._cut(a)

    def _cut(self, x: np.ndarray):
        """(steps, their sums, what rows lose by the cut, in steps)."""
        with np.errstate(invalid="ignore"):
            y = (x - self.low) / self.step
            q = np.clip(np.rint(np.nan_to_num(y)), 0, self.levels)
            lost = np.abs(y - q).sum(1)
            # rounding of the shift, the division, the sum and of direct()
            lost += 32 * (x.shape[1] + 8) * ROUNDING * (np.abs(x).sum(1) + np.abs(self.low).sum()) / self.step
        return q.astype(np.int16), q.sum(1), np.where(np.isfinite(lost), lost, np.inf)

    def take(self, b: np.ndarray) -> None:
        q, total, self.lost_b = self._cut(b)
        self.right = np.ascontiguousarray(q.T)
        self.base_b = ((total - np.minimum(self.lost_b, 1e9)) / 2).astype(np.float32) - np.float32(1)  # a step more than enough for single precision
        self.most_lost = float(self.lost_b.max(initial=0.0))
        self.small = np.empty(self.right.shape, np.int16)
        self.sums = np.empty(self.right.shape[1], np.int16)

    def tile(self, rows: slice, out: np.ndarray) -> np.ndarray:
        for at, q in zip(range(len(out)), self.q[rows], strict=True):
            np.minimum(q[:, None], self.right, out=self.small)
            np.add.reduce(self.small, axis=0, out=self.sums, dtype=np.int16)
            np.subtract(self.base_b, self.sums, out=out[at])
        return out

    def limit(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return _up(((far * (1 + 1e-9) / self.step) + self.lost[rows] - self.total[rows]) / 2 + 1e-3)

    def upper(self, rows: slice, entry: np.ndarray) -> np.ndarray:
        steps = 2 * (entry.astype(np.float64) + 2.0) + self.total[rows] + self.lost[rows] + 2 * self.most_lost
        return np.maximum(steps, 0) * self.step * (1 + 1e-9)


class Everything:
    """No bounds: all pairs are measured."""

    def take(self, b: np.ndarray) -> None:
        self.n = len(b)

    def tile(self, rows: slice, out: np.ndarray) -> np.ndarray:
        out[:] = 0
        return out

    def limit(self, rows: slice, far: np.ndarray) -> np.ndarray:
        return np.full(len(far), np.inf, np.float32)

    def upper(self, rows: slice, entry: np.ndarray) -> np.ndarray:
        return np.full(len(entry), np.inf)


def bounds(metric: str, a: np.ndarray):
    if metric == "l1":
        return Steps(a) if Steps.MOST // max(a.shape[1], 1) >= 16 else Everything()
    return Products(metric, a)


def cells(x: np.ndarray, rows: int) -> np.ndarray:
    """An order of rows of few coordinates whose runs of ``rows`` are near each other."""
    order = np.argsort(x[:, 0], kind="stable")
    parts = [order]
    for c in range(1, x.shape[1]):
        slabs = max(1, round((len(x) / rows) ** (1 / x.shape[1])))
        parts = [p for part in parts for p in np.array_split(part, slabs)]
        parts = [part[np.argsort(x[part, c], kind="stable")] for part in parts]
    return np.concatenate(parts)


def _hits(tile: np.ndarray, limit: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the entries within their row's limit, row by row."""
    width = tile.shape[1]
    np.less_equal(tile, limit[:, None], out=spare)
    if width % 8:
        at = np.flatnonzero(spare)
    else:
        some = np.flatnonzero(spare.reshape(-1).view(np.uint64))
        at = np.flatnonzero(spare.reshape(-1, 8)[some])
        at = some[at >> 3] * 8 + (at & 7)
    return at // width, at % width


class Mixed:
    """A second bound of the square of jensen_shannon, pair by pair in single precision: half the sums of x ln x of both less that of their mean."""

    def __init__(self, a: np.ndarray):
        self.single, self.own = a.astype(np.float32), (a * logs(a)).sum(1)

    def take(self, b: np.ndarray) -> None:
        self.single_b, self.own_b = b.astype(np.float32), (b * logs(b)).sum(1)
        most = _finite(np.abs(self.own)).max(initial=0.0) + _finite(np.abs(self.own_b)).max(initial=0.0) + b.shape[1]
        self.margin = (b.shape[1] + 16) * SINGLE * most

    def near(self, r: np.ndarray, c: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Which pairs can be within ``far``."""
        m = self.single[r]
        m += self.single_b[c]
        m *= np.float32(0.5)
        np.maximum(m, np.float32(TINY), out=m)
        return ~((self.own[r] + self.own_b[c]) / 2 - np.einsum("ij,ij->i", m, np.log(m)) - self.margin > far * far * (1 + 1e-12))


class Nearest:
    """The ``k`` nearest of the rows that are ``add``-ed, for each row (id, vector) of a chunk; rows with the same id are left out, unless ``own``."""

    def __init__(self, metric: str, k: int, ids: np.ndarray, mat: np.ndarray, rows: int = 512, own: bool = False):
        self.metric, self.k, self.rows, self.own = metric, k, rows, own
        self.celled = metric in ("l1", "l2") and 0 < mat.shape[1] <= FEW
        if self.celled:
            self.rows = 256
            order = cells(mat, self.rows)
            ids, mat = ids[order], mat[order]
        self.ids, self.mat = ids, mat
        self.dist = np.full((len(ids), k), np.inf)
        self.near = np.full((len(ids), k), np.iinfo(np.int64).max)
        sound = metric in ("l1", "l2", "cosine") or not (mat < 0).any()
        with np.errstate(all="ignore"):
            self.bounds = bounds(metric, mat) if sound else Everything()
            self.mixed = Mixed(mat) if metric == "jensen_shannon" and sound else None
        self.parts = [slice(lo, min(lo + self.rows, len(ids))) for lo in range(0, len(ids), self.rows)]
        if self.celled:
            self.low, self.high = (np.array([f(mat[p], axis=0) for p in self.parts]) for f in (np.min, np.max))
        self.waiting, self.held = [], 0

    def add(self, ids: np.ndarray, mat: np.ndarray) -> None:
        """Columns to be met; small blocks are put together first."""
        if mat.shape[1] != self.mat.shape[1]:
            raise ValueError("vectors of different lengths")
        self.waiting.append((ids, mat))
        self.held += len(ids)
        if self.held >= (GATHER if self.celled else 1024):
            self._flush()

    def _flush(self) -> None:
        if not self.held:
            return
        ids, mat = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.held = [], 0
        if not self.celled:
            for lo in range(0, len(ids), 2048):
                self._block(ids[lo : lo + 2048], mat[lo : lo + 2048], self.parts)
            return
        order = cells(mat, 512)
        ids, mat = ids[order], mat[order]
        cuts = [slice(lo, min(lo + 512, len(ids))) for lo in range(0, len(ids), 512)]
        low, high = (np.array([f(mat[c], axis=0) for c in cuts]) for f in (np.min, np.max))
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(low[None] - self.high[:, None], self.low[:, None] - high[None]), 0)
            gap = np.sqrt((gap * gap).sum(2)) if self.metric == "l2" else gap.sum(2)
        gap = np.nan_to_num(gap * (1 - 1e-9), nan=0.0)
        met = np.zeros(gap.shape, bool)
        # each part's nearest cells first, so that the far ones need not be met
        first = np.argsort(gap, axis=1, kind="stable")[:, : 1 + self.k // 512 + 2]
        np.put_along_axis(met, first, True, 1)
        for turn in (met, ~met):
            for c, cut in enumerate(cuts):
                mine = [p for n, p in enumerate(self.parts) if turn[n, c] and gap[n, c] <= self.dist[p, -1].max()]
                if mine:
                    self._block(ids[cut], mat[cut], mine)

    def _block(self, ids: np.ndarray, mat: np.ndarray, parts: list[slice]) -> None:
        bounds = self.bounds
        if self.metric in ("jeffreys", "jensen_shannon") and (mat < 0).any():
            bounds = Everything()
        with np.errstate(all="ignore"):
            bounds.take(mat)
            if self.mixed:
                self.mixed.take(mat)
            tile, spare = np.empty((self.rows, len(ids)), np.float32), np.empty((self.rows, len(ids)), bool)
            for part in parts:
                n = part.stop - part.start
                t = bounds.tile(part, tile[:n])
                far = self.dist[part, -1]
                if len(ids) > self.k and not np.isfinite(far).all():
                    other = np.where((self.ids[part][:, None] == ids[None, :]) & (not self.own), np.float32(np.inf), t)
                    np.nan_to_num(other, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
                    far = np.fmin(far, bounds.upper(part, np.partition(other, self.k - 1, axis=1)[:, self.k - 1]))
                    far = np.where(np.isnan(far), np.inf, far)
                r, c = _hits(t, bounds.limit(part, far), spare[:n])
                for lo in range(0, len(r), PIECE):
                    x, y = r[lo : lo + PIECE], c[lo : lo + PIECE]
                    if self.mixed and bounds is self.bounds:
                        near = self.mixed.near(x + part.start, y, np.minimum(far, self.dist[part, -1])[x])
                        x, y = x[near], y[near]
                    self._meet(part, x, y, ids, mat)

    def _meet(self, part: slice, r: np.ndarray, c: np.ndarray, ids: np.ndarray, mat: np.ndarray) -> None:
        dist, near = self.dist[part], self.near[part]
        d = measured(self.metric, self.mat[part][r], mat[c])
        i = ids[c]
        good = (d <= dist[r, -1]) & ((i != self.ids[part][r]) | self.own) & np.isfinite(d)
        r, d, i = r[good], d[good], i[good]
        if not len(r):
            return
        rows, at = np.unique(r, return_inverse=True)
        at = np.concatenate([np.repeat(np.arange(len(rows)), self.k), at])
        d, i = np.concatenate([dist[rows].ravel(), d]), np.concatenate([near[rows].ravel(), i])
        order = np.lexsort((i, d, at))
        at = at[order]
        first = np.searchsorted(at, np.arange(len(rows)))
        take = order[first[:, None] + np.arange(self.k)[None, :]]
        dist[rows], near[rows] = d[take], i[take]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(src, dst, dist)."""
        self._flush()
        fine = np.isfinite(self.dist)
        return np.repeat(self.ids, fine.sum(1)), self.near[fine], self.dist[fine]
