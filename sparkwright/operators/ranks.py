"""Nearest rows and numbers of nearer rows, between blocks of distinct vectors.

Single precision decides every pair that its error bound can't put on the wrong side; the few others are measured again in
double precision, so that what comes out is what distances rounded to nine decimals give, ties going by key.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

ROWS, COLUMNS = 240, 960  # of a tile: it stays in a core's cache, and flags added up by bytes stay below 256
MEASURED = 65_536  # coordinates of pairs measured in double precision at a time
WAITING = 131_072  # pairs that may wait for it
DIGITS, SLACK = 9, 1e-9  # distances are rounded; what rounding can move, and as much again
NONE = -np.inf


def measured(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Rounded distances of x[i] to y[j]: squares are added one after the other, as SQL does it."""
    out, step = np.empty(len(i)), max(1, MEASURED // x.shape[1])
    for s in range(0, len(i), step):
        t = slice(s, s + step)
        d = x.take(i[t], axis=0)
        d -= y.take(j[t], axis=0)
        d *= d
        out[t] = d.cumsum(axis=1)[:, -1]
    return np.round(np.sqrt(out), DIGITS)


def padded(lists: list[np.ndarray], width: int, fill, kind) -> np.ndarray:
    sizes = np.fromiter(map(len, lists), int, len(lists))
    out = np.full((len(lists), width), fill, kind)
    out[np.arange(width) < sizes[:, None]] = np.concatenate(lists) if len(lists) else []
    return out


class Block:
    """One side of a comparison: distinct vectors, the keys of the rows that have them, and what is asked about each.

    pdf: key, vector, keys (ascending), and if there are questions far and asked, of `width` items at most: how many rows are
    nearer than the row `asked`, which is `far` away? codes: keys as numbers of the same order. nearest: rows to find.
    """

    def __init__(self, pdf: pd.DataFrame, codes, width: int, nearest: int):
        x, size = np.stack(pdf["vector"].to_numpy()).astype(float), pdf["keys"].map(len).to_numpy()
        # vectors of as many rows share tiles, and so do those far out, which bring in large errors; else any order does, but not
        # one by length or place: the nearest would come last, and all before them would be taken for near
        long = np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1))
        out = np.frexp(long / (8 * np.median(long) or 1.0))[1]
        order = np.lexsort((np.maximum(out, 0), size))
        pdf = pdf.take(order)
        self.x, self.weight, self.names = x[order], size[order].astype(np.int64), pdf["key"].to_numpy()
        self.keys, self.start = codes(np.concatenate(pdf["keys"].to_numpy())), np.cumsum(self.weight) - self.weight
        n = len(pdf)
        self.far, self.asked = np.full((n, 0), NONE), np.zeros((n, 0), np.int64)
        if "far" in pdf:
            self.far = np.round(padded(list(pdf["far"]), width, NONE, float), DIGITS)
            some = np.concatenate(list(pdf["asked"]))
            self.asked = np.zeros((n, width), np.int64)
            self.asked[self.far > NONE] = codes(some) if len(some) else []
        self.counts, self.nearest = np.zeros(self.far.shape, np.int64), nearest
        self.near, self.waiting = np.full((n, nearest), np.inf), []
        self.other, self.rep = np.full((n, nearest), np.iinfo(np.int64).max), np.zeros((n, nearest), np.int64)

    def __len__(self) -> int:
        return len(self.x)

    def scaled(self, shift: np.ndarray, scale: float) -> np.ndarray:
        """The vectors moved, in units in which none is longer than 1, and in these the bounds that tiles are held against."""
        moved = (self.x - shift) * scale
        self.scale, self.long = scale, np.sqrt((moved**2).sum(axis=1))
        self.low = np.where(self.far > SLACK, ((self.far - SLACK) * scale) ** 2, NONE)
        self.high = np.where(self.far > NONE, ((self.far + SLACK) * scale) ** 2, NONE)
        self.bound = np.full(len(self), np.inf)
        return moved

    def tile(self, d: np.ndarray, at: int, to: Block, start: int, error: np.ndarray, axis: int, flags: np.ndarray, now: bool) -> None:
        """Take in squared distances d, of own vectors from `at` along the other axis to those of `to` from `start` along `axis`.

        now: the lists of the nearest take in what waits, and so bound what comes next more closely.
        """
        size = (min(d.shape[1 - axis], len(self) - at), min(d.shape[axis], len(to) - start))  # without what fills up
        own = slice(at, at + size[0])
        beyond, across = np.full(d.shape[1 - axis] - size[0], NONE, np.float32), (slice(None), None) if axis else (None, slice(None))
        spread = lambda v: (np.concatenate([v, beyond]) if len(beyond) else v)[across]
        weight = to.weight[start : start + size[1]]
        found = []
        for q in range(self.far.shape[1]):
            if self.high[own, q].max() == NONE:
                continue
            low, high = under(self.low[own, q] - error), over(self.high[own, q] + error)
            np.less(d, spread(low), out=flags)
            sure = added(flags, axis)[: size[0]]
            self.counts[own, q] += sure * weight[0] if weight[0] == weight[-1] else weighed(flags, axis, weight, size)
            np.less(d, spread(high), out=flags)
            open_ = np.flatnonzero(added(flags, axis)[: size[0]] != sure)
            if len(open_):
                part = d[open_] if axis else d[:, open_].T
                i, j = np.nonzero((part >= low[open_, None]) & (part < high[open_, None]))
                found.append((open_[i], j, np.full(len(i), q)))
        if found:
            self.settle(at, to, start, *(np.concatenate(f) for f in zip(*found, strict=True)))
        if self.nearest:
            bound = self.bound[own] + error
            if np.isinf(bound).any() and size[1] > self.nearest:
                kth = np.partition(d, self.nearest - 1, axis=axis).take(self.nearest - 1, axis=axis)[: size[0]].astype(float)
                first = (np.sqrt(np.maximum(kth + error, 0)) + SLACK * self.scale) ** 2 + error
                bound = np.where(np.isinf(bound), first, bound)
            np.less(d, spread(over(bound)), out=flags)
            hits = np.divmod(where(flags), d.shape[1])
            self.waiting.append((at + hits[1 - axis], start + hits[axis]))
            if now or sum(len(i) for i, _ in self.waiting) > WAITING:
                i, j = (np.concatenate(w) for w in zip(*self.waiting, strict=True))
                self.waiting = []
                if len(i):
                    self.draw_near(i, to, j)

    def settle(self, at: int, to: Block, start: int, i: np.ndarray, j: np.ndarray, q: np.ndarray) -> None:
        """Count pairs that single precision left open: all rows of a nearer vector, those of lower keys of one as far."""
        i, j = at + i, start + j
        d, far = measured(self.x, i, to.x, j), self.far[i, q]
        n = np.where(d < far, to.weight[j], 0)
        tie = np.flatnonzero(d == far)
        n[tie] = to.before(j[tie], self.asked[i[tie], q[tie]])
        np.add.at(self.counts, (i, q), n)

    def before(self, j: np.ndarray, key: np.ndarray) -> np.ndarray:
        """How many keys of vector j are lower than `key`."""
        low, high = self.start[j], self.start[j] + self.weight[j]
        for _ in range(int(self.weight[j].max()).bit_length() if len(j) else 0):
            middle = np.minimum((low + high) // 2, len(self.keys) - 1)
            right = (low < high) & (self.keys[middle] < key)
            low, high = np.where(right, middle + 1, low), np.where(right | (low >= high), high, middle)
        return low - self.start[j]

    def draw_near(self, i: np.ndarray, to: Block, j: np.ndarray) -> None:
        """Put pairs into the lists of the nearest, in the order of distance and key."""
        k = self.nearest
        d = measured(self.x, i, to.x, j)
        some = d <= self.near[i, -1]
        i, j, d = i[some], j[some], d[some]
        times = np.minimum(to.weight[j], k)
        each = np.repeat(np.arange(len(i)), times)
        i, j, d = i[each], j[each], d[each]
        key = to.keys[to.start[j] + np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)]
        some = (d < self.near[i, -1]) | (key < self.other[i, -1])
        i, j, d, key = i[some], j[some], d[some], key[some]
        if not len(i):
            return
        rows, i = np.unique(i, return_inverse=True)
        i = np.concatenate([np.repeat(np.arange(len(rows)), k), i])
        d, key, j = (np.concatenate([old[rows].ravel(), new]) for old, new in ((self.near, d), (self.other, key), (self.rep, j)))
        order = np.lexsort((key, d, i))
        i = i[order]
        order = order[np.arange(len(i)) - np.searchsorted(i, i) < k]
        for old, new in ((self.near, d), (self.other, key), (self.rep, j)):
            old[rows] = new[order].reshape(-1, k)
        self.bound[rows] = ((self.near[rows, -1] + SLACK) * self.scale) ** 2

    def result(self, to: Block, decoded) -> pd.DataFrame:
        """key, near, other, rep, n by own vectors."""
        there = np.isfinite(self.near)
        cut = list if there.all() else lambda a: [v[t] for v, t in zip(a, there, strict=True)]
        other = np.where(there, self.other, self.keys[0])
        return pd.DataFrame({"key": self.names, "near": cut(self.near), "other": cut(decoded(other)), "rep": cut(to.names[self.rep]), "n": list(self.counts)})


def under(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(NONE))


def over(v: np.ndarray) -> np.ndarray:
    return np.nextafter(v.astype(np.float32), np.float32(np.inf))


def where(flags: np.ndarray) -> np.ndarray:
    """Places of the flags that are set, which are few: words of eight are looked through first."""
    words = np.flatnonzero(flags.ravel().view(np.uint64))
    w, byte = np.nonzero(flags.reshape(-1, 8)[words])
    return words[w] * 8 + byte


def added(flags: np.ndarray, axis: int) -> np.ndarray:
    """Flags added up along an axis: of COLUMNS eight at a time as the bytes of a word, of ROWS in a byte."""
    if axis:
        return flags.view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)
    return np.add.reduce(flags.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


def weighed(flags: np.ndarray, axis: int, weight: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    f = flags[: size[0], : size[1]] if axis else flags[: size[1], : size[0]].T
    return (f.astype(float) @ weight.astype(float)).astype(np.int64)


def meet(a: Block, b: Block, both: bool) -> None:
    """All vectors of a with all of b: counts and nearest rows of a, and of b too if `both`."""
    shift = a.x.mean(axis=0)
    most = max(float(np.sqrt(((p.x - shift) ** 2).sum(axis=1)).max()) for p in (a, b))
    scale = 2.0 ** -np.ceil(np.log2(most)) if most > 0 else 1.0
    m, wide = a.x.shape[1], -(-len(b) // 8) * 8
    # |x|^2 - 2xy + |y|^2 as one product; what fills up is infinitely far
    left, right = np.ones((len(a), m + 2), np.float32), np.zeros((m + 2, wide), np.float32)
    left[:, :m] = -2 * a.scaled(shift, scale)
    right[:m, : len(b)] = b.scaled(shift, scale).T
    left[:, m], right[m], right[m + 1, : len(b)], right[m + 1, len(b) :] = a.long**2, 1, b.long**2, np.inf
    unit = (m + 16) * 2.0**-24  # of rounding of inputs, products, sums and bounds
    error = lambda x, y: unit * (x + y.max()) ** 2 + 1e-30
    space, marks = np.empty(ROWS * COLUMNS, np.float32), np.empty(ROWS * COLUMNS, bool)
    for j in range(0, wide, COLUMNS):
        y = b.long[j : j + COLUMNS]
        for t, i in enumerate(range(0, len(a), ROWS), 1):
            x = a.long[i : i + ROWS]
            shape = (len(x), min(COLUMNS, wide - j))
            d, flags = (s[: shape[0] * shape[1]].reshape(shape) for s in (space, marks))
            np.matmul(left[i : i + ROWS], right[:, j : j + COLUMNS], out=d)
            a.tile(d, i, b, j, error(x, y), 1, flags, True)
            if both:
                # after 1, 2, 4 ... tiles: each time about as many vectors come near as a list holds
                b.tile(d, j, a, i, error(y, x), 0, flags, t & (t - 1) == 0 or i + ROWS >= len(a))


def block_ranks(a: pd.DataFrame, b: pd.DataFrame, same: bool, width: int, nearest: int) -> pd.DataFrame:
    """key, near, other, rep, n: for each vector of both frames (of a alone if they are the same) its nearest rows in the other,
    the vectors that these have, and the answers to its questions."""
    if not len(a) or not len(b):
        return pd.DataFrame({c: [] for c in ("key", "near", "other", "rep", "n")})
    lists = [np.concatenate(list(p[c])) for p in (a, b) for c in ("keys", "asked") if c in p]
    if all(np.issubdtype(v.dtype, np.integer) for v in lists if len(v)):
        codes, decoded = lambda v: v, lambda v: v.astype(a["key"].dtype)
    else:
        names = np.unique(np.concatenate(lists))
        codes, decoded = lambda v: np.searchsorted(names, v), lambda v: names[v]
    x, y = (Block(p, codes, width, nearest) for p in (a, b))
    meet(x, y, not same)
    return x.result(y, decoded) if same else pd.concat([x.result(y, decoded), y.result(x, decoded)], ignore_index=True)
