"""Least squares over the epochs of long series, by substructuring.

Differences between epochs that are at most ``reach`` apart give a weighted graph Laplacian with a narrow band. The line of epochs
is cut into blocks; the first ``reach`` epochs of a block are its separator. A task eliminates the inside of one block and
keeps its Schur complement on the two separators next to it; the separators of a key form a small block-tridiagonal system;
a third step puts the separators' values back into the blocks. So memory follows a block, not the series.

The same three steps find the connected components, the inverse inside the band, and the residual, so the minimum-norm
solution and its covariance (the pseudo-inverse, one constant per component removed) come out without a dense matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BLOCK = 128


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component; nodes a[k] and b[k] are linked."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class _Block:
    """The system of one block: its inside eliminated, its two separators left over.

    Nodes are those that occur in the block's edges (an edge belongs to the block of its earlier epoch). The second right-hand
    side is one for every node, which gives the row sums of the inverse.
    """

    def __init__(self, pdf: pd.DataFrame, block: int, size: int, reach: int, smooth: float):
        i, j, w, wd = (pdf[c].to_numpy() for c in ("i", "j", "w", "wd"))
        self.ids, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        n = len(self.ids)
        a, b = at[: len(i)], at[len(i) :]
        m = np.zeros((n, n))
        for r, c, v in ((a, a, w), (b, b, w), (a, b, -w), (b, a, -w)):
            np.add.at(m, (r, c), v)
        rhs = np.bincount(a, wd, n) - np.bincount(b, wd, n)
        linked = [(a[w > 0], b[w > 0])]
        own = self.ids // size == block
        if smooth and n > 2:  # second differences that start in this block
            k = np.flatnonzero(own[:-2] & (self.ids[2:] - self.ids[:-2] == 2))
            d = np.zeros((len(k), n))
            for step, v in enumerate((smooth, -2 * smooth, smooth)):
                d[np.arange(len(k)), k + step] = v
            m += d.T @ d
            linked += [(k, k + 1), (k + 1, k + 2)]
        place = self.ids - block * size
        outer = (place < reach) | (place >= size)
        self.outer, self.inner = np.flatnonzero(outer), np.flatnonzero(~outer)
        #: position of the outer nodes among the 2 x reach places of both separators
        self.slot = np.where(place < reach, place, place - size + reach)[self.outer]
        label = _labels(n, *map(np.concatenate, zip(*linked)))
        closed = np.isin(label[self.inner], np.setdiff1d(label[self.inner], label[self.outer]))
        self.label, self.closed = label, closed
        # a component that lies inside is held at its first node
        held = np.isin(self.inner, label[self.inner][closed])
        inside = m[np.ix_(self.inner, self.inner)]
        inside[held], inside[:, held] = 0.0, 0.0
        inside[held, held] = 1.0
        self.held, self.inside = held, inside
        self.to_outer = m[np.ix_(self.inner, self.outer)]
        self.to_outer[held] = 0.0
        self.f = np.stack([rhs, np.ones(n)], 1)
        self.f[self.inner[held]] = 0.0
        self.rest = m[np.ix_(self.outer, self.outer)]
        solved = np.linalg.solve(inside, np.hstack([self.to_outer, self.f[self.inner]])) if len(self.inner) else np.zeros((0, len(self.outer) + 2))
        self.carry, self.free = -solved[:, : len(self.outer)], solved[:, len(self.outer) :]

    def schur(self, width: int) -> dict:
        """What the separators need to know; absent places stay empty."""
        s, r = np.zeros((width, width)), np.zeros((width, 2))
        s[np.ix_(self.slot, self.slot)] = self.rest + self.to_outer.T @ self.carry
        r[self.slot, 0] = self.f[self.outer, 0]  # the ones of separators are added where they meet
        r[self.slot] += self.carry.T @ self.f[self.inner]
        link = np.full(width, -1, np.int64)
        link[self.slot] = self.label[self.outer]
        first = np.full(width, -1, np.int64)
        first[self.slot] = [self.ids[self.label == lb].min() for lb in self.label[self.outer]]
        return {"s": s.ravel(), "r": r.ravel(), "link": link, "first": first}


def _inverse(d: np.ndarray) -> np.ndarray:
    inv = np.linalg.inv(d)
    return (inv + np.swapaxes(inv, -1, -2)) / 2


def _separators(blocks: np.ndarray, parts: dict[int, dict], reach: int) -> list[dict]:
    """Solve the separators of one key; a row for each block with values, inverse and components of both its separators."""
    width = 2 * reach
    every = np.unique(np.concatenate([blocks, blocks + 1]))
    pos = {int(b): k for k, b in enumerate(every)}
    n = len(every)
    d, e, f = np.zeros((n, reach, reach)), np.zeros((n, reach, reach)), np.zeros((n, reach, 2))
    there, first = np.zeros((n, reach), bool), np.full((n, reach), np.iinfo(np.int64).max)
    left, right = [], []
    for b, part in parts.items():
        k = pos[b]
        s, r = part["s"].reshape(width, width), part["r"].reshape(width, 2)
        d[k] += s[:reach, :reach]
        d[k + 1] += s[reach:, reach:]
        e[k] = s[:reach, reach:]
        f[k] += r[:reach]
        f[k + 1] += r[reach:]
        link = part["link"]
        on = np.flatnonzero(link >= 0)
        node = k * reach + on
        there.ravel()[node] = True
        np.minimum.at(first.ravel(), node, part["first"][on])
        for lb in np.unique(link[on]):
            same = node[link[on] == lb]
            left.append(same[:-1])
            right.append(same[1:])
    empty = np.zeros(0, np.int64)
    label = _labels(n * reach, np.concatenate([empty, *left]), np.concatenate([empty, *right]))
    comp = np.full(n * reach, np.iinfo(np.int64).max)
    np.minimum.at(comp, label, first.ravel())
    comp = comp[label].reshape(n, reach)
    off = ~there | (label == np.arange(n * reach)).reshape(n, reach)  # absent, or held for its component
    solvable = f[..., 0].any() or there.any()
    f[..., 1] += there
    f[off] = 0.0
    for k in range(n):
        o = off[k]
        d[k][o], d[k][:, o] = 0.0, 0.0
        d[k][o, o] = 1.0
        e[k][o] = 0.0
        if k + 1 < n:
            e[k][:, off[k + 1]] = 0.0
    x, z0, z1 = np.zeros((n, reach, 2)), np.zeros((n, reach, reach)), np.zeros((n, reach, reach))
    if solvable:
        inv = np.zeros_like(d)
        for k in range(n):
            if k:
                g = e[k - 1].T @ inv[k - 1]
                d[k] -= g @ e[k - 1]
                f[k] -= g @ f[k - 1]
            inv[k] = _inverse(d[k])
        for k in reversed(range(n)):
            if k + 1 < n:
                g = inv[k] @ e[k]
                x[k] = inv[k] @ f[k] - g @ x[k + 1]
                z0[k], z1[k] = inv[k] + g @ z0[k + 1] @ g.T, -g @ z0[k + 1]
            else:
                x[k], z0[k] = inv[k] @ f[k], inv[k]
        z0[off], x[off] = 0.0, 0.0
        np.swapaxes(z0, 1, 2)[off] = 0.0
    rows = []
    for b in every:
        k = pos[int(b)]
        near = k + 1 < n and every[k + 1] == b + 1
        z = np.zeros((width, width))
        z[:reach, :reach] = z0[k]
        there2, comp2, x2 = np.zeros(width, bool), np.full(width, -1, np.int64), np.zeros((width, 2))
        there2[:reach], comp2[:reach], x2[:reach] = there[k], comp[k], x[k]
        if near:
            z[:reach, reach:], z[reach:, :reach], z[reach:, reach:] = z1[k], z1[k].T, z0[k + 1]
            there2[reach:], comp2[reach:], x2[reach:] = there[k + 1], comp[k + 1], x[k + 1]
        rows.append({"block": int(b), "x": x2.ravel(), "z": z.ravel(), "there": there2.astype(np.int64), "comp": comp2})
    return rows


def _nodes(edges: pd.DataFrame, sep: pd.Series, block: int, size: int, reach: int, smooth: float, pairs: bool) -> pd.DataFrame:
    """Rows of the epochs of one block: values, inverse in the band, share of the residual."""
    width, base = 2 * reach, block * size
    x, z = np.array(sep["x"]).reshape(width, 2), np.array(sep["z"]).reshape(width, width)
    on = np.flatnonzero(np.array(sep["there"], bool))
    # both separators first, then the inside
    ids, val, comps = base + np.where(on < reach, on, on - reach + size), x[on], np.array(sep["comp"])[on]
    inverse, own, ss, count = z[np.ix_(on, on)], on < reach, 0.0, 0
    if len(edges):
        sys = _Block(edges, block, size, reach, smooth)
        inner = sys.inner
        inside = sys.free + sys.carry @ x[sys.slot]
        by_label = dict(zip(sys.label[sys.outer].tolist(), np.array(sep["comp"])[sys.slot].tolist()))
        g_io = sys.carry @ z[np.ix_(sys.slot, on)]
        if pairs:
            g_ii = _inverse(sys.inside) if len(inner) else np.zeros((0, 0))
            g_ii[sys.held], g_ii[:, sys.held] = 0.0, 0.0
            g_ii = g_ii + sys.carry @ z[np.ix_(sys.slot, sys.slot)] @ sys.carry.T
            inverse = np.block([[inverse, g_io.T], [g_io, g_ii]])
        ids, val = np.concatenate([ids, sys.ids[inner]]), np.concatenate([val, inside])
        comps = np.concatenate([comps, np.array([by_label.get(int(lb), int(sys.ids[lb])) for lb in sys.label[inner]], np.int64)])
        own = np.concatenate([own, np.ones(len(inner), bool)])
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, edges[c].to_numpy(), sorter=order)] for c in ("i", "j"))
        d = val[a, 0] - val[b, 0]
        ss = float(np.sum(edges["w"].to_numpy() * d * d - 2 * d * edges["wd"].to_numpy() + edges["wdd"].to_numpy()))
        count = int(edges["m"].sum())
    out = pd.DataFrame({"i": ids[own], "x": val[own, 0], "u": val[own, 1], "comp": comps[own], "ss": 0.0, "m": 0})
    if len(out):
        out.loc[0, "ss"], out.loc[0, "m"] = ss, count
    if pairs:
        apart = ids[None, :] - ids[:, None]
        later = (apart >= 0) & (apart <= reach)
        inner_row = np.arange(len(ids)) >= len(on)
        # separator rows keep to their own separator; the inside also takes its pairs with the one on the left
        mine = np.where(inner_row[:, None], later | ((apart < 0) & (apart >= -reach) & (~inner_row & own)[None, :]), later & (~inner_row & own)[None, :])
        mine &= comps[None, :] == comps[:, None]
        near = [np.flatnonzero(row) for row in mine[own]]
        lists = {"js": [ids[c] for c in near], "gs": [inverse[r, c] for r, c in zip(np.flatnonzero(own), near)], "us": [val[c, 1] for c in near]}
        for name, values in lists.items():
            out[name] = pd.Series(values, out.index, dtype=object)
    return out


def chain_nodes(edges: DataFrame, keys: Sequence[str], *, reach: int, size: int = BLOCK, smooth: float = 0.0, pairs: bool = False) -> DataFrame:
    """Held solutions of every epoch that occurs in ``edges`` (keys, i, j, w, wd, wdd, m), one edge for each pair.

    keys, i, x, u (row sum of the held inverse), comp (smallest epoch of the component) and the block's share of the
    squared residual (ss) and pairs (m); with ``pairs`` also js, gs, us: inverse and row sums of the epochs at most ``reach`` away.
    ``smooth`` weighs second differences of neighbouring epochs. Subtracting a component's mean gives the minimum-norm solution.
    """
    keys, size, width = list(keys), max(size, 4 * reach), 2 * reach
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    owned = edges.select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), "w", "wd", "wdd", "m").withColumn(
        "block", F.floor(F.least("i", "j") / size).cast("long")
    )

    def eliminate(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        part = _Block(pdf, block, size, reach, smooth).schur(width)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "block": block, **part}])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {int(r.block): {c: np.array(getattr(r, c)) for c in ("s", "r", "link", "first")} for r in pdf.sort_values("block").itertuples()}
        out = pd.DataFrame(_separators(np.array(sorted(parts)), parts, reach))
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "block", "x", "z", "there", "comp"]]

    names = [*keys, "i", "x", "u", "comp", "ss", "m"] + (["js", "gs", "us"] if pairs else [])

    def back(mine: pd.DataFrame, sep: pd.DataFrame) -> pd.DataFrame:
        if not len(sep):
            return pd.DataFrame(columns=names)
        row = sep.iloc[0]
        out = _nodes(mine, row, int(row["block"]), size, reach, smooth, pairs)
        for k in keys:
            out[k] = row[k]
        return out[names]

    parts = owned.groupBy(*keys, "block").applyInPandas(
        eliminate, f"{head}block long, s array<double>, r array<double>, link array<long>, first array<long>"
    )
    seps = parts.groupBy(*keys).applyInPandas(meet, f"{head}block long, x array<double>, z array<double>, there array<long>, comp array<long>")
    more = ", js array<long>, gs array<double>, us array<double>" if pairs else ""
    return owned.groupBy(*keys, "block").cogroup(seps.groupBy(*keys, "block")).applyInPandas(
        back, f"{head}i long, x double, u double, comp long, ss double, m long{more}"
    )
