"""Tree models per series and fold: all trees of a series grow level by level together.

A series comes to one task once, whatever the number of folds; its rows are bounded by the calendar (52 a year in weekly tables). The
task fits every fold from the rows before it, without a copy of a row per fold in any shuffle. Growth works on entries (a row in a tree):
each level is one pass over the entries sorted by node and value, for all trees at once, so cost follows entries x levels
and not the number of nodes or trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitcast.operators import splits


@dataclass(frozen=True)
class TreeSpec:
    """``forest`` and ``quantile_forest`` bag ``size`` trees; ``boosting`` and ``quantile_boosting`` add ``size`` trees in turn."""

    kind: str = "boosting"
    size: int = 300
    min_leaf: int = 20
    max_leaves: int | None = 31
    rate: float = 0.05
    l2: float = 0.1
    quantiles: tuple[float, ...] = (0.1, 0.9)
    seed: int = 42

    @property
    def outputs(self) -> list[str]:
        return [f"p{round(q * 100):02d}" for q in self.quantiles] if self.kind.startswith("quantile") else ["prediction"]


FOREST = TreeSpec("forest", min_leaf=5, max_leaves=None, l2=0.0)
BOOSTING = TreeSpec("boosting")
QUANTILE_BOOSTING = TreeSpec("quantile_boosting")
QUANTILE_FOREST = TreeSpec("quantile_forest", min_leaf=5, max_leaves=None, l2=0.0)


@dataclass
class Grown:
    """Nodes of many trees; the first ones are the roots. A leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    gain: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray, row: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """Leaf of each row in its tree; a right child follows its left one."""
        at = tree.astype(np.int64)
        go = np.flatnonzero(self.feature[at] >= 0)
        while len(go):
            n = at[go]
            at[go] = self.left[n] + (x[row[go], self.feature[n]] > self.threshold[n])
            go = go[self.feature[at[go]] >= 0]
        return at


def by_value(x: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Entries in the order of each feature."""
    return [np.argsort(np.argsort(x[:, f], kind="stable").argsort()[row], kind="stable") for f in range(x.shape[1])]


def grow(x: np.ndarray, row: np.ndarray, tree: np.ndarray, trees: int, grad: np.ndarray, weight: np.ndarray, spec: TreeSpec,
         orders: list[np.ndarray] | None = None) -> Grown:
    """Grow ``trees`` from entries (``row`` in ``tree``) with the sums to fit ``grad`` and their ``weight``.

    A split maximises the rise of sum(grad)^2 / (sum(weight) + l2), over all midpoints between neighbouring values that leave
    ``min_leaf`` entries on both sides; of equal ones the first feature and the smallest value win. Beyond ``max_leaves`` the splits
    of the largest rise stay that a tree would take one by one.
    """
    orders = by_value(x, row) if orders is None else orders
    node = tree.astype(np.int64)
    first, count = 0, trees
    parts: list[tuple[np.ndarray, ...]] = []
    live = np.ones(len(row), bool)
    while count:
        at = node[live] - first
        n = np.bincount(at, minlength=count)
        g, h = np.bincount(at, grad[live], count), np.bincount(at, weight[live], count)
        value = g / np.maximum(h + spec.l2, 1e-300)
        best, feature, threshold = np.zeros(count), np.full(count, -1), np.zeros(count)
        live &= n[np.maximum(node - first, 0)] >= 2 * spec.min_leaf
        begin = np.zeros(count, np.int64)
        held = np.where(n >= 2 * spec.min_leaf, n, 0)
        begin[1:] = np.cumsum(held)[:-1]
        whole = g * value
        for f, order in enumerate(orders):
            o = order[live[order]]
            k = (node[o] - first).astype(np.uint16 if count < 1 << 16 else np.int64)
            o = o[np.argsort(k, kind="stable")]
            k, v = node[o] - first, x[row[o], f]
            done = np.arange(len(o)) - begin[k] + 1
            cut = np.flatnonzero((v[:-1] < v[1:]) & (k[:-1] == k[1:]) & (done[:-1] >= spec.min_leaf) & (n[k[:-1]] - done[:-1] >= spec.min_leaf))
            if not len(cut):
                continue
            sums = np.concatenate(([0.0], np.cumsum(grad[o]))), np.concatenate(([0.0], np.cumsum(weight[o])))
            of = k[cut]
            gl, hl = (s[cut + 1] - s[begin[of]] for s in sums)
            rise = gl * gl / (hl + spec.l2) + (g[of] - gl) ** 2 / (h[of] - hl + spec.l2) - whole[of]
            runs = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            top = np.maximum.reduceat(rise, runs)
            place = np.minimum.reduceat(np.where(rise == np.repeat(top, np.diff(np.append(runs, len(of)))), np.arange(len(of)), len(of)), runs)
            better = top > best[of[runs]] + 1e-9 * np.abs(whole[of[runs]]) + 1e-12
            where, i = of[runs][better], cut[place[better]]
            middle = v[i] + (v[i + 1] - v[i]) / 2
            best[where], feature[where], threshold[where] = top[better], f, np.where(middle < v[i + 1], middle, v[i])
        parted = np.flatnonzero(feature >= 0)
        left = np.zeros(count, np.int64)
        left[parted] = first + count + 2 * np.arange(len(parted))
        parts.append((feature, threshold, left, best, value))
        live &= feature[np.maximum(node - first, 0)] >= 0
        here = np.flatnonzero(live)
        local = node[here] - first
        node[here] = left[local] + (x[row[here], feature[local]] > threshold[local])
        first, count = first + count, 2 * len(parted)
    grown = Grown(*(np.concatenate(c) for c in zip(*parts)))
    if spec.max_leaves:
        _keep_largest(grown, trees, spec.max_leaves)
    return grown


def _keep_largest(grown: Grown, trees: int, max_leaves: int) -> None:
    """Cut each tree back to the splits it would take one by one, the largest rise first."""
    owner = np.zeros(len(grown.feature), np.int64)
    owner[:trees] = np.arange(trees)
    inner = np.flatnonzero(grown.feature >= 0)  # parents come before children
    for i in inner.tolist():
        owner[grown.left[i] : grown.left[i] + 2] = owner[i]
    for t in np.flatnonzero(np.bincount(owner[inner], minlength=trees) >= max_leaves).tolist():
        keep, heap = set(), [(-grown.gain[t], t)]
        while heap and len(keep) < max_leaves - 1:
            _, i = heapq.heappop(heap)
            keep.add(i)
            for c in (int(grown.left[i]), int(grown.left[i]) + 1):
                if grown.feature[c] >= 0:
                    heapq.heappush(heap, (-grown.gain[c], c))
        for i in inner[owner[inner] == t].tolist():
            if i not in keep:
                grown.feature[i] = -1


def _group_quantiles(group: np.ndarray, values: np.ndarray, groups: int, q: float) -> np.ndarray:
    """Quantile of the values of each group, linear between neighbours; 0 without values."""
    order = np.lexsort((values, group))
    n = np.bincount(group, minlength=groups)
    begin = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = q * np.maximum(n - 1, 0)
    low = np.floor(at).astype(np.int64)
    v = np.append(values[order], 0.0)
    a, b = v[np.minimum(begin + low, len(v) - 1)], v[np.minimum(begin + np.minimum(low + 1, np.maximum(n - 1, 0)), len(v) - 1)]
    return np.where(n > 0, a + (b - a) * (at - low), 0.0)


def boost(x: np.ndarray, y: np.ndarray, row: np.ndarray, fold: np.ndarray, folds: int, asked: np.ndarray, asked_fold: np.ndarray,
          spec: TreeSpec, q: float | None = None) -> np.ndarray:
    """Predictions for ``asked`` rows by one boosted model per fold, all folds a round together.

    Squared loss starts at the mean and fits what is left; with ``q`` the pinball loss starts at the quantile and each leaf
    moves by the quantile of what is left in it.
    """
    target = y[row]
    n = np.maximum(np.bincount(fold, minlength=folds), 1)
    base = np.bincount(fold, target, folds) / n if q is None else _group_quantiles(fold, target, folds, q)
    raw, out = base[fold], base[asked_fold]
    orders, weight = by_value(x, row), np.ones(len(row))
    for _ in range(spec.size):
        left = target - raw
        grown = grow(x, row, fold, folds, left if q is None else np.where(left >= 0, q, q - 1), weight, spec, orders)
        at = grown.leaves(x, row, fold)
        value = grown.value if q is None else _group_quantiles(at, left, len(grown.value), q)
        raw = raw + spec.rate * value[at]
        out = out + spec.rate * value[grown.leaves(x, asked, asked_fold)]
    return out


def bag(x: np.ndarray, y: np.ndarray, spec: TreeSpec, fold: int) -> Grown:
    """A forest over all rows of ``x``, from bootstrap draws that depend on the seed and the fold only."""
    n = len(y)
    draws = np.random.default_rng([spec.seed, fold]).integers(0, n, (spec.size, n))
    times = np.bincount((draws + n * np.arange(spec.size)[:, None]).ravel(), minlength=spec.size * n).reshape(spec.size, n)
    tree, row = np.nonzero(times)
    weight = times[tree, row].astype(float)
    return grow(x, row, tree, spec.size, weight * y[row], weight, spec)


def _all_leaves(grown: Grown, x: np.ndarray, trees: int) -> np.ndarray:
    rows = np.arange(len(x))
    return np.stack([grown.leaves(x, rows, np.full(len(x), t)) for t in range(trees)], axis=1) if len(x) else np.zeros((0, trees), np.int64)


def forest_quantiles(grown: Grown, x: np.ndarray, y: np.ndarray, asked: np.ndarray, spec: TreeSpec) -> np.ndarray:
    """Quantiles of the training targets, each weighing 1 / (leaf size) in every tree where it shares the asked row's leaf.

    The answer is the smallest target whose weights up to it reach the quantile: an order statistic, without bins of values.
    """
    order = np.argsort(y, kind="stable")
    known, wanted = _all_leaves(grown, x[order], spec.size), _all_leaves(grown, asked, spec.size)
    sizes = np.bincount(known.ravel(), minlength=len(grown.feature)).astype(float)
    out = np.zeros((len(asked), len(spec.quantiles)))
    step = max(1, (1 << 22) // max(1, len(y)))
    for a in range(0, len(asked), step):
        part = wanted[a : a + step]
        w = np.zeros((len(part), len(y)))
        for t in range(spec.size):
            w += (part[:, t, None] == known[None, :, t]) / sizes[part[:, t]][:, None]
        total = np.cumsum(w, axis=1)
        for j, q in enumerate(spec.quantiles):
            out[a : a + step, j] = y[order][np.minimum((total < q * total[:, -1:] - 1e-9).sum(axis=1), len(y) - 1)]
    return out


def fit_predict(x: np.ndarray, y: np.ndarray, train: list[np.ndarray], asked: list[np.ndarray], spec: TreeSpec) -> list[np.ndarray]:
    """For each fold, outputs (rows x outputs) at the ``asked`` rows of a model of its ``train`` rows."""
    if spec.kind.endswith("boosting"):
        fold, to = (np.repeat(np.arange(len(p)), [len(r) for r in p]) for p in (train, asked))
        row, at = np.concatenate(train), np.concatenate(asked)
        qs = spec.quantiles if spec.kind.startswith("quantile") else (None,)
        both = np.stack([boost(x, y, row, fold, len(train), at, to, spec, q) for q in qs], axis=1)
        return np.split(both, np.cumsum([len(r) for r in asked])[:-1])
    out = []
    for k, (rows, wanted) in enumerate(zip(train, asked)):
        grown = bag(x[rows], y[rows], spec, k)
        if spec.kind == "forest":
            out.append(grown.value[_all_leaves(grown, x[wanted], spec.size)].mean(axis=1)[:, None])
        else:
            out.append(forest_quantiles(grown, x[rows], y[rows], x[wanted], spec))
    return out


def backtest(df: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, date: str, spec: splits.FoldSpec,
             model: TreeSpec = BOOSTING, folds: DataFrame | None = None) -> DataFrame:
    """One-step rolling-origin backtest of a tree model per series and fold: ``keys, date, target, fold, n_train`` and the outputs.

    Rows with a missing feature or target are left out; a fold for which a series has no earlier rows has none of its own. Folds are
    a table bounded by the calendar, and the only one that the driver reads.
    """
    names = [*dict.fromkeys([*keys, date, target, *features])]
    clean = df.dropna(subset=[*features, target]).select(*names)
    table = splits.fold_table(clean, date, spec) if folds is None else folds
    bounds = [
        tuple(None if r[c] is None else r[c].timestamp() for c in ("train_start", "train_end", "val_start", "val_end")) + (r["fold"],)
        for r in table.orderBy("fold").collect()
    ]
    kinds = {f.name: f.dataType.simpleString() for f in clean.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in [*keys, date]), f"{target} double, fold int, n_train bigint", *(f"{c} double" for c in model.outputs)])
    zone = clean.sparkSession.conf.get("spark.sql.session.timeZone")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(date, kind="stable", ignore_index=True)
        when = pd.to_datetime(rows[date])
        when = when.dt.tz_localize(zone) if when.dt.tz is None else when
        at = (when - pd.Timestamp(0, tz="UTC")).dt.total_seconds().to_numpy()
        x, y = rows[list(features)].to_numpy(float), rows[target].to_numpy(float)
        used, train, asked = [], [], []
        for since, until, begin, end, fold in bounds:
            before = np.flatnonzero((at < until) & (at >= (float("-inf") if since is None else since)))
            wanted = np.flatnonzero((at >= begin) & (at < end))
            if len(before) and len(wanted):
                used.append(fold), train.append(before), asked.append(wanted)
        if not used:
            return rows.iloc[:0][[*keys, date, target]].assign(fold=0, n_train=0, **{c: 0.0 for c in model.outputs})
        found = np.concatenate(fit_predict(x, y, train, asked, model))
        out = rows.iloc[np.concatenate(asked)][[*keys, date, target]].reset_index(drop=True)
        sizes = [len(r) for r in asked]
        out["fold"], out["n_train"] = np.repeat(used, sizes), np.repeat([len(r) for r in train], sizes)
        return out.assign(**{c: found[:, j] for j, c in enumerate(model.outputs)})

    return clean.withColumn(target, F.col(target).cast("double")).groupBy(*keys).applyInPandas(run, schema)
