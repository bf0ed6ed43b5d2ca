"""Forests, extremely randomised trees and leaf-wise histogram boosting.

Training data is a table of binned rows with a weight and a label sum.  Rows with equal bins
have equal predictions, so their sums of gradients and curvatures follow from the row count and
the label sum: a table summed by bins trains as the rows themselves would.  It holds every row, in
a byte for each feature, and is broadcast; the trees of all models, folds and refits are units
of work that Spark spreads over tasks.  A model is a table of
trees; scoring is a vectorised function over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREE = "model string, number int, feature array<int>, cut array<double>, below array<int>, above array<int>, value array<double>, gain array<double>"


@dataclass
class Cells:
    """Binned training rows: ``bins`` (rows x features), their weights and label sums, and the cuts
    of each feature (a row's bin is the number of cuts below its value)."""

    bins: np.ndarray
    weight: np.ndarray
    label_sum: np.ndarray
    cuts: list[np.ndarray]

    def part(self, keep: np.ndarray) -> "Cells":
        return Cells(self.bins[keep], self.weight[keep], self.label_sum[keep], self.cuts)

    @property
    def size(self) -> int:
        return max([len(c) for c in self.cuts], default=0) + 1


@dataclass
class Tree:
    feature: list = field(default_factory=list)
    cut: list = field(default_factory=list)
    below: list = field(default_factory=list)
    above: list = field(default_factory=list)
    value: list = field(default_factory=list)
    gain: list = field(default_factory=list)

    def add(self, value: float) -> int:
        for name, v in (("feature", -1), ("cut", 0.0), ("below", -1), ("above", -1), ("value", float(value)), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, cut: float, gain: float, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.gain[node] = int(feature), float(cut), float(gain)
        self.below[node], self.above[node] = self.add(values[0]), self.add(values[1])
        return self.below[node], self.above[node]


def cuts_of(column: np.ndarray, bins: int = 255) -> np.ndarray:
    """Cuts midway between values; of many values, at their quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def table_cuts(df: DataFrame, column: str, n_rows: int, bins: int = 255) -> list[np.ndarray]:
    """``cuts_of`` each feature of the array ``column`` over all ``n_rows`` rows: tasks count their
    distinct values, then a task a feature adds them up."""
    wanted = np.unique(np.quantile(np.arange(max(1, n_rows)), np.linspace(0, 1, bins), method="nearest"))

    def values(frames):
        for frame in frames:
            x = np.stack(frame[column].to_numpy())
            found = [np.unique(x[:, f], return_counts=True) for f in range(x.shape[1])]
            yield pd.DataFrame({"f": range(x.shape[1]), "v": [v for v, _ in found], "n": [n for _, n in found]})

    def cuts(frame):
        v, at = np.unique(np.concatenate(frame["v"].to_list()), return_inverse=True)
        n = np.bincount(at.ravel(), np.concatenate(frame["n"].to_list()))
        if len(v) > bins:
            v = np.unique(v[np.searchsorted(np.cumsum(n), wanted, "right")])
        return pd.DataFrame({"f": frame["f"].iloc[:1].to_list(), "v": [(v[1:] + v[:-1]) / 2]})

    counted = df.select(column).mapInPandas(values, "f int, v array<double>, n array<long>")
    rows = counted.groupBy("f").applyInPandas(cuts, "f int, v array<double>").collect()  # 254 cuts a feature at most
    return [np.array(r["v"], float) for r in sorted(rows, key=lambda r: r["f"])]


def with_bins(df: DataFrame, column: str, cuts: list[np.ndarray], out: str = "bins") -> DataFrame:
    """``df`` with the bins of the features in the array ``column``, a byte each."""
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("binary")
    def bins(x: pd.Series) -> pd.Series:
        return pd.Series([r.tobytes() for r in binned(np.stack(x.to_numpy()), shared.value)] if len(x) else [], dtype=object)

    return df.withColumn(out, bins(column))


def binned(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, rows[:, f], "left") for f, c in enumerate(cuts)], 1).astype(np.uint8) if len(cuts) else np.zeros((len(rows), 0), np.uint8)


#: Rows whose bins are widened to histogram keys at a time, and histogram entries that are held at a time.
_ROWS, _ENTRIES = 1 << 16, 1 << 22


def _histogram(key_of, values: list, n_rows: int, length: int) -> list[np.ndarray]:
    """Sums of each of ``values`` by the keys ``key_of(lo, hi)`` (rows x features) of all rows."""
    out = [np.zeros(length) for _ in values]
    for lo in range(0, n_rows, _ROWS):
        hi = min(n_rows, lo + _ROWS)
        key = key_of(lo, hi)
        for o, v in zip(out, values):
            o += np.bincount(key.ravel(), np.repeat(v[lo:hi], key.shape[1]), length)
    return out


def _extremes(bins: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest bin (nodes x features) of the rows of each node, which begin at ``starts``."""
    lo = np.full((len(starts), bins.shape[1]), 255, np.uint8)
    hi = np.zeros_like(lo)
    for at in range(0, len(rows), _ROWS):
        x = bins[rows[at:at + _ROWS]]
        first, last = np.searchsorted(starts, [at, at + len(x) - 1], "right") - 1
        cut = np.maximum(starts[first:last + 1] - at, 0)
        lo[first:last + 1] = np.minimum(lo[first:last + 1], np.minimum.reduceat(x, cut, axis=0))
        hi[first:last + 1] = np.maximum(hi[first:last + 1], np.maximum.reduceat(x, cut, axis=0))
    return lo.astype(int), hi.astype(int)


def grow(cells: Cells, weight: np.ndarray, label_sum: np.ndarray, depth: int, tried: int, rng, random_cut: bool = False) -> Tree:
    """A tree by variance (for labels 0 and 1: Gini) with ``tried`` features at each node, chosen
    at random among those that vary there.  With ``random_cut`` each has one cut drawn uniformly
    between its extremes in the node; else all cuts are tried."""
    tree, n_features, size = Tree(), cells.bins.shape[1], cells.size
    tree.add(label_sum.sum() / max(weight.sum(), 1e-12))
    rows = np.flatnonzero(weight > 0)
    at, nodes = np.zeros(len(rows), np.int64), [0]
    for _ in range(depth):
        if not len(nodes) or not len(rows):
            break
        k, pick = len(nodes), np.take_along_axis
        # the rows of a node side by side, in their order
        place = np.argsort(at, kind="stable")
        rows, at = rows[place], at[place]
        starts = np.searchsorted(at, np.arange(k))
        lows, highs = _extremes(cells.bins, rows, starts)
        orders = np.where(lows < highs, rng.random((k, n_features)), 2).argsort(1)[:, :tried]
        drawn_at = rng.random(orders.shape) if random_cut else None
        chosen, target, then, cuts = np.full(k, -1), np.full((k, 2), -1), [], np.zeros(k, int)
        many = max(1, _ENTRIES // max(1, orders.shape[1] * size))
        for first in range(0, k, many):
            last, begin = min(k, first + many), starts[first]
            end = starts[last] if last < k else len(rows)
            order, mine, here = orders[first:last], rows[begin:end], at[begin:end] - first
            n, width = last - first, order.shape[1]

            def key_of(lo, hi):
                features = order[here[lo:hi]]
                return (here[lo:hi, None] * width + np.arange(width)) * size + cells.bins[mine[lo:hi, None], features]

            w, s = (np.cumsum(x.reshape(n, width, size), 2) for x in _histogram(key_of, [weight[mine], label_sum[mine]], len(mine), n * width * size))
            total_w, total_s = w[:, :1, -1:], s[:, :1, -1:]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = s ** 2 / w + (total_s - s) ** 2 / (total_w - w) - total_s ** 2 / total_w
            gain = np.where((w > 1e-9) & (total_w - w > 1e-9), gain, -1.0)
            if random_cut:
                low, high = pick(lows[first:last], order, 1), pick(highs[first:last], order, 1)
                drawn = low + np.floor(drawn_at[first:last] * np.maximum(high - low, 1)).astype(int)
                only = np.zeros_like(gain, bool)
                np.put_along_axis(only, np.minimum(drawn, size - 1)[:, :, None], True, 2)
                gain = np.where(only, gain, -1.0)
            best = gain.reshape(n, -1).argmax(1)
            slot, cut = best // size, best % size
            found = gain.reshape(n, -1)[np.arange(n), best]
            for i in np.flatnonzero(found > 1e-12 * np.maximum(1.0, total_w[:, 0, 0])):
                f, b = order[i, slot[i]], cut[i]
                lw, ls = w[i, slot[i], b], s[i, slot[i], b]
                values = (ls / lw, (total_s[i, 0, 0] - ls) / (total_w[i, 0, 0] - lw))
                kids = tree.split(nodes[first + i], f, cells.cuts[f][b], found[i], values)
                chosen[first + i], target[first + i], cuts[first + i] = f, (len(then), len(then) + 1), b
                then += kids
        stays = chosen[at] >= 0
        rows, at = rows[stays], at[stays]
        if len(rows):
            at = target[at, (cells.bins[rows, chosen[at]] > cuts[at]).astype(int)]
        nodes = then
    return tree


def boost(cells: Cells, rounds: int, depth: int, leaves: int = 31, rate: float = 0.1, least_rows: float = 20, ridge: float = 0.0,
          logistic: bool = False, held: Cells | None = None, patience: int = 10, tol: float = 1e-7) -> tuple[float, list[Tree]]:
    """Start value and trees, grown leaf by leaf (the open leaf of largest gain first) on histograms
    of gradients and curvatures, the larger child's by subtraction.  With ``held`` rows it ends
    when their loss has not fallen for ``patience`` rounds."""
    w, y = cells.weight, cells.label_sum
    mean = y.sum() / w.sum()
    start = float(np.log(np.clip(mean, 1e-9, 1 - 1e-9) / (1 - np.clip(mean, 1e-9, 1 - 1e-9)))) if logistic else float(mean)
    raw, trees = np.full(len(w), start), []
    held_raw = None if held is None else np.full(len(held.weight), start)
    losses, n_features, size = [], cells.bins.shape[1], cells.size
    offset = np.arange(n_features) * size

    def histogram(rows, g, h):
        sums = _histogram(lambda lo, hi: cells.bins[rows[lo:hi]] + offset, [v[rows] for v in (g, h, w)], len(rows), n_features * size)
        return np.stack([x.reshape(n_features, size) for x in sums])

    def best_split(hist):
        left = np.cumsum(hist, 2)[:, :, :-1]
        total = hist[:, 0].sum(1)[:, None, None]
        right = total - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
        gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows) & np.isfinite(gain), gain, -1.0)
        at = int(gain.argmax()) if gain.size else 0
        return (float(gain.flat[at]), at // max(1, size - 1), at % max(1, size - 1)) if gain.size else (-1.0, 0, 0)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw)) if logistic else raw
        g, h = y - w * p, (w * p * (1 - p) + 1e-16 if logistic else w.astype(float))
        tree, everything = Tree(), np.arange(len(w))
        tree.add(rate * g.sum() / (h.sum() + ridge))
        first = histogram(everything, g, h)
        open_leaves = [(*best_split(first), 0, everything, first, 0)]
        while len(open_leaves) and (len(tree.feature) + 1) // 2 < leaves:
            i = max(range(len(open_leaves)), key=lambda j: (open_leaves[j][0], -open_leaves[j][3]))
            gain, f, b, node, rows, hist, level = open_leaves.pop(i)
            if gain <= 1e-12:
                break
            goes = cells.bins[rows, f] > b
            parts = (rows[~goes], rows[goes])
            small = int(len(parts[1]) < len(parts[0]))
            hists = [None, None]
            hists[small] = histogram(parts[small], g, h)
            hists[1 - small] = hist - hists[small]
            kids = tree.split(node, f, cells.cuts[f][b], gain, tuple(rate * x[0, 0].sum() / (x[1, 0].sum() + ridge) for x in hists))
            for kid, part, x in zip(kids, parts, hists):
                if level + 1 < depth:
                    open_leaves.append((*best_split(x), kid, part, x, level + 1))
        trees.append(tree)
        raw = raw + predict_bins(tree, cells)
        if held is not None:
            held_raw = held_raw + predict_bins(tree, held)
            losses.append(float((held.weight * np.logaddexp(0, held_raw) - held.label_sum * held_raw).sum() if logistic
                                else (held.weight * held_raw ** 2 - 2 * held.label_sum * held_raw).sum()) / held.weight.sum())
            if len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience]) - tol:
                break
    return start, trees


def _walk(tree, go_above) -> np.ndarray:
    feature, below, above = (np.asarray(x) for x in (tree.feature, tree.below, tree.above))
    at = np.zeros(go_above.rows, np.int64)
    while True:
        moving = np.flatnonzero(feature[at] >= 0)
        if not len(moving):
            return np.asarray(tree.value)[at]
        here = at[moving]
        at[moving] = np.where(go_above(moving, feature[here], here), above[here], below[here])


class _ByValue:
    def __init__(self, tree, rows):
        self.cut, self.x, self.rows = np.asarray(tree.cut), rows, len(rows)

    def __call__(self, rows, feature, node):
        return self.x[rows, feature] > self.cut[node]


class _ByBin(_ByValue):
    def __init__(self, tree, cells):
        self.cut = np.array([np.searchsorted(cells.cuts[f], c, "left") if f >= 0 else 0 for f, c in zip(tree.feature, tree.cut)])
        self.x, self.rows = cells.bins, len(cells.bins)


def predict_bins(tree: Tree, cells: Cells) -> np.ndarray:
    return _walk(tree, _ByBin(tree, cells))


def predict_rows(tree: Tree, rows: np.ndarray) -> np.ndarray:
    return _walk(tree, _ByValue(tree, rows))


@dataclass
class Model:
    """Trees whose mean (forest) or sum over the start value (boosted) is the prediction."""

    trees: list[Tree]
    start: float = 0.0
    boosted: bool = False
    logistic: bool = False

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        for t in self.trees:
            out += predict_rows(t, rows)
        if not self.boosted:
            return out / max(1, len(self.trees))
        return 1 / (1 + np.exp(-out)) if self.logistic else out

    def importances(self, n_features: int) -> np.ndarray:
        """Mean over trees of each feature's share of the gain."""
        total = np.zeros(n_features)
        for t in self.trees:
            one = np.bincount([f for f in t.feature if f >= 0] or [0], [g for f, g in zip(t.feature, t.gain) if f >= 0] or [0.0], n_features)
            total += one / one.sum() if one.sum() > 0 else 0
        return total / total.sum() if total.sum() > 0 else total


def fit_units(spark: SparkSession, cells: Cells, units: list[dict], run) -> list[dict]:
    """Results of ``run(cells, unit)`` (a start value, a list of trees and, if only these are wanted, the
    ``scores`` of some rows) for each unit of work, one to a task: the trees of all models grow side by side."""
    shared = spark.sparkContext.broadcast((cells, units))

    def each(frames):
        for frame in frames:
            held, todo = shared.value
            for number in frame["unit"]:
                start, trees, *scores = run(held, todo[number])
                if scores:
                    yield pd.DataFrame({"unit": [int(number)], "model": ["scores"], "number": [-1], **{c: [[]] for c in ("feature", "cut", "below", "above")}, "value": scores, "gain": [[]]})
                yield pd.DataFrame({"unit": [int(number)] * (len(trees) + 1), "model": ["start"] + ["tree"] * len(trees), "number": range(len(trees) + 1),
                                    **{c: [[]] + [getattr(t, c) for t in trees] for c in ("feature", "cut", "below", "above")},
                                    "value": [[start]] + [t.value for t in trees], "gain": [[]] + [t.gain for t in trees]})

    todo = spark.createDataFrame([(i,) for i in range(len(units))], "unit int").repartition(max(1, len(units)), "unit")
    rows = todo.mapInPandas(each, "unit int, " + TREE).collect()  # bounded by the models' sizes
    out = [dict(u, start=0.0, trees=[]) for u in units]
    for r in sorted(rows, key=lambda r: (r["unit"], r["number"])):
        if r["model"] == "scores":
            out[r["unit"]]["scores"] = np.array(r["value"])
        elif r["model"] == "start":
            out[r["unit"]]["start"] = r["value"][0]
        else:
            out[r["unit"]]["trees"].append(_tree(r))
    return out


def _tree(r) -> Tree:
    return Tree(*[list(r[c]) for c in ("feature", "cut", "below", "above", "value", "gain")])


def tree_table(spark: SparkSession, models: dict[str, Model]) -> DataFrame:
    """The models as a table; ``models_of`` is the inverse."""
    rows = [(f"{name}|{int(m.boosted)}|{int(m.logistic)}", -1, [], [], [], [], [float(m.start)], []) for name, m in models.items()]
    rows += [(f"{name}|{int(m.boosted)}|{int(m.logistic)}", i, t.feature, t.cut, t.below, t.above, t.value, t.gain) for name, m in models.items() for i, t in enumerate(m.trees)]
    return spark.createDataFrame(rows, TREE)


def models_of(table: DataFrame) -> dict[str, Model]:
    out: dict[str, Model] = {}
    for r in sorted(table.collect(), key=lambda r: r["number"]):
        name, boosted, logistic = r["model"].split("|")
        m = out.setdefault(name, Model([], 0.0, boosted == "1", logistic == "1"))
        if r["number"] < 0:
            m.start = r["value"][0]
        else:
            m.trees.append(_tree(r))
    return out


class CellScores:
    """Predictions of ``models`` for rows of features, each cell scored once.

    A cell is the set of rows that lie between the same cuts of all trees: no tree tells them apart,
    so one walk through the trees serves them all.  The scores of the first ``most`` cells are kept
    for later rows; a row's own cell is always looked up, so no row takes another's score.
    """

    def __init__(self, models: dict[str, Model], most: int):
        self.models, self.most, self.known = models, most, {}
        found: dict[int, set] = {}
        for m in models.values():
            for t in m.trees:
                for f, c in zip(t.feature, t.cut):
                    if f >= 0:
                        found.setdefault(f, set()).add(c)
        self.cuts = {f: np.array(sorted(c)) for f, c in sorted(found.items())}
        self.scores = np.empty((0, len(models)))

    def _bins(self, rows: np.ndarray) -> np.ndarray:
        """The number of cuts below each value (no cut is below NaN, as in ``_ByValue``)."""
        out = [np.where(np.isnan(rows[:, f]), 0, np.searchsorted(c, rows[:, f], "left")) for f, c in self.cuts.items()]
        return np.ascontiguousarray(np.stack(out, 1).astype(np.int32)) if out else np.zeros((len(rows), 1), np.int32)

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """rows x models"""
        bins = self._bins(rows)
        cells, first, place = np.unique(bins.view(f"V{bins.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        keys = [c.tobytes() for c in cells]
        at = np.array([self.known.get(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(at < 0)
        scores = np.empty((len(cells), len(self.models)))
        scores[at >= 0] = self.scores[at[at >= 0]]
        if len(new):
            scores[new] = np.stack([m.predict(rows[first[new]]) for m in self.models.values()], 1)
            held = len(self.known)
            kept = new[:max(0, self.most - held)]
            if len(kept):
                self.known.update((keys[i], held + n) for n, i in enumerate(kept))
                self.scores = np.concatenate([self.scores, scores[kept]])
        return scores[place.ravel()]


def scored(df: DataFrame, features: Column, models: dict[str, Model], out: str = "_scores", cells: int = 0) -> DataFrame:
    """``df`` with ``out``, a struct of each model's prediction for the array ``features``.  With
    ``cells`` a task keeps the scores of so many cells (``CellScores``), for models of few cells."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    names = list(models)

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        kept = CellScores(shared.value, cells) if cells else None
        for rows in batches:
            x = np.stack(rows.to_numpy()).astype(float) if len(rows) else np.zeros((0, 1))
            if kept and len(rows):
                yield pd.DataFrame(kept.predict(x), columns=names)
            else:
                yield pd.DataFrame({n: shared.value[n].predict(x) for n in names})

    return df.withColumn(out, score(features))
