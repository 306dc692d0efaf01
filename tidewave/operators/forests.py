"""Random forests fitted inside tasks: seeds, folds and train sizes are rows of a table, one fit each.

Small runs share a task; the trees of a large one are dealt to many, each of which holds the run's numbers. The forest grows many trees level by level as arrays, with balanced class weights, a
least number of rows to split a node and to be a leaf, and a random choice of features at each node.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import groups, slices

#: Rows of one run, train and test together, up to which one task fits its forest whole.
MOST_ROWS = 200_000

#: Trees of a larger run that one task grows.
TREES_OF_A_TASK = 10

#: Trees that grow together; a level of them sorts so many times the rows.
TREES_TOGETHER = 25

#: Places in trees that are followed at once.
VALUES_TOGETHER = 100_000


@dataclass(frozen=True)
class Settings:
    """Of a forest; ``split`` and ``leaf`` count different rows, ``explained`` is the share of variance that principal components keep (None: none are made)."""

    trees: int = 500
    depth: int = 30
    split: int = 5
    leaf: int = 2
    explained: float | None = None


def sorted_places(values: np.ndarray, below: int) -> np.ndarray:
    """The stable order of whole numbers from 0 on; packed with their places, if 63 bits hold both, they sort several times as fast."""
    bits = max(1, len(values)).bit_length()
    if below.bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    return np.sort(values << bits | np.arange(len(values))) & ((1 << bits) - 1)


class Forest:
    """Trees as arrays over all nodes: feature (-1: a leaf), threshold, left child (the right one follows it), class shares."""

    def __init__(self, x: np.ndarray, y: np.ndarray, settings: Settings, seed: int, together: int = TREES_TOGETHER):
        self.classes, codes = np.unique(y, return_inverse=True)
        self.settings, self.x, self.codes = settings, x, codes
        counts = np.bincount(codes)
        self.weights = len(y) / (len(counts) * counts)
        self.ranks = np.stack([np.unique(c, return_inverse=True)[1] for c in x.T], axis=1) if len(x) else x.astype(int)
        rng = np.random.default_rng(seed)
        self.parts = [self._grow(min(together, settings.trees - at), rng) for at in range(0, settings.trees, together)]
        del self.x, self.ranks, self.codes

    def _grow(self, trees: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        n, width = self.x.shape
        k, tried = len(self.classes), max(1, int(np.log2(width)))
        drawn = np.stack([np.bincount(rng.integers(0, n, n), minlength=n) for _ in range(trees)])
        node, row = np.nonzero(drawn)
        weight = drawn[node, row] * self.weights[self.codes[row]]
        features, thresholds, lefts, shares = [], [], [], []
        first, count = 0, trees  # of this level's nodes
        for depth in range(self.settings.depth + 1):
            held = np.bincount(node * k + self.codes[row], weight, count * k).reshape(count, k)
            size = np.bincount(node, minlength=count)
            shares.append(held / held.sum(axis=1, keepdims=True))
            feature, threshold, left = np.full(count, -1), np.zeros(count), np.full(count, -1)
            open_nodes = (size >= self.settings.split) & (held.max(axis=1) < held.sum(axis=1) * (1 - 1e-12)) & (depth < self.settings.depth)
            keep = open_nodes[node]
            node, row, weight = node[keep], row[keep], weight[keep]
            if len(node):
                feature, threshold, cut = self._best(node, row, weight, count, rng.random((count, width)).argpartition(tried - 1, axis=1)[:, :tried])
                keep = feature[node] >= 0
                node, row, weight = node[keep], row[keep], weight[keep]
            order = np.cumsum(feature >= 0) - 1
            left[feature >= 0] = first + count + 2 * order[feature >= 0]
            features.append(feature)
            thresholds.append(threshold)
            lefts.append(left)
            if not len(node):
                break
            right = self.ranks[row, feature[node]] > cut[node]
            node = 2 * order[node] + right
            first, count = first + count, 2 * int((feature >= 0).sum())
        return trees, np.concatenate(features), np.concatenate(thresholds), np.concatenate(lefts), np.concatenate(shares)

    def _best(self, node: np.ndarray, row: np.ndarray, weight: np.ndarray, count: int, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The feature (-1: none), threshold and rank to split each node at: the lowest Gini impurity, the first of equal ones."""
        k, leaf = len(self.classes), self.settings.leaf
        best, feature, threshold, cut = np.full(count, -np.inf), np.full(count, -1), np.zeros(count), np.zeros(count, int)
        for nth in range(tried.shape[1]):
            own = tried[node, nth]
            value = self.ranks[row, own]
            at = sorted_places(node * (len(self.x) + 1) + value, count * (len(self.x) + 1))
            n, v, r = node[at], value[at], row[at]
            starts = np.flatnonzero(np.diff(n, prepend=-1))
            sizes = np.diff(np.append(starts, len(n)))
            place = np.arange(len(n)) - np.repeat(starts, sizes) + 1
            sums = np.zeros((len(n), k))
            sums[np.arange(len(n)), self.codes[r]] = weight[at]
            sums = np.cumsum(sums, axis=0)
            before = np.repeat(np.vstack([np.zeros(k), sums])[starts], sizes, axis=0)
            whole = np.repeat(sums[starts + sizes - 1], sizes, axis=0) - before
            low = sums - before
            high = whole - low
            last = np.append(n[1:] != n[:-1], True) | np.append(v[1:] == v[:-1], True)
            fine = ~last & (place >= leaf) & (np.repeat(sizes, sizes) - place >= leaf)
            score = np.full(len(n), -np.inf)
            score[fine] = (low[fine] ** 2).sum(axis=1) / low[fine].sum(axis=1) + (high[fine] ** 2).sum(axis=1) / high[fine].sum(axis=1)
            top = np.maximum.reduceat(score, starts)
            hits = np.flatnonzero((score == np.repeat(top, sizes)) & fine)
            hits = hits[np.unique(n[hits], return_index=True)[1]]
            better = hits[score[hits] > best[n[hits]]]
            m = n[better]
            best[m], feature[m], cut[m] = score[better], tried[m, nth], v[better]
            threshold[m] = (self.x[r[better], feature[m]] + self.x[r[better + 1], feature[m]]) / 2
        return feature, threshold, cut

    def shares_of(self, x: np.ndarray) -> np.ndarray:
        """Each row's class shares, averaged over trees."""
        total = np.zeros((len(x), len(self.classes)))
        together = max(1, VALUES_TOGETHER // max(len(x), 1))  # trees that are walked at once
        for trees, feature, threshold, left, shares in self.parts:
            for start in range(0, trees, together):
                roots = np.arange(start, min(start + together, trees))
                node, row = np.repeat(roots, len(x)), np.tile(np.arange(len(x)), len(roots))
                inner = np.flatnonzero(feature[node] >= 0)
                while len(inner):
                    at = node[inner]
                    node[inner] = left[at] + (x[row[inner], feature[at]] > threshold[at])
                    inner = inner[feature[node[inner]] >= 0]
                for own in node.reshape(len(roots), len(x)):
                    total += shares[own]
        return total / self.settings.trees

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[self.shares_of(x).argmax(axis=1)]


def prepared(train: np.ndarray, test: np.ndarray, explained: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Both with medians of ``train`` for missing values, in its standard scores, and as its principal components if asked for."""
    known = np.where(np.isfinite(train), train, np.nan)
    middle = np.array([np.median(c) if len(c := col[~np.isnan(col)]) else 0.0 for col in known.T])
    train, test = (np.where(np.isfinite(x), x, middle) for x in (train, test))
    mean, sd = train.mean(axis=0), train.std(axis=0)
    train, test = ((x - mean) / np.where(sd > 0, sd, 1) for x in (train, test))
    if explained is not None:
        _, singular, right = np.linalg.svd(train, full_matrices=False)
        share = np.cumsum(singular**2) / max((singular**2).sum(), 1e-300)
        right = right[: int(np.searchsorted(share, explained - 1e-12)) + 1]
        right = right * np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:, None]
        train, test = train @ right.T, test @ right.T
    return train, test


def run_seed(keys: tuple) -> int:
    """The same for the same run, wherever it is fitted."""
    return zlib.crc32("|".join(map(str, keys)).encode())


def fit_run(rows: pd.DataFrame, keys: list[str], key: str, label: str, features: list[str], settings: Settings) -> pd.DataFrame:
    """keys, key, label, predicted for the test rows of one run. Without train rows nothing is predicted (NULL)."""
    rows = rows.sort_values(key, kind="stable")
    test = rows["side"] == "test"
    out = rows.loc[test, [*keys, key, label]].copy()
    out["predicted"] = predicted((rows["side"] == "train").to_numpy(), test.to_numpy(), rows[label].to_numpy(), rows[features].to_numpy(float), settings, run_seed(tuple(rows[keys].iloc[0])))
    return out


def predicted(train: np.ndarray, test: np.ndarray, y: np.ndarray, x: np.ndarray, settings: Settings, seed: int) -> list | np.ndarray:
    """The classes of the ``test`` rows by a forest of the ``train`` rows with a label."""
    known = train & ~pd.isna(y)
    if not known.any() or not test.any():
        return [None] * int(test.sum())
    own, other = prepared(x[known], x[test], settings.explained)
    return Forest(own, y[known], settings, seed).predict(other)


def _rows_of(sided: DataFrame, keys: list[str], key: str, label: str, features: list[str]) -> DataFrame:
    """What a task needs of a run: whether a row is train or test, its label and numbers, and the keys once more, for the seed."""
    numbers = [F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    sides = [F.coalesce(F.col("side") == s, F.lit(False)).alias(s) for s in ("train", "test")]
    return sided.select(*keys, F.col(key).alias("id"), F.col(label).alias("y"), *sides, *numbers, *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def _matrix(columns: dict[str, np.ndarray], features: list[str]) -> np.ndarray:
    return np.column_stack([columns[f"x{i}"] for i in range(len(features))]).astype(float)


def fitted_runs(sided: DataFrame, keys: list[str], key: str, label: str, features: list[str], settings: Settings = Settings(), most: int = MOST_ROWS) -> DataFrame:
    """keys, key, label, predicted: the test rows of each run, a run being the rows with equal ``keys``, all runs in one job.

    ``side`` says train or test. A run is fitted by one task, which holds its rows, and a task fits many small runs; a
    run of more than ``most`` rows is an error: ``fitted`` deals its trees to tasks. ``key`` tells rows apart and orders
    them, so that a run gives the same wherever it is fitted.
    """
    largest = sided.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if largest > most:
        raise ValueError(f"a run has {largest} rows, more than the {most} that a task may hold: use evaluation.fitted or forests.fitted")
    types = dict(sided.dtypes)

    def fit(id: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, **columns: np.ndarray) -> list:
        seed = run_seed(tuple(columns[f"k{i}"][0] for i in range(len(keys))))
        return [id[test], y[test], predicted(train, test, y, _matrix(columns, features), settings, seed)]

    found = groups.applied(_rows_of(sided, keys, key, label, features), keys, ["id"], fit, {"__id": types[key], "__y": types[label], "predicted": types[label]})
    return found.withColumnsRenamed({"__id": key, "__y": label})


def fitted(sided: DataFrame, keys: list[str], key: str, label: str, features: list[str], settings: Settings = Settings(), most: int = MOST_ROWS) -> DataFrame:
    """``fitted_runs`` of runs of any size: those of more than ``most`` rows are fitted by many tasks, some trees each."""
    counts = sided.groupBy(*keys).agg(F.count("*").alias("__rows")).persist()
    large = counts.where(F.col("__rows") > most).count()
    if not large:
        return fitted_runs(sided, keys, key, label, features, settings, most)
    if large == counts.count():
        return fitted_by_trees(sided, keys, key, label, features, settings, runs=large)
    sized = slices.met(sided, counts, keys)
    small = fitted_runs(sized.where(F.col("__rows") <= most).drop("__rows"), keys, key, label, features, settings, most)
    return small.unionByName(fitted_by_trees(sized.where(F.col("__rows") > most).drop("__rows"), keys, key, label, features, settings, runs=large))


def fitted_by_trees(sided: DataFrame, keys: list[str], key: str, label: str, features: list[str], settings: Settings = Settings(), trees: int = TREES_OF_A_TASK, runs: int = 1) -> DataFrame:
    """The same, a run's forest being grown by many tasks: each learns ``trees`` trees, one after the other, from all of the run's train rows.

    A task holds the numbers of a run's rows and what one tree sorts. Each gives the shares of the classes of each test
    row as whole numbers, so that their sums don't depend on an order. Parts of a forest have seeds of their own.
    """
    types, parts = dict(sided.dtypes), -(-settings.trees // trees)
    rows = _rows_of(sided, keys, key, label, features).withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("__part"))

    def grow(id: np.ndarray, y: np.ndarray, train: np.ndarray, test: np.ndarray, part: np.ndarray, **columns: np.ndarray) -> list:
        known = train & ~pd.isna(y)
        if not known.any() or not test.any():
            return [id[test], y[test], [None] * int(test.sum()), [0] * int(test.sum())]
        own, other = prepared(*(_matrix(columns, features)[side] for side in (known, test)), settings.explained)
        nth = int(part[0])
        few = replace(settings, trees=min(trees, settings.trees - nth * trees))
        forest = Forest(own, y[known], few, run_seed((*[columns[f"k{i}"][0] for i in range(len(keys))], "part", nth)), together=1)
        shares = np.rint(forest.shares_of(other) * few.trees * 2.0**32).astype(np.int64)
        n, k = shares.shape
        return [np.repeat(id[test], k), np.repeat(y[test], k), np.tile(forest.classes, n), shares.ravel()]

    found = groups.applied(rows, [*keys, "__part"], ["id"], grow, {"__id": types[key], "__y": types[label], "__class": types[label], "__share": "long"}, tasks=2 * runs * parts)
    totals = found.groupBy(*keys, "__id", "__y", "__class").agg(F.sum("__share").alias("__share"))
    best = totals.groupBy(*keys, "__id", "__y").agg(F.min(F.struct((-F.col("__share")).alias("less"), F.col("__class").alias("class")))["class"].alias("predicted"))
    return best.withColumnsRenamed({"__id": key, "__y": label})
