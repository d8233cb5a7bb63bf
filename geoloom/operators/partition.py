"""Spatial partitioning: a sample, an R*-style balanced kd tree, and the lookup of points in it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splits of a tree that are written out as nested conditions; a larger tree is searched by a UDF.
INLINE_SPLITS = 128
MIN_SHARE = 0.95


@dataclass
class Sample:
    points: np.ndarray
    box: tuple[float, float, float, float]
    rows: int


def sample_points(df: DataFrame, cap: int | None = 10_000, ratio: float = 1.0, seed: int = 42) -> Sample:
    """Centroids of ``cap`` rows, those of the least hash (so the sample is the same in any order), or of a share of all rows; and the box and number of all.

    ``df`` has the summary's columns. With a cap the ratio doesn't matter.
    """
    there = df.filter("_cx is not null")
    xmin, ymin, xmax, ymax, rows = there.agg(F.min("_bbox_xmin"), F.min("_bbox_ymin"), F.max("_bbox_xmax"), F.max("_bbox_ymax"), F.count("*")).first()
    if not rows:
        raise ValueError("no geometry to sample")
    points = there.select("_cx", "_cy")
    if cap is not None:
        points = points.orderBy(F.xxhash64("_cx", "_cy", F.lit(seed)), "_cx", "_cy").limit(cap)
    else:
        points = points.sample(ratio, seed)
    got = np.array([tuple(r) for r in points.collect()], np.float64).reshape(-1, 2)
    return Sample(got, (xmin, ymin, xmax, ymax), rows)


def point_weights(sample: np.ndarray, histogram: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Each bin's value divided (in whole numbers) among the sample points in it; row 0 of the histogram is the lowest y."""
    n_rows, n_cols = histogram.shape
    at = lambda v, lo, hi, n: np.clip(((v - lo) / max(hi - lo, 1e-300) * n).astype(np.int64), 0, n - 1)
    cell = at(sample[:, 1], box[1], box[3], n_rows) * n_cols + at(sample[:, 0], box[0], box[2], n_cols)
    there = np.bincount(cell, minlength=histogram.size)
    return (histogram.ravel()[cell] // np.maximum(there[cell], 1)).astype(np.int64)


@dataclass
class KDTree:
    """Split k sends points with coordinate <= value to its low child; children -p-1 are partitions p."""

    axis: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    partitions: int = 1

    def search(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), np.int64) if self.axis else np.full(len(points), -1)
        axis, value, low, high = (np.array(x) for x in (self.axis, self.value, self.low, self.high))
        while (open_ := np.flatnonzero(at >= 0)).size:
            k = at[open_]
            at[open_] = np.where(points[open_, axis[k]] <= value[k], low[k], high[k])
        return -at - 1

    def column(self, x: Column, y: Column) -> Column:
        """The partition of a point: nested conditions, which stay in generated code, while the tree is small."""
        if len(self.axis) <= INLINE_SPLITS:

            def at(ref: int) -> Column:
                if ref < 0:
                    return F.lit(-ref - 1)
                c = x if self.axis[ref] == 0 else y
                return F.when(c <= self.value[ref], at(self.low[ref])).otherwise(at(self.high[ref]))

            return (at(0) if self.axis else F.lit(0)).cast("int")
        tree = self

        @F.pandas_udf("int")
        def find(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(tree.search(np.column_stack([a.to_numpy(float), b.to_numpy(float)])).astype(np.int32))

        return find(x, y)

    def boxes(self, box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
        """The part of ``box`` that belongs to each partition."""
        out: list[tuple] = [box] * self.partitions

        def walk(ref: int, b: tuple) -> None:
            if ref < 0:
                out[-ref - 1] = b
                return
            k, v = self.axis[ref], self.value[ref]
            cut = min(max(v, b[k]), b[k + 2])
            walk(self.low[ref], (*b[: k + 2], cut, *b[k + 3 :]))
            walk(self.high[ref], (*b[:k], cut, *b[k + 1 :]))

        if self.axis:
            walk(0, box)
        return out


def _extents(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of the first k points, for every k."""
    return np.minimum.accumulate(v), np.maximum.accumulate(v)


def choose_split(points: np.ndarray, weights: np.ndarray, least: float) -> tuple[int, int, np.ndarray] | None:
    """Axis, size of the low side and order of the best split: the least margins, then overlap, then areas; the median if no side could have ``least``."""
    n = len(points)
    best = None
    for axis in (0, 1):
        order = np.lexsort((points[:, 1 - axis], points[:, axis]))
        p = points[order]
        left = np.cumsum(weights[order])[:-1]
        k = np.arange(1, n)
        # Points of equal coordinate can't be parted.
        can = p[1:, axis] > p[:-1, axis]
        good = can & (left >= least) & (left[-1] + weights[order[-1]] - left >= least)
        if not good.any():
            if not can.any():
                continue
            half = (left[-1] + weights[order[-1]]) / 2
            good = can & (np.abs(left - half) == np.abs(left - half)[can].min())
        llo, lhi = _extents(p)
        rlo, rhi = (x[::-1] for x in _extents(p[::-1]))
        a, b = (llo[:-1], lhi[:-1]), (rlo[1:], rhi[1:])
        margin = (a[1] - a[0]).sum(1) + (b[1] - b[0]).sum(1)
        shared = np.clip(np.minimum(a[1], b[1]) - np.maximum(a[0], b[0]), 0, None).prod(1)
        area = (a[1] - a[0]).prod(1) + (b[1] - b[0]).prod(1)
        at = np.flatnonzero(good)
        i = at[np.lexsort((area[at], shared[at], margin[at]))[0]]
        key = (margin[i], shared[i], area[i])
        if best is None or key < best[0]:
            best = (key, axis, int(k[i]), order)
    return None if best is None else best[1:]


def build_tree(points: np.ndarray, box: tuple[float, float, float, float], partitions: int, weights: np.ndarray | None = None, share: float = MIN_SHARE) -> KDTree:
    """Leaves of at most 1/partitions of the weight each (points that coincide can't be parted), numbered from left to right."""
    if not len(points):
        points = np.random.default_rng(0).uniform(box[:2], box[2:], (1000, 2))
        weights = None
    w = np.ones(len(points)) if weights is None else np.asarray(weights, np.float64)
    capacity = math.ceil(w.sum() / max(1, partitions))
    least = math.ceil(share * capacity) if weights is None else share * w.sum() / max(1, partitions)
    tree, leaves = KDTree(), 0
    todo: list[tuple[np.ndarray, int, str]] = [(np.arange(len(points)), -1, "")]
    while todo:
        rows, parent, side = todo.pop()
        split = choose_split(points[rows], w[rows], least) if w[rows].sum() > capacity and len(rows) > 1 else None
        if split is None:
            ref, leaves = -leaves - 1, leaves + 1
        else:
            axis, k, order = split
            ref = len(tree.axis)
            tree.axis.append(axis)
            tree.value.append(float(points[rows[order[k - 1]], axis]))
            tree.low.append(0)
            tree.high.append(0)
            todo.append((rows[order[k:]], ref, "high"))
            todo.append((rows[order[:k]], ref, "low"))
        if parent >= 0:
            getattr(tree, side)[parent] = ref
    tree.partitions = leaves
    return tree


def partition_count(size_bytes: int, partition_size: int) -> int:
    return max(1, math.ceil(size_bytes / partition_size))
