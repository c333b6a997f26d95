"""Histogram gradient boosting on Spark (M8), many models in lockstep (M9).

Trees grow best leaf first up to a leaf cap, with L2-regularised second-order
gains for squared error.  Inputs are binned once (at most 255 bins; thresholds
from a bounded sample of rows) and stored as blocks of bytes.  One Spark job adds
up, for all models at once, the histograms of every node that is asked for: rows,
gradients, and the same for the early-stopping rows, per input and bin.  Tasks sum
their blocks with numpy, Spark reduces the sums, the driver keeps one small
histogram a leaf and picks the splits.

Few jobs are needed:

* Of two siblings only the smaller is summed; the other is its parent less that.
* All open leaves are asked for at once, with the smaller child of every split
  that may come next, so a job adds one level to every tree, not one split.
* With squared error a leaf's step changes the gradients of its rows by one
  number, so the histograms of a finished tree's leaves are brought up to date
  without reading rows.  A node of the next tree that is a union of such leaves
  needs no job: a tree that splits as its predecessor did costs none.

Labels, predictions and gradients are whole numbers (31 bits for the label's range),
so sums do not depend on the order of rows: the same rows give the same model under
any partitioning and after any lost task.  A row's prediction is a function of the
trees so far; tasks only memoise it, in files of their executor's own folder, which all
its Python workers see.  So is a row's place in the growing tree: every job moves rows on
from where the last one left them.

Defined results: rows with a NULL label are ignored; a NULL or NaN input goes to the
last bin; a constant label, no usable split or an empty table gives a constant model.
"""

from __future__ import annotations

import os
import shutil
import sys
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkFiles, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from limnos.operators.regression import hash_bucket
from limnos.session import qcol, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows from which the bin thresholds are taken, at most.
SAMPLE_ROWS = 200_000
BLOCK_ROWS = 65_536
#: A task gets no fewer rows than that, and no more than 64 times as many.
TASK_ROWS = 16_384
#: Trees that travel inside each task; older ones are broadcast.
RECENT = 32
LABEL_BITS = 31
STAT_NAMES = ("rows", "gradient", "held rows", "held gradient")


@dataclass(frozen=True)
class BoostingSettings:
    """Defaults are the library defaults that the reference leaves in force."""

    learning_rate: float = 0.1
    rounds: int = 100
    max_depth: int | None = None
    least_rows: int = 20
    l2: float = 0.0
    leaves: int = 31
    bins: int = 255
    #: With more rows than that, training stops when the loss of a tenth of the rows has not fallen by ``tolerance`` in ``patience`` rounds.
    stop_above: int = 10_000
    held_share: float = 0.1
    patience: int = 10
    tolerance: float = 1e-7


@dataclass
class Tree:
    """Nodes in arrays: go left if bin <= cut; a leaf has cut 255 and points at itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    step: np.ndarray
    depth: int

    def plain(self) -> tuple:
        """The fields alone: broadcast values must not need this package."""
        return self.feature, self.cut, self.left, self.right, self.step, self.depth


@dataclass
class BoostedModel:
    """Thresholds per input, trees and the scale of their whole-number steps."""

    inputs: list[str]
    thresholds: list[np.ndarray]
    base: float
    scale: float
    trees: list[Tree] = field(default_factory=list)
    held_loss: list[float] = field(default_factory=list)

    def tables(self) -> tuple[list[tuple], list[tuple]]:
        """Rows of the two tables a model is saved as: (tree, node, feature, cut, left, right, step) and (input, position, threshold)."""
        nodes = [(t, i, int(tree.feature[i]), int(tree.cut[i]), int(tree.left[i]), int(tree.right[i]), int(tree.step[i]))
                 for t, tree in enumerate(self.trees) for i in range(len(tree.cut))]
        return nodes, [(i, k, float(v)) for i, cuts in enumerate(self.thresholds) for k, v in enumerate(cuts)]

    @classmethod
    def from_tables(cls, inputs, base, scale, nodes, cuts) -> BoostedModel:
        thresholds = [np.array([v for _, v in sorted((k, v) for i, k, v in cuts if i == n)]) for n in range(len(inputs))]
        by_tree: dict = {}
        for t, i, *rest in nodes:
            by_tree.setdefault(t, {})[i] = rest
        model = cls(list(inputs), thresholds, base, scale)
        for t in sorted(by_tree):
            rows = [by_tree[t][i] for i in range(len(by_tree[t]))]
            model.trees.append(_tree(*[list(c) for c in zip(*rows, strict=True)]))
        return model

    def binned(self, values: np.ndarray) -> np.ndarray:
        return bin_values(values, self.thresholds)

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        total = np.zeros(len(bins), np.int64)
        for tree in self.trees:
            total += tree.step[leaf_of(bins, tree)]
        return self.base + total / self.scale


def _tree(feature, cut, left, right, step) -> Tree:
    depth_of, depth = {0: 0}, 0
    for i in range(len(cut)):
        for child in {left[i], right[i]} - {i}:
            depth_of[child] = depth_of[i] + 1
            depth = max(depth, depth_of[child])
    return Tree(np.array(feature, np.int64), np.array(cut, np.int16), np.array(left, np.int64), np.array(right, np.int64), np.array(step, np.int64), depth)


# ---------------------------------------------------------------- in tasks
def bin_values(values: np.ndarray, thresholds: Sequence[np.ndarray]) -> np.ndarray:
    """Bytes: the number of thresholds below each value; missing values after all others."""
    out = np.empty(values.shape, np.uint8)
    for j, cuts in enumerate(thresholds):
        column = values[:, j]
        out[:, j] = np.where(np.isnan(column), len(cuts) + 1, np.searchsorted(cuts, column, "left"))
    return out


def leaf_of(bins: np.ndarray, tree: Tree, node: np.ndarray | None = None) -> np.ndarray:
    """Node of each row at the bottom of ``tree``, from the root or from the nodes given (which are moved on)."""
    node, flat, p = np.zeros(len(bins), np.int64) if node is None else node, bins.ravel(), bins.shape[1]
    rows = np.flatnonzero(tree.left[node] != node)
    while len(rows):
        at = node[rows]
        at = np.where(flat[rows * p + tree.feature[at]] <= tree.cut[at], tree.left[at], tree.right[at])
        node[rows] = at
        rows = rows[tree.left[at] != at]
    return node


class _Memo:
    """What is known of a block: its rows' predictions (``total``) after so many trees, and their nodes (``place``) in the tree that grows after so many.

    It can be computed again from the trees at any time.
    """

    def __init__(self, run: str, block: int):
        self.folder = os.path.join(SparkFiles.getRootDirectory(), f"limnos-boosting-{run}")
        self.block = block

    def get(self, name: str) -> tuple[int, np.ndarray | None]:
        try:
            with open(os.path.join(self.folder, f"{self.block}-{name}"), "rb") as f:
                held = np.frombuffer(f.read(), np.int64)
        except FileNotFoundError:
            return 0, None
        return int(held[0]), held[1:].copy()

    def put(self, name: str, trees: int, values: np.ndarray) -> None:
        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{self.block}-{name}")
        part = f"{path}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(np.int64(trees).tobytes() + values.astype(np.int64, copy=False).tobytes())
        os.replace(part, path)  # another try of the task sees a whole file or none


def _forget(run: str):
    def drop(_: Iterator) -> None:
        shutil.rmtree(os.path.join(SparkFiles.getRootDirectory(), f"limnos-boosting-{run}"), ignore_errors=True)
    return drop


def _current(run: str, block: int, bins: np.ndarray, done: int, trees, starts=lambda k: None) -> np.ndarray:
    """Predictions of a block's rows after ``done`` trees; ``starts`` gives a tree's nodes for the places of its growth, if known."""
    memo = _Memo(run, block)
    at, total = memo.get("total")
    if total is None or at > done:
        at, total = 0, np.zeros(len(bins), np.int64)
    if at < done:
        grown, place = memo.get("place")
        for k in range(at, done):
            tree, start = trees(k), starts(k)
            near = place is not None and start is not None and grown == k and place.max(initial=0) < len(start)
            total += tree.step[leaf_of(bins, tree, start[place] if near else None)]
        memo.put("total", done, total)
    return total


def _place(run: str, block: int, bins: np.ndarray, done: int, tree: Tree) -> np.ndarray:
    """Node of each row in the tree that grows after ``done`` others."""
    memo = _Memo(run, block)
    grown, place = memo.get("place")
    if place is None or grown != done or place.max(initial=0) >= len(tree.left):
        place = None
    place = leaf_of(bins, tree, place)
    memo.put("place", done, place)
    return place


def _sums_into(total: np.ndarray, bins: np.ndarray, slot: np.ndarray, held: np.ndarray, gradient: np.ndarray, offset: np.ndarray) -> None:
    """Add rows and gradients per slot and bin, input by input, for the trained and the held rows."""
    slots = len(total)
    rows = np.flatnonzero(slot >= 0)
    if not len(rows):
        return
    base = (slot[rows] + slots * held[rows]) * 256
    weight, columns, size = gradient[rows].astype(np.float64), np.ascontiguousarray(bins[rows].T), 2 * slots * 256
    for j, column in enumerate(columns):
        cell, at, width = base + column, int(offset[j]), int(offset[j + 1] - offset[j])
        for k, sums in ((0, np.bincount(cell, minlength=size)), (1, np.rint(np.bincount(cell, weight, size)).astype(np.int64))):
            both = sums.reshape(2, slots, 256)[:, :, :width]
            total[:, k, at:at + width] += both[0]
            total[:, k + 2, at:at + width] += both[1]


def _histograms(run: str, asked: dict, offsets: dict, older, recent: dict, first: int):
    """Per task: {unit: sums[slot, statistic, bin]} of the nodes asked for.

    ``asked``: unit -> (rounds done, tree with the nodes, whether it still grows, slot of each node or -1, slots).
    """
    def sums(blocks: Iterator) -> Iterator[dict]:
        out: dict = {}
        for unit, block, bins, label, held in blocks:
            if unit not in asked:
                continue
            done, tree, grows, slot_of, slots = asked[unit]
            trees = lambda k: recent[unit][k - first][0] if k >= first else Tree(*older.value[unit][k])  # noqa: E731, B023
            starts = lambda k: recent[unit][k - first][1] if k >= first else None  # noqa: E731, B023
            gradient = _current(run, block, bins, done, trees, starts) - label
            node = _place(run, block, bins, done, tree) if grows else leaf_of(bins, tree)
            total = out.setdefault(unit, np.zeros((slots, 4, int(offsets[unit][-1])), np.int64))
            _sums_into(total, bins, slot_of[node], held, gradient, offsets[unit])
        yield out
    return sums


def _added(a: dict, b: dict) -> dict:
    return {u: a[u] + b[u] if u in a and u in b else a.get(u, b.get(u)) for u in a.keys() | b.keys()}


# ---------------------------------------------------------------- growing, on the driver
class _Node:
    """A box of bins with its totals, its histogram once known, and its best split."""

    __slots__ = ("low", "high", "depth", "totals", "hist", "best", "children", "ready", "number", "place")

    def __init__(self, low, high, depth, totals, hist):
        self.low, self.high, self.depth, self.totals, self.hist = low, high, depth, totals, hist
        self.best = self.children = self.ready = None
        self.number = self.place = -1


class _Grower:
    """One model's training state; ``advance`` goes on until it needs histograms, ``take`` receives them."""

    def __init__(self, settings: BoostingSettings, offsets: np.ndarray, scale: float, held_rows: int, held_square: int):
        self.s, self.offsets, self.scale = settings, offsets, scale
        self.width = int(offsets[-1])
        self.trees: list[Tree] = []
        #: For each tree, its node of (or above) each place of the tree that grew.
        self.starts: list[np.ndarray] = []
        self.held_rows, self.held_square, self.held_loss = held_rows, held_square, []
        sizes = np.diff(offsets)
        self.feature_of = np.repeat(np.arange(len(sizes)), sizes)
        self.last_bin = np.zeros(self.width, bool)
        self.last_bin[offsets[1:] - 1] = True
        p = len(sizes)
        self.prev = [_Node(np.zeros(p, np.int64), sizes.astype(np.int64), 0, None, None)]
        self.prev_tree = _tree([0], [255], [0], [0], [0])
        self.prev[0].number = 0
        self.done = False
        self.nodes = None

    # -- gains
    def _split(self, node: _Node) -> None:
        """Best split (gain, feature, bin) of a node with a histogram; ties go to the first input and bin."""
        s, rows, grad = self.s, node.hist[0], node.hist[1]
        starts = np.repeat(self.offsets[:-1], np.diff(self.offsets))
        cum_c, cum_g = np.cumsum(rows), np.cumsum(grad)
        left_c = cum_c - np.where(starts > 0, cum_c[starts - 1], 0)
        left_g = cum_g - np.where(starts > 0, cum_g[starts - 1], 0)
        total_c, total_g = node.totals[0], node.totals[1]
        right_c, right_g = total_c - left_c, total_g - left_g
        fits = (left_c >= s.least_rows) & (right_c >= s.least_rows) & ~self.last_bin
        node.best = (0.0, -1, -1)
        if fits.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left_g.astype(float) ** 2 / (left_c + s.l2) + right_g.astype(float) ** 2 / (right_c + s.l2)
            gain = np.where(fits, gain, -np.inf)
            at = int(np.argmax(gain))
            better = float(gain[at]) - float(total_g) ** 2 / (float(total_c) + s.l2)
            if better > 0:
                node.best = (better, int(self.feature_of[at]), int(at - self.offsets[self.feature_of[at]]))

    def _open(self, node: _Node) -> bool:
        """May this leaf be split, as far as its totals tell?"""
        return (self.s.max_depth is None or node.depth < self.s.max_depth) and node.totals[0] >= 2 * self.s.least_rows

    def _union(self, low, high):
        """Histogram of a box that is a union of the last tree's leaves, or None."""
        inside = ((self.prev_low >= low) & (self.prev_high <= high)).all(axis=1)
        apart = ((self.prev_high <= low) | (self.prev_low >= high)).any(axis=1)
        if not (inside | apart).all():
            return None
        return sum((self.prev[k].hist for k in np.flatnonzero(inside)), np.zeros((4, self.width), np.int64))

    def _make_children(self, node: _Node) -> list[_Node]:
        _, f, b = node.best
        cell = slice(int(self.offsets[f]), int(self.offsets[f]) + b + 1)
        left_totals = node.hist[:, cell].sum(axis=1)
        out = []
        for side, totals in ((0, left_totals), (1, node.totals - left_totals)):
            low, high = node.low.copy(), node.high.copy()
            (high if side == 0 else low)[f] = b + 1
            out.append(_Node(low, high, node.depth + 1, totals, None))
        return out

    def _prepare(self, node: _Node) -> None:
        """Children of a leaf that may be split, with histograms where the last tree's leaves give them."""
        if node.ready is None and node.best is not None and node.best[0] > 0:
            node.ready = self._make_children(node)
            a, b = node.ready
            # Every split made is kept in the tree that the rows are placed in, so that places only move down.
            a.place, b.place = len(self.grown), len(self.grown) + 1
            self.grown[node.place] = (node.best[1], node.best[2], a.place, b.place)
            self.grown += [(0, 255, k, k) for k in (a.place, b.place)]
            self.above += [node.place, node.place]
            for one, other in ((a, b), (b, a)):
                if one.hist is None:
                    one.hist = self._union(one.low, one.high)
                if one.hist is not None and other.hist is None:
                    other.hist = node.hist - one.hist

    # -- rounds
    def advance(self):
        """Grow until histograms are needed (returned as a request) or training is over (None)."""
        while not self.done:
            if self.nodes is None:
                lacking = [n for n in self.prev if n.hist is None]
                if lacking:
                    return self._request(self.prev_tree, False, {n.number: n for n in lacking})
                self._start_round()
            request = self._grow()
            if request is not None:
                return request
            self._end_round()
        return None

    def _start_round(self) -> None:
        hist = sum((n.hist for n in self.prev), np.zeros((4, self.width), np.int64))
        self.prev_low, self.prev_high = np.array([n.low for n in self.prev]), np.array([n.high for n in self.prev])
        p = len(self.offsets) - 1
        totals = hist[:, self.offsets[0]:self.offsets[1]].sum(axis=1)
        root = _Node(np.zeros(p, np.int64), np.diff(self.offsets).astype(np.int64), 0, totals, hist)
        self.nodes, self.leaves = [root], [root]
        root.place, self.grown, self.above = 0, [(0, 255, 0, 0)], [0]

    def _grow(self):
        while len(self.leaves) < self.s.leaves:
            open_leaves = [n for n in self.leaves if self._open(n)]
            wanted = []
            for n in open_leaves:
                if n.hist is None:
                    wanted.append(n)
                elif n.best is None:
                    self._split(n)
                    self._prepare(n)
            if wanted:
                return self._request_level(open_leaves)
            best = max(open_leaves, key=lambda n: n.best[0], default=None)
            if best is None or best.best[0] <= 0:
                return None
            if best.ready is None:
                self._prepare(best)
            best.children = best.ready
            self.leaves[self.leaves.index(best):self.leaves.index(best) + 1] = best.children
            self.nodes += best.children
        return None

    def _request_level(self, open_leaves: list[_Node]):
        """All open leaves without a histogram, and the smaller child of every split that may come next."""
        wanted, extra = [], []
        for parent in self.nodes:
            if parent.children:
                lack = [c for c in parent.children if c.hist is None]
                if len(lack) == 2:
                    wanted.append((min(lack, key=lambda c: c.totals[0]), parent))
                elif lack:
                    lack[0].hist = parent.hist - next(c for c in parent.children if c is not lack[0]).hist
        for n in open_leaves:
            if n.ready is not None and n.ready[0].hist is None:
                extra.append((min(n.ready, key=lambda c: c.totals[0]), n))
        pairs = wanted + extra
        tree = _tree(*[list(c) for c in zip(*self.grown, strict=True)], [0] * len(self.grown))
        return self._request(tree, True, {child.place: child for child, _ in pairs}, pairs)

    def _as_tree(self) -> tuple[Tree, dict]:
        """The grown tree, and each node's number."""
        order, number, rows = [self.nodes[0]], {}, []
        for n in order:
            number[id(n)] = len(number)
            order += n.children or []
        for n in order:
            kids = n.children
            me = number[id(n)]
            rows.append((n.best[1], n.best[2], number[id(kids[0])], number[id(kids[1])], 0) if kids else (0, 255, me, me, 0))
        return _tree(*[list(c) for c in zip(*rows, strict=True)]), number

    def _request(self, tree: Tree, grows: bool, nodes: dict, pairs=()):
        slot_of = np.full(len(tree.cut), -1, np.int64)
        self.pending = (list(nodes.values()), pairs)
        for slot, number in enumerate(nodes):
            slot_of[number] = slot
        return len(self.trees), tree, grows, slot_of, len(nodes)

    def take(self, sums: np.ndarray | None) -> None:
        nodes, pairs = self.pending
        for slot, node in enumerate(nodes):
            node.hist = sums[slot] if sums is not None else np.zeros((4, self.width), np.int64)
            if node.totals is None:
                node.totals = node.hist[:, self.offsets[0]:self.offsets[1]].sum(axis=1)
        for child, parent in pairs:
            for other in parent.children or parent.ready:
                if other is not child:
                    other.hist = parent.hist - child.hist

    def _end_round(self) -> None:
        s = self.s
        tree, number = self._as_tree()
        at = {n.place: number[id(n)] for n in self.nodes}
        for place, up in enumerate(self.above):
            at.setdefault(place, at[up])  # a place below a leaf; the places above it come first
        self.starts.append(np.array([at[place] for place in range(len(self.above))], np.int64))
        for n in self.leaves:
            rows, grad = int(n.totals[0]), int(n.totals[1])
            n.number = number[id(n)]
            step = int(np.rint(-s.learning_rate * grad / (rows + s.l2))) if rows else 0
            tree.step[n.number] = step
            self.held_square += 2 * step * int(n.totals[3]) + step * step * int(n.totals[2])
            for stats in (n.totals, n.hist):
                if stats is not None:
                    stats[1] += step * stats[0]
                    stats[3] += step * stats[2]
            n.best = n.ready = n.children = None
        # Shared arrays would be moved twice: every leaf owns its histogram (unions and differences are copies).
        self.trees.append(tree)
        self.prev, self.prev_tree, self.nodes = self.leaves, tree, None
        if self.held_rows:
            self.held_loss.append(0.5 * self.held_square / self.held_rows / self.scale ** 2)
        self.done = len(self.trees) >= s.rounds or len(tree.cut) == 1 or self._stalled()

    def _stalled(self) -> bool:
        if not self.held_rows or len(self.held_loss) <= self.s.patience:
            return False
        before = self.held_loss[-self.s.patience - 1] - self.s.tolerance
        return not any(x < before for x in self.held_loss[-self.s.patience:])


# ---------------------------------------------------------------- Spark
@dataclass
class BoostingUnit:
    """One model to train: rows with inputs, label and key columns (which decide the early-stopping rows)."""

    name: str
    data: DataFrame
    inputs: Sequence[str]
    label: str
    key_cols: Sequence[str]
    settings: BoostingSettings


def _thresholds(rows: np.ndarray, bins: int) -> list[np.ndarray]:
    """Midpoints between distinct values, or between ``bins`` quantiles of them if there are more."""
    out = []
    for column in rows.T:
        values = np.sort(column[~np.isnan(column)])
        distinct = np.unique(values)
        if len(distinct) <= bins:
            out.append((distinct[:-1] + distinct[1:]) / 2)
        else:
            out.append(np.unique(np.percentile(values, np.linspace(0, 100, bins + 1)[1:-1], method="midpoint")))
    return out


def _blocks(unit: int, thresholds: list[np.ndarray], base: float, scale: float, p: int):
    def packed(parts: list[tuple]) -> pa.RecordBatch:
        bins, label, held = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([unit], pa.int32()), pa.array([len(label)], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (bins, label, held)]],
                                          ["unit", "n", "bins", "label", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[:p]]) if batch.num_rows else np.empty((0, p))
            label = np.rint((batch.column(p).to_numpy(zero_copy_only=False) - base) * scale).astype(np.int64)
            held = batch.column(p + 1).to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            while at < len(label):
                part = slice(at, at + BLOCK_ROWS - n)
                parts.append((bin_values(values[part], thresholds), label[part], held[part]))
                at, n = part.stop, n + len(label[part])
                if n == BLOCK_ROWS:
                    yield packed(parts)
                    parts, n = [], 0
        if parts:
            yield packed(parts)
    return run


def _prepared(number: int, unit: BoostingUnit, seed: int) -> tuple[DataFrame, BoostedModel, int, int, int] | tuple[None, BoostedModel, int, int, int]:
    """Binned blocks of one unit, its empty model, and the early-stopping rows' count and squared error."""
    s, p = unit.settings, len(unit.inputs)
    rows = unit.data.where(qcol(unit.label).isNotNull())
    rows = rows.select(*[qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(unit.inputs)], qcol(unit.label).cast("double").alias("y"),
                       hash_bucket(unit.key_cols, seed + 2).alias("part"), F.xxhash64(*[qcol(k) for k in unit.key_cols]).alias("h"))
    rows = stored(rows, "boosting-rows")
    n, low, high = rows.agg(F.count("*"), F.min("y"), F.max("y")).first()
    if not n:
        return None, BoostedModel(list(unit.inputs), [np.empty(0)] * p, 0.0, 1.0), 0, 0, 0
    held = (F.col("part") < int(s.held_share * 10_000)) if n > s.stop_above else F.lit(False)
    sample = rows if n <= SAMPLE_ROWS else rows.where(F.col("h") < F.lit(int(-(2.0 ** 63) + 2.0 ** 64 * min(1.0, 1.2 * SAMPLE_ROWS / n)) - 1))
    sample = sample.orderBy("h", *[f"x{i}" for i in range(p)]).limit(SAMPLE_ROWS).select(*[f"x{i}" for i in range(p)])
    thresholds = _thresholds(sample.toPandas().to_numpy(float), s.bins)
    base = float(rows.where(~held).agg(F.avg(F.col("y").cast("decimal(38, 10)")).cast("double")).first()[0] or 0.0)
    spread = max(high - base, base - low)
    scale = 2.0 ** (LABEL_BITS - 1 - int(np.ceil(np.log2(spread)))) if spread > 0 else 1.0
    # Rows are dealt by key, so that one source file still fills the cores and small tables do not make many small tasks.
    parts = min(-(-n // TASK_ROWS), max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (64 * TASK_ROWS))))
    blocks = rows.repartition(parts, "h").select(*[f"x{i}" for i in range(p)], "y", held.alias("held")).mapInArrow(
        _blocks(number, thresholds, base, scale, p), "unit int, n int, bins binary, label binary, held binary")
    return blocks, BoostedModel(list(unit.inputs), thresholds, base, scale), n, 0, 0


def _arrays(row) -> tuple:
    return (row.unit, row.block, np.frombuffer(row.bins, np.uint8).reshape(row.n, -1), np.frombuffer(row.label, np.int64), np.frombuffer(row.held, bool))


def fit_boosting(units: Sequence[BoostingUnit], seed: int = 42) -> tuple[list[BoostedModel], int]:
    """Train all units in lockstep; the models in order, and the number of histogram jobs."""
    spark = units[0].data.sparkSession
    made = [_prepared(k, u, seed) for k, u in enumerate(units)]
    frames = [m[0] for m in made if m[0] is not None]
    models = [m[1] for m in made]
    if not frames:
        return models, 0
    whole = frames[0]
    for other in frames[1:]:
        whole = whole.unionByName(other)
    blocks = stored(whole.withColumn("block", F.monotonically_increasing_id()), "boosting-blocks")
    table: RDD = blocks.rdd.map(_arrays).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return models, _train(spark, table, units, models)
    finally:
        table.unpersist()


def _held(blocks: Iterator) -> Iterator[tuple]:
    for unit, _, _, label, held in blocks:
        yield unit, int(held.sum()), sum(int(x) * int(x) for x in label[held].tolist())


def _train(spark, table: RDD, units: Sequence[BoostingUnit], models: Sequence[BoostedModel]) -> int:
    run, sc = uuid.uuid4().hex, spark.sparkContext
    start: dict[int, list[int]] = {}
    for unit, n, square in table.mapPartitions(_held).collect():
        was = start.setdefault(unit, [0, 0])
        was[0] += n
        was[1] += square
    offsets, growers = {}, {}
    for k in start:
        sizes = [len(cuts) + 2 for cuts in models[k].thresholds]  # a bin above each threshold, one below, one for missing values
        offsets[k] = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        growers[k] = _Grower(units[k].settings, offsets[k], models[k].scale, *start[k])
    older, first, jobs = None, {"at": 0}, 0
    while True:
        asked = {k: r for k, g in growers.items() if (r := g.advance()) is not None}
        if not asked:
            break
        most = min(len(growers[k].trees) for k in asked)
        if older is None or max(len(growers[k].trees) for k in asked) - first["at"] > RECENT:
            first["at"] = most
            older = sc.broadcast({k: [t.plain() for t in g.trees[:most]] for k, g in growers.items()})
        recent = {k: list(zip(growers[k].trees, growers[k].starts, strict=True))[first["at"]:] for k in asked}
        sums = table.mapPartitions(_histograms(run, asked, offsets, older, recent, first["at"]))
        total = sums.treeReduce(_added) if table.getNumPartitions() > 4 * sc.defaultParallelism else _summed(sums.collect())
        jobs += 1
        for k in asked:
            growers[k].take(total.get(k))
    for k, g in growers.items():
        models[k].trees, models[k].held_loss = g.trees, g.held_loss
    table.foreachPartition(_forget(run))
    return jobs


def _summed(parts: list[dict]) -> dict:
    out: dict = {}
    for part in parts:
        out = _added(out, part)
    return out


def input_array(inputs: Sequence[str]) -> Column:
    """A model's inputs as one array column: one expression, so the optimizer does not weigh every input against its copies."""
    return F.array(*[qcol(c).cast("double") for c in inputs])


def input_matrix(column: pa.Array, p: int) -> np.ndarray:
    """Rows of an array column as a matrix, NULL as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, p)


def predict_boosted(df: DataFrame, models: Mapping[str, BoostedModel], inputs: Sequence[str], by: str | None = None, out_col: str = "prediction") -> DataFrame:
    """``df`` with the prediction of the model that ``by`` names (or the only one)."""
    shared = df.sparkSession.sparkContext.broadcast({name: (m.inputs, m.thresholds, m.base, m.scale, [t.plain() for t in m.trees]) for name, m in models.items()})
    # The row travels as one struct, whatever its columns are called.
    rows = df.select(F.struct("*").alias("row"), (qcol(by).cast("string") if by else F.lit("")).alias("name"), input_array(inputs).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {name: BoostedModel(*plain[:4], [Tree(*t) for t in plain[4]]) for name, plain in shared.value.items()}
        for batch in batches:
            x = input_matrix(batch.column(2), len(inputs))
            names, out = np.array(batch.column(1).to_pylist(), object), np.full(batch.num_rows, np.nan)
            for name, model in held.items():
                mine = np.flatnonzero(names == name) if by else np.arange(batch.num_rows)
                if len(mine):
                    out[mine] = model.predict(x[mine])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64(), mask=np.isnan(out))], ["row", "p"])

    found = rows.mapInArrow(run, StructType([rows.schema["row"], StructField("p", DoubleType())]))
    return found.select("row.*", F.col("p").alias(out_col))
