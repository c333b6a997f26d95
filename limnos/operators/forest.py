"""Random forests over shared histograms (M7).

Rows are binned once (``operators.boosting``) and weighted per tree by a Poisson number
from a hash of their key, so the same rows give the same forest under any partitioning.
All trees grow together: one pass over the blocks adds up, for every open node of every
tree, the histograms of the node's next candidate inputs (a hash of the node orders the
inputs), and a grouped reduction picks the splits; only the splits reach the driver.
A node of at most ``small_rows`` rows leaves this phase: its rows are dealt to one group,
where its whole subtree grows level by level in numpy by the same rules.  No group is
larger than that, whatever the table's size.

The model is two tables: the upper nodes, and one row a subtree.  Scoring broadcasts
subtrees in chunks of bounded size, one pass each, and adds up whole numbers.

Defined results: as for boosting; a forest of no rows predicts 0.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators.boosting import SAMPLE_ROWS, TASK_ROWS, _thresholds, bin_values, input_array, input_matrix
from limnos.session import qcol, scratch_path, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LABEL_BITS = 31
#: Numbers of histograms that a task holds before it hands them on.
HELD_NUMBERS = 32_000_000
#: Bytes of subtrees that one scoring pass broadcasts.
CHUNK_BYTES = 64 << 20
#: Cumulative probabilities of a Poisson number with mean one.
POISSON = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(12)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ForestSettings:
    """Defaults are the reference's."""

    trees: int = 500
    least_split: int = 4
    least_leaf: int = 2
    bins: int = 255
    seed: int = 42
    small_rows: int = 16_384


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of whole numbers (splitmix64's finisher)."""
    x = np.asarray(x, np.uint64) + _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tree_seed(seed: int, tree: int) -> np.uint64:
    return mix(np.array([(seed << 32) + tree], np.uint64))[0]


def weights(keys: np.ndarray, seed: np.uint64) -> np.ndarray:
    """How often a tree takes each row: Poisson numbers from the rows' keys."""
    u = (mix(keys.view(np.uint64) ^ seed) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.searchsorted(POISSON, u, "right").astype(np.int64)


def child_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(names * np.uint64(2)), mix(names * np.uint64(2) + np.uint64(1))


def input_order(names: np.ndarray, p: int) -> np.ndarray:
    """For each node the inputs in the order in which they are tried."""
    return np.argsort(mix(names[:, None] ^ mix(np.arange(1, p + 1, dtype=np.uint64))[None, :]), axis=1, kind="stable")


# ---------------------------------------------------------------- splits
def _gain(ls, lw, s, w):
    with np.errstate(divide="ignore", invalid="ignore"):
        return ls.astype(float) ** 2 / lw + (s - ls).astype(float) ** 2 / (w - lw) - s.astype(float) ** 2 / w


def grow(bins: np.ndarray, label: np.ndarray, weight: np.ndarray, name: np.uint64, s: ForestSettings):
    """A whole subtree, level by level: (feature, cut, left, value); right is left + 1, a leaf has left -1."""
    p, most = bins.shape[1], max(1, int(np.sqrt(bins.shape[1])))
    feature, cut, left, value = [[-1]], [[255]], [[-1]], [[0]]
    rows, node, names, made = np.arange(len(label)), np.zeros(len(label), np.int64), np.array([name], np.uint64), 1
    wy = weight * label
    while len(rows):
        k = len(names)
        n, w, y = np.bincount(node, minlength=k), np.zeros(k, np.int64), np.zeros(k, np.int64)
        np.add.at(w, node, weight[rows])
        np.add.at(y, node, wy[rows])
        value[-1] = np.rint(y / np.maximum(w, 1)).astype(np.int64).tolist()
        best, best_f, best_b, found = np.zeros(k), np.full(k, -1), np.full(k, -1), np.zeros(k, bool)
        low, high = np.full(k, np.iinfo(np.int64).max), np.full(k, np.iinfo(np.int64).min)
        np.minimum.at(low, node, label[rows])
        np.maximum.at(high, node, label[rows])
        able = (n >= s.least_split) & (low < high)
        order = input_order(names, p)
        for j in range(p):
            trying = able if j < most else able & ~found
            if not trying.any():
                break
            mine = np.flatnonzero(trying[node])
            at = rows[mine]
            key = node[mine] * 256 + bins[at, order[node[mine], j]]
            sort = np.argsort(key, kind="stable")
            key, at = key[sort], at[sort]
            cw, cy = np.cumsum(weight[at]), np.cumsum(wy[at])
            owner = key >> 8
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            start = first[np.searchsorted(first, np.arange(len(key)), "right") - 1]
            ends = np.flatnonzero(np.r_[key[1:] != key[:-1], False] & np.r_[owner[1:] == owner[:-1], False])
            if not len(ends):
                continue
            o, st = owner[ends], start[ends]
            lw = cw[ends] - np.where(st > 0, cw[st - 1], 0)
            ly = cy[ends] - np.where(st > 0, cy[st - 1], 0)
            ln = ends - st + 1
            fits = (ln >= s.least_leaf) & (n[o] - ln >= s.least_leaf)
            o, lw, ly, ends = o[fits], lw[fits], ly[fits], ends[fits]
            if not len(o):
                continue
            found[o] = True
            gain = _gain(ly, lw, y[o], w[o])
            heads = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            top = np.maximum.reduceat(gain, heads)
            sizes = np.diff(np.r_[heads, len(o)])
            hit = np.flatnonzero(gain == np.repeat(top, sizes))
            hit = hit[np.r_[True, o[hit][1:] != o[hit][:-1]]]  # the least bin of equals
            owners = o[hit]
            better = gain[hit] > best[owners]
            owners, hit = owners[better], hit[better]
            best[owners], best_f[owners], best_b[owners] = gain[hit], order[owners, j], key[ends[hit]] & 255
        split = best_f >= 0
        ids = made + 2 * (np.cumsum(split) - 1)
        feature[-1], cut[-1] = best_f.tolist(), np.where(split, best_b, 255).tolist()
        left[-1] = np.where(split, ids, -1).tolist()
        if not split.any():
            break
        keep = split[node]
        rows, node = rows[keep], node[keep]
        right = bins[rows, best_f[node]] > best_b[node]
        rank = np.cumsum(split) - 1
        node = 2 * rank[node] + right
        a, b = child_names(names[split])
        names = np.column_stack([a, b]).ravel()
        made += 2 * int(split.sum())
        for part, fill in ((feature, -1), (cut, 255), (left, -1), (value, 0)):
            part.append([fill] * len(names))
    flat = lambda parts, kind: np.array([x for part in parts for x in part], kind)
    return flat(feature, np.int16), flat(cut, np.uint8), flat(left, np.int32), flat(value, np.int64)


def route(bins: np.ndarray, feature, cut, left) -> np.ndarray:
    """Last node of each row in one tree."""
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    while len(rows):
        at = node[rows]
        inner = left[at] >= 0
        rows, at = rows[inner], at[inner]
        if len(rows):
            node[rows] = left[at] + (bins[rows, feature[at]] > cut[at])
    return node


# ---------------------------------------------------------------- upper levels
class _Upper:
    """Upper part of one tree: nodes in arrays; ``open`` holds the numbers of nodes that are still to be split, with their next input."""

    def __init__(self, name: np.uint64):
        self.feature, self.cut, self.left, self.names, self.open = [-1], [255], [-1], [name], {0: 0}

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        a, b = child_names(np.array([self.names[node]], np.uint64))
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.names)
        for name in (a[0], b[0]):
            self.feature.append(-1)
            self.cut.append(255)
            self.left.append(-1)
            self.names.append(name)
        return len(self.names) - 2, len(self.names) - 1

    def plain(self) -> tuple:
        return np.array(self.feature, np.int64), np.array(self.cut, np.int64), np.array(self.left, np.int64)


def _decode(batch: pa.RecordBatch, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys = batch.column(0).to_numpy(zero_copy_only=False)
    bins = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, p)
    return keys, bins, batch.column(2).to_numpy(zero_copy_only=False)


def _level_sums(shared, p: int, most: int):
    """Per batch and tree: packed (rows, weight, weighted label) per open node, candidate input and bin."""
    def packed(tree: int, sums: np.ndarray) -> pa.RecordBatch:
        nodes = shared.value[tree][2]
        return pa.RecordBatch.from_arrays([pa.array([tree] * len(nodes), pa.int32()), pa.array(nodes, pa.int64()),
                                           pa.array([sums[:, k].tobytes() for k in range(len(nodes))], pa.binary())], ["tree", "node", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            keys, bins, label = _decode(batch, p)
            for tree, (seed, parts, open_nodes, orders) in shared.value.items():
                if sum(x.size for x in held.values()) > HELD_NUMBERS:
                    yield from (packed(*x) for x in held.items())
                    held.clear()
                w = weights(keys, seed)
                mine = np.flatnonzero(w > 0)
                slot_of = np.full(len(parts[0]), -1, np.int64)
                slot_of[open_nodes] = np.arange(len(open_nodes))
                slot = slot_of[route(bins[mine], *parts)]
                mine, slot = mine[slot >= 0], slot[slot >= 0]
                sums = held.setdefault(tree, np.zeros((3, len(open_nodes), most, 256), np.int64))
                for j in range(most):
                    inputs = orders[slot, j]
                    rows, at = mine[inputs >= 0], slot[inputs >= 0]
                    cell = at * 256 + bins[rows, inputs[inputs >= 0]]
                    size = len(open_nodes) * 256
                    sums[0, :, j] += np.bincount(cell, minlength=size).reshape(-1, 256)
                    sums[1, :, j] += np.rint(np.bincount(cell, w[rows].astype(float), size)).astype(np.int64).reshape(-1, 256)
                    sums[2, :, j] += np.rint(np.bincount(cell, (w[rows] * label[rows]).astype(float), size)).astype(np.int64).reshape(-1, 256)
        yield from (packed(*x) for x in held.items())
    return run


def _best_split(s: ForestSettings, most: int):
    def run(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x, np.int64).reshape(3, most, 256) for x in table.column("sums").to_pylist())
        n, w, y = sums[:, 0].sum(axis=1)
        best = (0.0, -1, -1, 0, False)
        for j in range(most):
            ln, lw, ly = np.cumsum(sums[:, j], axis=1)
            fits = (ln >= s.least_leaf) & (n - ln >= s.least_leaf) & (sums[0, j] > 0)
            if fits.any():
                gain = np.where(fits, _gain(ly, lw, y, w), -np.inf)
                at = int(np.argmax(gain))
                best = (float(gain[at]), j, at, int(ln[at]), True) if gain[at] > best[0] else (*best[:4], True)
        return pa.table({"tree": table.column("tree").slice(0, 1), "node": table.column("node").slice(0, 1), "n": [int(n)], "input": [best[1]],
                         "cut": [best[2]], "n_left": [best[3]], "valid": [best[4]]},
                        schema=pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("n", pa.int64()), ("input", pa.int64()), ("cut", pa.int64()), ("n_left", pa.int64()), ("valid", pa.bool_())]))
    return run


def _grow_upper(blocks: DataFrame, p: int, s: ForestSettings) -> list[_Upper]:
    """Split all nodes of more than ``small_rows`` rows, a level of all trees a pass."""
    most = max(1, int(np.sqrt(p)))
    trees = [_Upper(tree_seed(s.seed, t)) for t in range(s.trees)]
    sc = blocks.sparkSession.sparkContext
    while any(t.open for t in trees):
        asked = {}
        for number, t in enumerate(trees):
            if t.open:
                nodes = sorted(t.open)
                order = input_order(np.array([t.names[k] for k in nodes], np.uint64), p)
                cols = np.array([t.open[k] for k in nodes])[:, None] + np.arange(most)[None, :]
                orders = np.where(cols < p, np.take_along_axis(order, np.minimum(cols, p - 1), axis=1), -1)
                asked[number] = (tree_seed(s.seed, number), t.plain(), np.array(nodes), orders)
        shared = sc.broadcast(asked)
        sums = blocks.select("key", "bins", "label").mapInArrow(_level_sums(shared, p, most), "tree int, node long, sums binary")
        splits = sums.groupBy("tree", "node").applyInArrow(_best_split(s, most), "tree int, node long, n long, input long, cut long, n_left long, valid boolean").collect()
        shared.unpersist()
        got = {(r.tree, r.node): r for r in splits}
        for number, (_, _, nodes, orders) in asked.items():
            t = trees[number]
            for k, node in enumerate(nodes.tolist()):
                r, tried = got.get((number, node)), t.open.pop(node)
                if r is None or r.n <= s.small_rows:
                    continue  # its subtree grows in one group
                if not r.valid and tried + most < p:
                    t.open[node] = tried + most  # none of these inputs parts the rows: the next ones
                elif r.input >= 0:
                    a, b = t.split(node, int(orders[k, r.input]), r.cut)
                    t.open.update({child: 0 for child, n in ((a, r.n_left), (b, r.n - r.n_left)) if n > s.small_rows})
    return trees


# ---------------------------------------------------------------- subtrees
def _deal(shared, p: int):
    """Rows of every tree's last upper nodes, packed per batch: tree, node, bins, label, weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bins, label = _decode(batch, p)
            for tree, (seed, parts, names) in shared.value.items():
                w = weights(keys, seed)
                mine = np.flatnonzero(w > 0)
                node = route(bins[mine], *parts)
                sort = np.argsort(node, kind="stable")
                mine, node = mine[sort], node[sort]
                heads = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
                groups = np.split(mine, heads[1:]) if len(node) else []
                kept = [int(node[h]) for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(groups), pa.int32()), pa.array(kept, pa.int64()), pa.array([int(names[k].view(np.int64)) for k in kept], pa.int64()),
                     pa.array([bins[g].tobytes() for g in groups], pa.binary()), pa.array([label[g].tobytes() for g in groups], pa.binary()),
                     pa.array([w[g].tobytes() for g in groups], pa.binary())], ["tree", "node", "name", "bins", "label", "weight"])
    return run


PIECE = "tree int, node long, feature binary, cut binary, left binary, value binary, bytes long"
#: Trees whose subtrees share a folder of the table.
PART_TREES = 8


def _write_pieces(pieces: DataFrame, path: str) -> None:
    parted = pieces.withColumn("part", (F.col("tree") / PART_TREES).cast("int")).repartition("part")
    parted.write.mode("overwrite").partitionBy("part").parquet(path)


def _read_pieces(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PIECE}, part int").parquet(path)


def _grow_piece(s: ForestSettings, p: int):
    def run(table: pa.Table) -> pa.Table:
        packed = {c: b"".join(table.column(c).to_pylist()) for c in ("bins", "label", "weight")}
        name = np.array([table.column("name")[0].as_py()], np.int64).view(np.uint64)[0]
        made = grow(np.frombuffer(packed["bins"], np.uint8).reshape(-1, p), np.frombuffer(packed["label"], np.int64), np.frombuffer(packed["weight"], np.int64), name, s)
        return pa.table([table.column("tree").slice(0, 1), table.column("node").slice(0, 1), *[pa.array([x.tobytes()], pa.binary()) for x in made],
                         pa.array([sum(x.nbytes for x in made)], pa.int64())], names=["tree", "node", "feature", "cut", "left", "value", "bytes"])
    return run


@dataclass
class ForestModel:
    """Thresholds, label scale, upper nodes per tree, and the table of subtrees (``pieces``)."""

    inputs: list[str]
    thresholds: list[np.ndarray]
    base: float
    scale: float
    trees: int
    uppers: list[tuple]
    pieces: DataFrame | None

    def save(self, path: str, spark: SparkSession) -> None:
        """Tables ``pieces``, ``upper`` and ``meta`` under ``path``."""
        rows = [(t, k, int(f), int(c), int(a)) for t, part in enumerate(self.uppers) for k, (f, c, a) in enumerate(zip(*part, strict=True))]
        spark.createDataFrame(rows, "tree int, node int, feature int, cut int, left int").write.mode("overwrite").parquet(f"{path}/upper")
        if self.pieces is not None:
            _write_pieces(self.pieces.drop("part"), f"{path}/pieces")
        meta = json.dumps({"inputs": self.inputs, "thresholds": [x.tolist() for x in self.thresholds], "base": self.base, "scale": self.scale, "trees": self.trees})
        spark.createDataFrame([(meta,)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> ForestModel:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
        parts: dict = {}
        for r in spark.read.parquet(f"{path}/upper").orderBy("tree", "node").collect():
            parts.setdefault(r.tree, []).append((r.feature, r.cut, r.left))
        uppers = [tuple(np.array(c, np.int64) for c in zip(*parts[t], strict=True)) for t in sorted(parts)]
        return cls(meta["inputs"], [np.array(x) for x in meta["thresholds"]], meta["base"], meta["scale"], meta["trees"], uppers, _read_pieces(spark, f"{path}/pieces") if uppers else None)


def _encode(thresholds, base: float, scale: float, p: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[2:]]) if batch.num_rows else np.empty((0, p))
            label = np.rint((batch.column(1).to_numpy(zero_copy_only=False) - base) * scale).astype(np.int64)
            bins = bin_values(values, thresholds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.tobytes() for b in bins], pa.binary()), pa.array(label)], ["key", "bins", "label"])
    return run


def fit_forest(data: DataFrame, inputs: Sequence[str], label: str, key_cols: Sequence[str], s: ForestSettings = ForestSettings()) -> ForestModel:
    """Grow the forest; ``key_cols`` decide how often each tree takes a row."""
    p = len(inputs)
    rows = data.where(qcol(label).isNotNull()).select(F.xxhash64(*[qcol(k) for k in key_cols]).alias("key"), qcol(label).cast("double").alias("y"),
                                                      *[qcol(c).cast("double").alias(f"x{i}") for i, c in enumerate(inputs)])
    rows = stored(rows, "forest-rows")
    n, low, high, mean = rows.agg(F.count("*"), F.min("y"), F.max("y"), F.avg(F.col("y").cast("decimal(38, 10)")).cast("double")).first()
    if not n:
        return ForestModel(list(inputs), [np.empty(0)] * p, 0.0, 1.0, s.trees, [], None)
    near = rows if n <= SAMPLE_ROWS else rows.where(F.col("key") < F.lit(int(-(2.0 ** 63) + 2.0 ** 64 * min(1.0, 1.2 * SAMPLE_ROWS / n)) - 1))
    xs = [f"x{i}" for i in range(p)]
    thresholds = _thresholds(near.orderBy("key", *xs).limit(SAMPLE_ROWS).select(*xs).toPandas().to_numpy(float), s.bins)
    spread = max(high - mean, mean - low)
    scale = 2.0 ** (LABEL_BITS - 1 - int(np.ceil(np.log2(spread)))) if spread > 0 else 1.0
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // (64 * TASK_ROWS)))
    blocks = stored(rows.repartition(parts, "key").mapInArrow(_encode(thresholds, mean, scale, p), "key long, bins binary, label long"), "forest-blocks")
    uppers = _grow_upper(blocks, p, s) if n > s.small_rows else [_Upper(tree_seed(s.seed, t)) for t in range(s.trees)]
    shared = rows.sparkSession.sparkContext.broadcast({t: (tree_seed(s.seed, t), u.plain(), np.array(u.names, np.uint64)) for t, u in enumerate(uppers)})
    dealt = blocks.mapInArrow(_deal(shared, p), "tree int, node long, name long, bins binary, label binary, weight binary")
    path = scratch_path(rows.sparkSession, "forest-pieces")
    _write_pieces(dealt.groupBy("tree", "node").applyInArrow(_grow_piece(s, p), PIECE), path)
    return ForestModel(list(inputs), thresholds, mean, scale, s.trees, [u.plain() for u in uppers], _read_pieces(rows.sparkSession, path))


def _chunks(model: ForestModel) -> Iterator[dict]:
    """Subtrees by tree, in chunks of about ``CHUNK_BYTES``: {tree: (upper, {node: arrays})}."""
    sizes = model.pieces.groupBy("part").agg(F.sum("bytes").alias("size")).orderBy("part").collect()
    at, held, bounds = 0, 0, []
    for r in sizes:
        held += r["size"]
        if held > CHUNK_BYTES:
            bounds.append((at, r.part))
            at, held = r.part + 1, 0
    if held:
        bounds.append((at, sizes[-1].part))
    for low, high in bounds:
        chunk: dict = {}
        for r in model.pieces.where(F.col("part").between(low, high)).collect():
            upper, parts = chunk.setdefault(r.tree, (model.uppers[r.tree], {}))
            parts[r.node] = (bytes(r.feature), bytes(r.cut), bytes(r.left), bytes(r.value))
        if chunk:
            yield chunk


def predict_forest(df: DataFrame, model: ForestModel, out_col: str = "prediction") -> DataFrame:
    """``df`` with the mean of the trees' predictions."""
    if model.pieces is None:
        return df.withColumn(out_col, F.lit(0.0))
    rows = stored(df.select(F.struct("*").alias("row"), input_array(model.inputs).alias("x")).withColumn("rid", F.monotonically_increasing_id()), "forest-scoring")
    spread, cores = rows.select("rid", "x"), df.sparkSession.sparkContext.defaultParallelism
    if spread.rdd.getNumPartitions() < cores:  # a small table in one file still fills the cores
        spread = spread.repartition(cores, "rid")
    thresholds, sums = model.thresholds, None
    for chunk in _chunks(model):
        part = stored(spread.mapInArrow(_add_trees(df.sparkSession.sparkContext.broadcast(chunk), thresholds), "rid long, total long"), "forest-sums")
        sums = part if sums is None else sums.unionByName(part)
    total = sums.groupBy("rid").agg(F.sum("total").alias("total"))
    found = rows.select("rid", "row").join(total, "rid", "left")
    return found.select("row.*", (F.lit(model.base) + F.col("total") / F.lit(model.trees * model.scale)).alias(out_col))


def _add_trees(shared, thresholds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (np.int16, np.uint8, np.int32, np.int64)
        for batch in batches:
            bins, total = bin_values(input_matrix(batch.column(1), len(thresholds)), thresholds), np.zeros(batch.num_rows, np.int64)
            for upper, parts in shared.value.values():
                node = route(bins, *upper)
                for at, packed in parts.items():
                    rows = np.flatnonzero(node == at) if len(parts) > 1 or len(upper[0]) > 1 else np.arange(len(bins))
                    if len(rows):
                        feature, cut, left, value = (np.frombuffer(b, k) for b, k in zip(packed, kinds, strict=True))
                        total[rows] += value[route(bins[rows], feature, cut, left)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total)], ["rid", "total"])
    return run
