"""Second-order histogram boosting as Spark jobs: penalties, leaf-wise growth, rounds kept by a validation curve.

Columns are binned once, on edges learnt from a bounded sample, and staged as blocks of one byte per value. A tree
asks for the best splits of a batch of leaves; the answer is one distributed aggregate of gradient, hessian and row
counts per (leaf, column, bin). The loss has whole-number gradients (2^-20), so their sums, and with them splits and
trees, do not depend on how rows are dealt out. A matrix of at most ``ONE_TASK_BYTES`` lies in one partition anyway:
its sums need no exchange and all rounds run inside that task, with the same trees.
"""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.session import stage

#: Rows that bin edges are learnt from at most, those with the smallest hash of their key; all rows are binned and counted.
EDGE_ROWS = 200_000
#: Binned values that one block, and the partition of a fit without exchange, hold at most.
BLOCK_BYTES = 16_000_000
ONE_TASK_BYTES = 64_000_000
#: Joint cells of columns that are counted together at most.
CELLS = 1024
#: Rows of small nodes that are counted in one go, and of one node; the first is the smaller number.
TOGETHER = 16_384
PACKED = 1 << 16
#: Leaves whose children one job looks at, and trees after which margins are written down again.
LEAVES_A_JOB = 32
TREES_A_STAGE = 16
#: Places of a table of contributions at most, and rows that are looked up in one go.
STATES = 2048
LOOKED_UP = 4096
_UNIT = float(1 << 20)
_COUNT = float(1 << 35)
_BINS = 256


@dataclass(frozen=True)
class Settings:
    """How trees grow. ``leaves`` and ``depth`` of 0 are no limit; ``patience`` of 0 keeps all rounds."""

    rounds: int = 400
    rate: float = 0.05
    leaves: int = 63
    depth: int = 0
    least_rows: int = 20
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 1.0
    least_gain: float = 0.0
    row_share: float = 1.0
    column_share: float = 1.0
    patience: int = 0
    seed: int = 42


def shrunk(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0)


def leaf_score(g, h, s: Settings):
    return shrunk(g, s.l1) ** 2 / (h + s.l2)


@dataclass
class Split:
    gain: float
    column: int
    bin: int
    left: tuple[float, float, float]  # gradient, hessian, rows
    right: tuple[float, float, float]


def gains(below: Sequence[np.ndarray], total: Sequence[np.ndarray], s: Settings) -> np.ndarray:
    """Gain of splits whose lower sides have (gradient, hessian, rows) ``below``, in whole units; -inf where none is allowed."""
    (g, h, n), (g2, h2, n2) = below, [t - b for t, b in zip(total, below)]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = leaf_score(g / _UNIT, h / _UNIT, s) + leaf_score(g2 / _UNIT, h2 / _UNIT, s) - leaf_score(total[0] / _UNIT, total[1] / _UNIT, s)
    least = max(s.least_rows, 1)
    allowed = (n >= least) & (n2 >= least) & (h >= s.least_hessian * _UNIT) & (h2 >= s.least_hessian * _UNIT) & (gain > s.least_gain)
    return np.where(allowed, gain, -np.inf)


def best_splits(sums: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Best gain and bin of every (leaf, column) from sums (leaf, column, bin, 3) in whole units; -inf where none is allowed."""
    below = sums[..., :-1, :].cumsum(2)
    total = sums.sum(2)[:, :, None, :]
    gain = gains([below[..., k] for k in range(3)], [total[..., k] for k in range(3)], s)
    at = gain.argmax(2)
    return np.take_along_axis(gain, at[..., None], 2)[..., 0], at


def choose(sums: np.ndarray, start: np.ndarray, columns: np.ndarray, s: Settings) -> list[Split | None]:
    """The best split of every leaf from sums (leaf, 3, bin), where the bins of the k-th column begin at ``start[k]``;
    ties go to the first column and bin."""
    below = sums.cumsum(2)
    total = below[:, :, start[1] - 1 if len(start) > 1 else -1]
    if len(start) > 1:  # sums are whole numbers, so those of the columns before can be taken off again
        below[:, :, start[1]:] -= np.repeat(below[:, :, start[1:] - 1], np.diff(np.r_[start[1:], below.shape[2]]), 2)
    gain = gains(below.transpose(1, 0, 2), total.T[:, :, None], s)
    out: list[Split | None] = []
    for k, at in enumerate(gain.argmax(1)):
        if not np.isfinite(gain[k, at]):
            out.append(None)
            continue
        j = int(np.searchsorted(start, at, "right")) - 1
        out.append(Split(float(gain[k, at]), int(columns[j]), int(at - start[j]), tuple(below[k, :, at]), tuple(total[k] - below[k, :, at])))
    return out


@dataclass
class Growing:
    """A tree under construction; children may exist before their parent is split for good."""

    column: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    sums: list[tuple] = field(default_factory=list)
    best: list[Split | None] = field(default_factory=list)

    def add(self, depth: int, sums: tuple) -> int:
        for x, v in ((self.column, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.depth, depth), (self.sums, sums), (self.best, None)):
            x.append(v)
        return len(self.column) - 1


def grow(root_sums: tuple, root_best: Split | None, ask: Callable[[Growing, list[int], list[int]], list[Split | None]], s: Settings) -> tuple[Growing, set[int]]:
    """Split the leaf with the largest gain until limits are reached. Returns the nodes and those split for good.

    Order is strict, but children are looked at in batches: those of the leaves that would be split next if no child beat them.
    """
    tree, split = Growing(), set()
    tree.add(0, root_sums)
    tree.best[0] = root_best
    leaves = {0}
    limit = s.leaves or math.inf

    def waiting():
        return sorted((k for k in leaves if tree.best[k] is not None), key=lambda k: (-tree.best[k].gain, k))

    while len(leaves) < limit and (order := waiting()):
        node = order[0]
        if tree.left[node] < 0:
            made = []
            for k in [k for k in order if tree.left[k] < 0][:int(min(limit - len(leaves), LEAVES_A_JOB))]:
                b = tree.best[k]
                tree.column[k], tree.bin[k] = b.column, b.bin
                tree.left[k], tree.right[k] = tree.add(tree.depth[k] + 1, b.left), tree.add(tree.depth[k] + 1, b.right)
                made += [tree.left[k], tree.right[k]]
            open_ = [k for k in made if not (s.depth and tree.depth[k] >= s.depth) and tree.sums[k][2] >= 2 * max(s.least_rows, 1)
                     and tree.sums[k][1] >= 2 * s.least_hessian * _UNIT]
            leaves_before = {k: tree.left[k] for k in made}
            for k, b in zip(open_, ask(tree, made, open_)):
                tree.best[k] = b
            assert all(tree.left[k] == v for k, v in leaves_before.items())
        split.add(node)
        leaves.remove(node)
        leaves |= {tree.left[node], tree.right[node]}
    return tree, split


def numbered(tree: Growing, split: set[int]) -> dict[int, int]:
    """New numbers of the nodes reached over splits made for good, from the root, in order."""
    order, new = [0], {0: 0}
    for k in order:
        if k in split:
            for child in (tree.left[k], tree.right[k]):
                new[child] = len(order)
                order.append(child)
    return new


def finished(tree: Growing, split: set[int], edges: Sequence[np.ndarray], s: Settings) -> dict[str, np.ndarray]:
    """Arrays of the nodes reached over splits made for good, numbered from the root."""
    new = numbered(tree, split)
    order = list(new)
    out = {"column": [], "bin": [], "threshold": [], "left": [], "right": [], "value": [], "rows": [], "gain": []}
    for k in order:
        g, h, n = tree.sums[k]
        inner = k in split
        c = tree.column[k] if inner else -1
        edge = edges[c] if inner else ()
        out["column"].append(c)
        out["bin"].append(tree.bin[k] if inner else 0)
        out["threshold"].append(edge[tree.bin[k]] if inner and tree.bin[k] < len(edge) else math.inf)
        out["left"].append(new[tree.left[k]] if inner else new[k])
        out["right"].append(new[tree.right[k]] if inner else new[k])
        out["value"].append(0.0 if inner else float(-s.rate * shrunk(g / _UNIT, s.l1) / (h / _UNIT + s.l2)) if h + s.l2 > 0 else 0.0)
        out["rows"].append(n)
        out["gain"].append(tree.best[k].gain if inner else 0.0)
    kinds = {"column": np.int32, "bin": np.int32, "left": np.int32, "right": np.int32}
    return {k: np.array(v, kinds.get(k, np.float64)) for k, v in out.items()}


def place(tree: Mapping[str, np.ndarray], binned: np.ndarray) -> np.ndarray:
    """Leaf of every binned row."""
    at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
    while (inner := tree["column"][at] >= 0).any():
        k = at[inner]
        at[inner] = np.where(binned[rows[inner], tree["column"][k]] <= tree["bin"][k], tree["left"][k], tree["right"][k])
    return at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def in_bag(hashes: np.ndarray, turn: int, s: Settings) -> np.ndarray:
    """Rows drawn for a round: decided by the row's own hash."""
    if s.row_share >= 1:
        return np.ones(len(hashes), bool)
    start = _mixed(np.array([turn * 1_000_003 + s.seed], np.uint64))
    return (_mixed(hashes ^ start) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 < s.row_share


def columns_of(turn: int, k: int, s: Settings) -> np.ndarray:
    """Columns drawn for a round."""
    if s.column_share >= 1:
        return np.arange(k)
    return np.sort(np.random.default_rng([s.seed, turn]).permutation(k)[:max(1, math.ceil(s.column_share * k - 1e-9))])


def weighed(margin: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """(gradient, hessian, 1) of every row in whole units; zeros for rows that are not used."""
    p = 1 / (1 + np.exp(-margin))
    w = np.stack([np.rint((p - y) * _UNIT), np.rint(p * (1 - p) * _UNIT), np.ones(len(y))], 1)
    return w * used[:, None]


def losses(margin: np.ndarray, y: np.ndarray) -> float:
    """Sum of log losses in whole units."""
    return float(np.rint((np.logaddexp(0, margin) - y * margin) * _UNIT).sum())


def histogram(binned: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums (column, bin, 3) of rows."""
    k = binned.shape[1]
    cell = (binned + np.arange(k) * _BINS).ravel()
    return np.stack([np.bincount(cell, np.repeat(w[:, j], k), k * _BINS).reshape(k, _BINS) for j in range(3)], -1)


@dataclass
class Block:
    """Rows in binned form."""

    binned: np.ndarray
    y: np.ndarray
    held: np.ndarray
    hashes: np.ndarray
    margin: np.ndarray

    SCHEMA = "n long, binned binary, y binary, held binary, hashes binary, margin binary"

    def record(self) -> pa.RecordBatch:
        parts = [self.binned.tobytes(), self.y.tobytes(), self.held.tobytes(), self.hashes.tobytes(), self.margin.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(self.y)], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)],
                                          ["n", "binned", "y", "held", "hashes", "margin"])

    @classmethod
    def read(cls, batch: pa.RecordBatch) -> Iterator[Block]:
        for r in batch.to_pylist():
            n = r["n"]
            yield cls(np.frombuffer(r["binned"], np.uint8).reshape(n, -1), np.frombuffer(r["y"], np.uint8), np.frombuffer(r["held"], bool),
                      np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["margin"], np.float64))


class Curve:
    """Validation loss after each round, and when to stop."""

    def __init__(self, patience: int):
        self.patience, self.losses = patience, []

    def add(self, loss: float | None) -> bool:
        """Whether to go on."""
        if loss is not None:
            self.losses.append(loss)
        return not self.patience or not self.losses or len(self.losses) - 1 - self.kept < self.patience

    @property
    def kept(self) -> int:
        return int(np.argmin(self.losses))


class Bundles:
    """Columns with few bins counted together: a row's cell tells its bins in all columns of a bundle.

    Only cells that some row lies in are numbered, so 0/1 columns of one source need no more cells than it has levels.
    Sums of a column are sums of cells, and whole numbers, so they equal those counted column by column.
    """

    def __init__(self, binned: np.ndarray, edges: Sequence[np.ndarray]):
        self.sizes = [len(e) + 1 for e in edges]
        self.columns: list[list[int]] = []
        self.codes: list[np.ndarray] = []
        self.bins: list[np.ndarray] = []  # of each cell, in each column of the bundle
        most = min(max(len(binned) // 64, _BINS), CELLS)
        for j in sorted(range(len(edges)), key=lambda j: self.sizes[j]):
            mine, size = np.ascontiguousarray(binned[:, j]), self.sizes[j]
            for b, code in enumerate(self.codes):
                if len(self.bins[b]) * size > 1 << 16:
                    continue
                joint = code.astype(np.intp) * size + mine
                seen = np.flatnonzero(np.bincount(joint))
                if len(seen) <= most:
                    number = np.zeros(len(self.bins[b]) * size, np.uint16)
                    number[seen] = np.arange(len(seen))
                    self.columns[b].append(j)
                    self.codes[b], self.bins[b] = number.take(joint), np.column_stack([self.bins[b][seen // size], seen % size])
                    break
            else:
                self.columns.append([j])
                self.codes.append(mine.astype(np.uint16))
                self.bins.append(np.arange(size)[:, None])

    def drawn(self, columns: np.ndarray) -> list[tuple]:
        """For each bundle with drawn columns: codes, cells, where its bins go in sums (drawn column, bin), and which cells make each."""
        where, out = {int(c): k for k, c in enumerate(columns)}, []
        for code, cells, b in zip(self.codes, self.bins, self.columns):
            bins = [(where[j] * _BINS + np.arange(self.sizes[j]), (of[:, None] == np.arange(self.sizes[j])).astype(float))
                    for j, of in zip(b, cells.T) if j in where]
            if bins:
                at = np.concatenate([x for x, _ in bins])
                out.append((code, len(cells), at, np.concatenate([x for _, x in bins], 1) if len(b) > 1 else None))
        return out


def batches(parts: Sequence[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Row lists of consecutive nodes that are counted in one go, as (first, last + 1, rows): small ones together, large ones in pieces."""
    first, held = 0, 0
    for k, r in enumerate(parts):
        if k > first and held + len(r) > TOGETHER:
            yield first, k, parts[first] if k == first + 1 else np.concatenate(parts[first:k])
            first, held = k, 0
        held += len(r)
        if held > PACKED:  # only a node by itself
            for at in range(0, held, PACKED):
                yield k, k + 1, r[at:at + PACKED]
            first, held = k + 1, 0
    if first < len(parts):
        yield first, len(parts), np.concatenate(parts[first:])


def dealt(tree: Mapping[str, np.ndarray], by_column: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, the rows that reach it)."""
    todo = [(0, rows)]
    while todo:
        k, r = todo.pop()
        if tree["column"][k] < 0:
            yield k, r
        elif len(r):
            right = by_column[tree["column"][k]].take(r) > tree["bin"][k]
            todo += [(tree["left"][k], r.compress(~right)), (tree["right"][k], r.compress(right))]


def boost_here(block: Block, edges: Sequence[np.ndarray], base: float, s: Settings) -> tuple[list[dict], list[float]]:
    """All rounds on rows that lie in one place. Larger halves are what their parent has beyond the smaller ones.

    A hessian and the 1 that counts its row are summed as one number: of at most PACKED rows, the sum of hessians stays below _COUNT.
    """
    held = int(block.held.sum())
    free = len(block.held) - held
    order = np.concatenate([np.flatnonzero(~block.held), np.flatnonzero(block.held)])
    by_column, y, hashes = np.ascontiguousarray(block.binned[order].T), block.y[order].astype(float), block.hashes[order[:free]]
    bundles = Bundles(by_column[:, :free].T, edges)
    margin = np.full(len(order), base)
    curve, trees = Curve(s.patience if held else 0), []

    def told() -> float | None:
        return losses(margin[free:], y[free:]) / _UNIT / held if held else None

    go = curve.add(told())
    while go and len(trees) < s.rounds:
        turn = len(trees)
        columns = columns_of(turn, len(edges), s)
        drawn = bundles.drawn(columns)
        used = in_bag(hashes, turn, s)
        rows = {0: np.flatnonzero(used)}
        p = 1 / (1 + np.exp(-margin[:free]))
        g, h = np.rint((p - y[:free]) * _UNIT), np.rint(p * (1 - p) * _UNIT)
        h += _COUNT
        bins = np.concatenate([at for _, _, at, _ in drawn])
        by_bin = np.argsort(bins)
        start = np.searchsorted(bins[by_bin], np.arange(len(columns)) * _BINS)
        cells = np.cumsum([0, *(n for _, n, _, _ in drawn)])

        def counted(nodes: list[int]) -> np.ndarray:
            """Sums (node, 3, bin of the drawn columns) of the rows of some nodes."""
            out = np.zeros((len(nodes), 3, cells[-1]))
            for first, last, r in batches([rows[k] for k in nodes]):
                k = last - first
                gr, hr = g.take(r), h.take(r)
                slot = np.repeat(np.arange(k), [len(rows[n]) for n in nodes[first:last]]) if k > 1 else None
                here = np.empty((k, 2, cells[-1]))
                for (code, n, _, _), at in zip(drawn, cells):
                    c = code.take(r) if k == 1 else slot * n + code.take(r)
                    here[:, 0, at:at + n] = np.bincount(c, gr, k * n).reshape(k, n)
                    here[:, 1, at:at + n] = np.bincount(c, hr, k * n).reshape(k, n)
                many = np.floor(here[:, 1] / _COUNT)
                out[first:last, 0] += here[:, 0]
                out[first:last, 1] += here[:, 1] - many * _COUNT
                out[first:last, 2] += many
            parts = [out[:, :, at:at + n] if made_of is None else out[:, :, at:at + n] @ made_of for (_, n, _, made_of), at in zip(drawn, cells)]
            return np.concatenate(parts, 2)[:, :, by_bin]

        held_sums = {0: counted([0])[0]}

        def ask(tree: Growing, made: list[int], open_: list[int]) -> list[Split | None]:
            made_now, wanted, small = set(made), set(open_), []
            parents = [k for k in range(len(tree.left)) if tree.left[k] in made_now]
            for k in parents:
                r = rows.pop(k)
                right = by_column[tree.column[k]].take(r) > tree.bin[k]
                a, b = tree.left[k], tree.right[k]
                rows[a], rows[b] = r.compress(~right), r.compress(right)
                if a in wanted or b in wanted:
                    small.append((a, b) if tree.sums[a][2] <= tree.sums[b][2] else (b, a))
                else:
                    held_sums.pop(k)
            if not open_:
                return []
            parent = {tree.left[k]: k for k in parents} | {tree.right[k]: k for k in parents}
            for (few, many), x in zip(small, counted([a for a, _ in small])):
                held_sums[few] = x
                held_sums[many] = held_sums.pop(parent[few]) - x
            return choose(np.stack([held_sums[k] for k in open_]), start, columns, s)

        tree, split = grow(tuple(held_sums[0][:, :start[1] if len(start) > 1 else None].sum(1)), choose(held_sums[0][None], start, columns, s)[0], ask, s)
        flat = finished(tree, split, edges, s)
        trees.append(flat)
        for k, new in numbered(tree, split).items():
            if k not in split:
                for r in (rows[k],) if k in rows else (rows[tree.left[k]], rows[tree.right[k]]):  # looked at, but not split for good
                    margin[r] += flat["value"][new]
        for k, r in dealt(flat, by_column, np.concatenate([np.flatnonzero(~used), np.arange(free, len(order))])):
            margin[r] += flat["value"][k]
        go = curve.add(told())
    if curve.patience and curve.losses:
        trees = trees[:curve.kept]
    return trees, curve.losses


def _traversal(tree: Growing) -> dict[str, np.ndarray]:
    return {"column": np.array(tree.column, np.int32), "bin": np.array(tree.bin, np.int32), "left": np.array(tree.left, np.int32), "right": np.array(tree.right, np.int32)}


class Across:
    """Rounds over blocks in many partitions: one aggregate for each batch of leaves."""

    def __init__(self, blocks: DataFrame, edges: Sequence[np.ndarray], base: float, s: Settings):
        self.blocks, self.edges, self.base, self.s = blocks, edges, base, s
        self.trees: list[dict] = []
        self.written = 0  # trees whose margins are in the blocks

    def _fresh(self) -> list[dict]:
        return self.trees[self.written:]

    def write_down(self) -> None:
        fresh = self._fresh()

        def add(batches):
            for batch in batches:
                for b in Block.read(batch):
                    yield replace_margin(b, fresh).record()

        self.blocks = stage(self.blocks.mapInArrow(add, Block.SCHEMA), "boosting-margins")
        self.written = len(self.trees)

    def sums(self, tree: Growing | None, asked: list[int], turn: int) -> tuple[dict[int, np.ndarray], list[Split | None], float, int]:
        """(totals, best splits) of the leaves asked for, and loss and count of held rows."""
        s, fresh, nodes = self.s, self._fresh(), _traversal(tree) if tree else None
        columns = columns_of(turn, len(self.edges), s)
        slot = {k: j for j, k in enumerate(asked)}

        def count(batches):
            total, loss, held = {}, 0.0, 0
            for batch in batches:
                for raw in Block.read(batch):
                    b = replace_margin(raw, fresh)
                    if tree is None:
                        loss += losses(b.margin[b.held], b.y[b.held])
                        held += int(b.held.sum())
                    w = weighed(b.margin, b.y, ~b.held & in_bag(b.hashes, turn, s))
                    at = place(nodes, b.binned) if nodes else np.zeros(len(b.y), np.int64)
                    for k in asked:
                        rows = np.flatnonzero(at == k) if nodes else slice(None)
                        total[k] = total.get(k, 0) + histogram(b.binned[rows][:, columns].astype(np.int64), w[rows])
            for k, x in total.items():
                for j in range(len(columns)):
                    yield pa.RecordBatch.from_arrays([pa.array([slot[k]], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(x[j]).tobytes()], pa.binary()),
                                                      pa.array([0.0]), pa.array([0], pa.int64())], ["slot", "j", "sums", "loss", "held"])
            if tree is None:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.binary()), pa.array([loss]), pa.array([held], pa.int64())],
                                                 ["slot", "j", "sums", "loss", "held"])

        def judge(key, frame):
            x = sum(np.frombuffer(b, np.float64).reshape(_BINS, 3) for b in frame["sums"])
            gain, at = best_splits(x[None, None], s)
            left, all_ = x[:at[0, 0] + 1].sum(0), x.sum(0)
            return pd.DataFrame([[key[0], key[1], gain[0, 0], at[0, 0], *left, *all_]], columns=["slot", "j", "gain", "bin", "g", "h", "n", "ag", "ah", "an"])

        partial = self.blocks.mapInArrow(count, "slot int, j int, sums binary, loss double, held long")
        if tree is None:
            partial = stage(partial, "boosting-root")
            told = partial.filter("slot < 0").agg(F.sum("loss"), F.sum("held")).first()
            partial = partial.filter("slot >= 0")
        judged = partial.groupBy("slot", "j").applyInPandas(judge, "slot int, j int, gain double, bin int, g double, h double, n double, ag double, ah double, an double")
        best: list[Split | None] = [None] * len(asked)
        totals = {}
        for r in sorted(judged.collect(), key=lambda r: (r["slot"], r["j"])):  # one row per leaf and column
            totals[asked[r["slot"]]] = (r["ag"], r["ah"], r["an"])
            old = best[r["slot"]]
            if math.isfinite(r["gain"]) and (old is None or r["gain"] > old.gain):
                left = (r["g"], r["h"], r["n"])
                best[r["slot"]] = Split(r["gain"], int(columns[r["j"]]), r["bin"], left, (r["ag"] - left[0], r["ah"] - left[1], r["an"] - left[2]))
        return totals, best, (told[0] if tree is None else 0.0), (told[1] if tree is None else 0)

    def run(self) -> tuple[list[dict], list[float]]:
        curve, s = None, self.s
        while True:
            if len(self._fresh()) >= TREES_A_STAGE:
                self.write_down()
            turn = len(self.trees)
            totals, best, loss, held = self.sums(None, [0], turn)
            curve = curve or Curve(s.patience if held else 0)
            if not curve.add(loss / _UNIT / held if held else None) or turn >= s.rounds:
                break
            tree, split = grow(totals[0], best[0], lambda t, made, open_: self.sums(t, open_, turn)[1] if open_ else [], s)
            self.trees.append(finished(tree, split, self.edges, s))
        return (self.trees[:curve.kept] if curve.patience and curve.losses else self.trees), curve.losses


def replace_margin(b: Block, trees: Sequence[Mapping]) -> Block:
    margin = b.margin
    for t in trees:
        margin = margin + t["value"][place(t, b.binned)]
    return replace(b, margin=margin)


_gauss = cache(np.polynomial.legendre.leggauss)


# --- fitted trees -----------------------------------------------------------------------------

@dataclass
class Forest:
    """Trees as arrays, one after another; ``start`` has one entry more than trees. A leaf is its own child."""

    base: float
    columns: int
    start: np.ndarray
    column: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    gain: np.ndarray

    ARRAYS = ("start", "column", "threshold", "left", "right", "value", "rows", "gain")

    @classmethod
    def of(cls, trees: Sequence[Mapping], base: float, columns: int) -> Forest:
        def joined(name, kind):
            return np.concatenate([t[name] for t in trees]).astype(kind) if trees else np.zeros(0, kind)

        return cls(base, columns, np.cumsum([0, *(len(t["column"]) for t in trees)]).astype(np.int32), joined("column", np.int32), joined("threshold", np.float64),
                   joined("left", np.int32), joined("right", np.int32), joined("value", np.float64), joined("rows", np.float64), joined("gain", np.float64))

    def __len__(self) -> int:
        return len(self.start) - 1

    def tree(self, k: int) -> dict[str, np.ndarray]:
        return {n: getattr(self, n)[self.start[k]:self.start[k + 1]] for n in self.ARRAYS[1:]}

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of rows (row, column)."""
        out, by_column = np.full(len(x), self.base), np.ascontiguousarray(x.T)
        for k in range(len(self)):
            out += self._walk(self.tree(k), by_column)
        return out

    @staticmethod
    def _walk(t: Mapping[str, np.ndarray], by_column: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row (column, row) reaches. Rows are parted node by node, as few of them are far down."""
        out = np.empty(by_column.shape[1])
        todo = [(0, np.arange(len(out)))]
        while todo:
            k, r = todo.pop()
            c = t["column"][k]
            if c < 0:
                out[r] = t["value"][k]
            elif len(r):
                left = by_column[c].take(r) <= t["threshold"][k]
                todo += [(t["left"][k], r.compress(left)), (t["right"][k], r.compress(~left))]
        return out

    def swapped_margins(self, x: np.ndarray, other: np.ndarray, groups: Sequence[Sequence[int]]) -> np.ndarray:
        """Log odds (row, group) of rows that take the columns of a group from ``other``; a tree that uses none of them
        is not walked again."""
        own = np.full(len(x), self.base)
        moved = np.zeros((len(x), len(groups)))
        x, other = np.ascontiguousarray(x.T), np.ascontiguousarray(other.T)
        for k in range(len(self)):
            t = self.tree(k)
            used = set(t["column"][t["column"] >= 0].tolist())
            before = self._walk(t, x)
            own += before
            for g, columns in enumerate(groups):
                here = [c for c in columns if c in used]
                if here:
                    mixed = x.copy()
                    mixed[here] = other[here]
                    moved[:, g] += self._walk(t, mixed) - before
        return own[:, None] + moved

    def expected(self) -> float:
        """Mean margin when every split sends rows on by the shares seen in training."""
        total = self.base
        for k in range(len(self)):
            t = self.tree(k)
            leaf = t["column"] < 0
            total += float((t["value"] * t["rows"])[leaf].sum() / t["rows"][0])
        return total

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley value of every column for every row, exact for the trees' own conditional means; see ``leaf_groups``.

        A leaf's part for column i is its value times (o_i - z_i) times the integral over t of the product of
        z_j (1 - t) + o_j t over the other columns of its path, o_j telling whether the row meets all conditions on
        column j and z_j the share of training rows that do. The product is a polynomial in t, which Gauss-Legendre
        quadrature integrates exactly. What the leaves of a group add up to depends on a few intervals of each column, so it
        is tabulated once and looked up for each row: many rows at a time are cheaper.
        """
        out = np.zeros((self.columns, len(x)))
        cuts = [np.unique(self.threshold[self.column == c]) for c in range(self.columns)]
        binned = np.stack([np.searchsorted(e, x[:, c]) for c, e in enumerate(cuts)], 1).astype(np.uint16) if self.columns else np.zeros((len(x), 0), np.uint16)
        bundles = Bundles(binned, cuts)
        codes = [code.astype(np.intp) for code in bundles.codes]
        for k in range(len(self)):
            found = []
            for leaves in leaf_groups(self.tree(k), cuts):
                if len(leaves) == 1 and 1 << len(leaves[0].columns) > STATES:
                    _rare(leaves[0], binned, out)
                else:
                    columns, states, table = tabulated(leaves)
                    luts = [(code, sum(states[c][cells[:, i]] for i, c in enumerate(b) if c in states)) for code, cells, b in zip(codes, bundles.bins, bundles.columns)
                            if any(c in states for c in b)]
                    found.append((columns, table, luts))
            for first in range(0, len(x), LOOKED_UP):
                part = slice(first, first + LOOKED_UP)
                for columns, table, luts in found:
                    at = luts[0][1].take(luts[0][0][part])
                    for code, lut in luts[1:]:
                        at += lut.take(code[part])
                    for c, values in zip(columns, table):
                        out[c, part] += values.take(at, mode="clip")
        return out.T

    def packed(self) -> dict:
        return {"base": self.base, "columns": self.columns,
                **{n: [getattr(self, n).dtype.str, base64.b64encode(getattr(self, n).tobytes()).decode()] for n in self.ARRAYS}}

    @classmethod
    def unpacked(cls, d: Mapping) -> Forest:
        return cls(d["base"], d["columns"], *(np.frombuffer(base64.b64decode(d[n][1]), d[n][0]) for n in cls.ARRAYS))


@dataclass
class Leaf:
    """The distinct columns on a leaf's path, the first and last bin each must lie in, the share of training rows that each
    condition set lets through, and the leaf's value."""

    columns: list[int]
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: float

    def parts(self, met: np.ndarray) -> np.ndarray:
        """Contributions (pattern, column) of rows by patterns that have a bit for each column whose conditions are met."""
        m = len(self.columns)
        o = (met[:, None] >> np.arange(m) & 1).astype(float)
        nodes, weights = _gauss((m + 1) // 2)
        t = (nodes + 1) / 2
        factor = self.share[None, :, None] * (1 - t) + o[:, :, None] * t
        rest = factor.prod(1, keepdims=True) / factor
        return self.value * (o - self.share) * (rest * (weights / 2)).sum(2)


def leaf_groups(tree: Mapping[str, np.ndarray], cuts: Sequence[np.ndarray]) -> Iterator[list[Leaf]]:
    """Leaves other than those that add nothing, as groups: whole branches in which the intervals of all columns, as far as the
    branch and the path to it tell them apart, have at most STATES combinations, and single leaves elsewhere.

    ``cuts`` are the thresholds of each column in order; a value's bin is the number of thresholds below it.
    """
    inner: dict[int, dict[int, set[int]]] = {}  # the cuts of each column below a node

    def look(k: int) -> dict[int, set[int]]:
        c = int(tree["column"][k])
        here: dict[int, set[int]] = {}
        if c >= 0:
            for child in (look(int(tree["left"][k])), look(int(tree["right"][k]))):
                for j, marks in child.items():
                    here.setdefault(j, set()).update(marks)
            here.setdefault(c, set()).add(int(np.searchsorted(cuts[c], tree["threshold"][k])))
        inner[k] = here
        return here

    def children(k: int, path: dict) -> list[tuple[int, dict]]:
        c = int(tree["column"][k])
        cut = int(np.searchsorted(cuts[c], tree["threshold"][k]))
        low, high, share = path.get(c, (0, len(cuts[c]), 1.0))
        return [(child, {**path, c: (a, b, share * tree["rows"][child] / tree["rows"][k])})
                for child, a, b in ((int(tree["left"][k]), low, min(high, cut)), (int(tree["right"][k]), max(low, cut + 1), high))]

    def leaves(k: int, path: dict) -> Iterator[Leaf]:
        todo = [(k, path)]
        while todo:
            k, path = todo.pop()
            if tree["column"][k] >= 0:
                todo += children(k, path)
            elif path and tree["value"][k] != 0.0:
                low, high, share = (np.array(v) for v in zip(*path.values()))
                yield Leaf(list(path), low, high, share, float(tree["value"][k]))

    look(0)
    todo: list[tuple[int, dict]] = [(0, {})]
    while todo:
        k, path = todo.pop()
        states = 1
        for c in path.keys() | inner[k].keys():
            low, high, _ = path.get(c, (0, len(cuts[c]), 1.0))
            states *= 1 + len(inner[k].get(c, ())) + (low > 0) + (high < len(cuts[c]))
        if states > STATES and tree["column"][k] >= 0:
            todo += children(k, path)
        elif group := list(leaves(k, path)):
            yield group


def tabulated(group: Sequence[Leaf]) -> tuple[list[int], dict[int, np.ndarray], np.ndarray]:
    """Columns of a group; for each column, what a bin adds to the place in the table; and the table (column, place) of contributions."""
    bounds: dict[int, set[int]] = {}
    for leaf in group:
        for c, low, high in zip(leaf.columns, leaf.low, leaf.high):
            bounds.setdefault(c, set()).update((int(low), int(high) + 1))
    columns = list(bounds)
    only = group[0] if len(group) == 1 else None
    marks = {c: np.array(sorted(b - {0}), int) for c, b in bounds.items()}
    bins = {c: np.concatenate([[0], m]) for c, m in marks.items()}  # the first bin of each interval
    sizes = [2] * len(columns) if only else [len(bins[c]) for c in columns]
    table = np.zeros((len(columns), *sizes))
    for leaf in group:
        met = np.zeros([1] * len(columns), int)
        for i, (c, low, high) in enumerate(zip(leaf.columns, leaf.low, leaf.high)):
            axis = columns.index(c)
            inside = np.arange(2) if only else ((bins[c] >= low) & (bins[c] <= high)).astype(int)
            met = met + (inside << i).reshape([-1 if a == axis else 1 for a in range(len(columns))])
        parts = leaf.parts(np.arange(1 << len(leaf.columns)))
        for i, c in enumerate(leaf.columns):
            table[columns.index(c)] += parts[:, i][met]
    steps = np.cumprod([1, *sizes[::-1]])[-2::-1]
    states = {}
    for c, step in zip(columns, steps):
        of = np.arange(bins[c][-1] + 1)
        if only:
            i = only.columns.index(c)
            states[c] = ((of >= only.low[i]) & (of <= only.high[i])) * step
        else:
            states[c] = np.searchsorted(marks[c], of, side="right") * step
    return columns, {c: _Last(v) for c, v in states.items()}, table.reshape(len(columns), -1)


class _Last:
    """Values by bin; bins behind the last one are like it."""

    def __init__(self, values: np.ndarray):
        self.values = values

    def __getitem__(self, bins: np.ndarray) -> np.ndarray:
        return self.values.take(bins, mode="clip")


def _rare(leaf: Leaf, binned: np.ndarray, out: np.ndarray) -> None:
    """Add the parts of a leaf with very many patterns: only those that occur are worked out."""
    x = binned[:, leaf.columns]
    met = ((x >= leaf.low) & (x <= leaf.high)) @ (1 << np.arange(len(leaf.columns), dtype=np.int64))
    patterns, which = np.unique(met, return_inverse=True)
    parts = leaf.parts(patterns)
    for i, c in enumerate(leaf.columns):
        out[c] += parts[:, i][which]


# --- the estimator ----------------------------------------------------------------------------

def bin_edges(rows: DataFrame, columns: int, sample_rows: int = EDGE_ROWS) -> list[np.ndarray]:
    """Upper edges of all bins but the last, for each column of (x array<double>, hash long): half-way between values
    where these are few, else values at even ranks. From at most about ``sample_rows`` rows, one column a task."""
    n = rows.count()
    if n > sample_rows:
        rows = rows.filter(F.pmod("hash", F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))

    def edge(key, frame):
        v = frame["v"].to_numpy()
        v = np.sort(v[np.isfinite(v)])
        u = np.unique(v)
        if len(u) <= _BINS:
            e = u[:-1] + (u[1:] - u[:-1]) / 2
        else:
            e = np.unique(v[np.arange(1, _BINS) * len(v) // _BINS])
        return pd.DataFrame({"j": [key[0]], "edges": [e[:_BINS - 1]]})

    found = {r["j"]: r["edges"] for r in rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").applyInPandas(edge, "j int, edges array<double>").collect()}
    return [np.array(found.get(j, []), float) for j in range(columns)]


def to_blocks(rows: DataFrame, edges: Sequence[np.ndarray], base: float) -> DataFrame:
    """Binned blocks of (x, y, held, hash)."""
    per_block = max(1, BLOCK_BYTES // max(len(edges), 1))

    def binned(batches):
        held: list = []

        def out():
            x, y, h, k = (np.concatenate(p) for p in zip(*held))
            held.clear()
            b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1).astype(np.uint8)
            return Block(b, y, h, k, np.full(len(y), base)).record()

        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            held.append((x, batch.column("y").to_numpy(zero_copy_only=False).astype(np.uint8), batch.column("held").to_numpy(zero_copy_only=False).astype(bool),
                         batch.column("hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
            if sum(len(h[1]) for h in held) >= per_block:
                yield out()
        if held:
            yield out()

    return rows.mapInArrow(binned, Block.SCHEMA)


@dataclass
class Binned:
    """Rows in blocks, ready for any number of fits."""

    blocks: DataFrame | None  # None where there is nothing to learn from
    edges: list[np.ndarray]
    base: float  # log odds of the rows not held
    rows: int

    @property
    def bytes(self) -> int:
        return self.rows * len(self.edges)


def bin_rows(df: DataFrame, features: str = "features", label: str = "y", key: str = "row_id", held: str | None = None) -> Binned:
    """Edges from rows that are not held, and blocks of all rows."""
    x = vector_to_array(features)
    rows = stage(df.select(x.alias("x"), F.col(label).cast("int").alias("y"), (F.coalesce(F.col(held), F.lit(False)) if held else F.lit(False)).alias("held"),
                           F.xxhash64(key).alias("hash"), F.size(x).alias("k")), "boosting-rows")
    told = rows.agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.count_if(~F.col("held")).alias("m"), F.sum(F.when(~F.col("held"), F.col("y"))).alias("ones")).first()
    k, m, ones = told["k"] or 0, told["m"], told["ones"] or 0
    if not m or not k or ones in (0, m):  # one class only, or nothing to learn from
        p = min(max(ones / m, 1e-6), 1 - 1e-6) if m else 0.5
        return Binned(None, [np.zeros(0)] * k, math.log(p / (1 - p)), told["n"])
    base = math.log(ones / (m - ones))
    edges = bin_edges(rows.filter("not held"), k)
    return Binned(stage(to_blocks(rows, edges, base), "boosting-blocks"), edges, base, told["n"])


def boost(binned: Binned, s: Settings, one_task_bytes: int = ONE_TASK_BYTES) -> tuple[Forest, list[float]]:
    """Trees and the validation curve (mean log loss of held rows after 0, 1, ... rounds; empty without them)."""
    edges, base = binned.edges, binned.base
    if binned.blocks is None:
        return Forest.of([], base, len(edges)), []
    if binned.bytes > one_task_bytes:
        trees, curve = Across(binned.blocks, edges, base, s).run()
        return Forest.of(trees, base, len(edges)), curve

    def here(batches):
        parts = [b for batch in batches for b in Block.read(batch)]
        if parts:
            whole = Block(*(np.concatenate([getattr(b, n) for b in parts]) for n in ("binned", "y", "held", "hashes", "margin")))
            trees, curve = boost_here(whole, edges, base, s)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(Forest.of(trees, base, len(edges)).packed())]), pa.array([curve], pa.list_(pa.float64()))], ["forest", "curve"])

    made = binned.blocks.coalesce(1).mapInArrow(here, "forest string, curve array<double>").first()
    return Forest.unpacked(json.loads(made["forest"])), list(made["curve"])


def fit_forest(df: DataFrame, s: Settings, features: str = "features", label: str = "y", key: str = "row_id", held: str | None = None,
               one_task_bytes: int = ONE_TASK_BYTES) -> tuple[Forest, list[float]]:
    """``boost`` on rows binned for this one fit."""
    return boost(bin_rows(df, features, label, key, held), s, one_task_bytes)


_FORESTS: dict[str, Forest] = {}


class HistBooster(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for a binary label; see the module. Settings are those of ``Settings``."""

    settings = Param(Params._dummy(), "settings", "growth of trees", lambda v: v)
    featuresCol = Param(Params._dummy(), "featuresCol", "feature vector", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "binary label", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "unique row key", TypeConverters.toString)
    heldCol = Param(Params._dummy(), "heldCol", "rows that only tell when to stop; empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, settings: Settings | None = None, featuresCol: str = "features", labelCol: str = "y", keyCol: str = "row_id", heldCol: str = ""):
        super().__init__()
        self._setDefault(settings=asdict(Settings()), featuresCol="features", labelCol="y", keyCol="row_id", heldCol="")
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        if settings is not None:
            given["settings"] = asdict(settings)
        self._set(**given)

    def _fit(self, df: DataFrame) -> HistBoosterModel:
        get = self.getOrDefault
        forest, curve = fit_forest(df, Settings(**get(self.settings)), get(self.featuresCol), get(self.labelCol), get(self.keyCol), get(self.heldCol) or None)
        return HistBoosterModel.of(forest, curve, get(self.featuresCol))


class HistBoosterModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; adds ``margin`` (log odds) and ``probability``."""

    state = Param(Params._dummy(), "state", "fitted trees", lambda v: v)

    def __init__(self, state: dict | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    @classmethod
    def of(cls, forest: Forest, curve: Sequence[float] = (), features: str = "features") -> HistBoosterModel:
        return cls({"forest": forest.packed(), "curve": list(curve), "features": features})

    @property
    def forest(self) -> Forest:
        return Forest.unpacked(self.getOrDefault(self.state)["forest"])

    @property
    def curve(self) -> list[float]:
        return self.getOrDefault(self.state)["curve"]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of all gains by column."""
        f = self.forest
        inner = f.column >= 0
        total = np.bincount(f.column[inner], f.gain[inner], f.columns)
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.getOrDefault(self.state)
        uid, packed = f"{self.uid}-{id(state)}", state["forest"]

        @F.pandas_udf("double")
        def margin(x: pd.Series) -> pd.Series:
            if uid not in _FORESTS:
                _FORESTS.clear()  # one forest per worker
                _FORESTS[uid] = Forest.unpacked(packed)
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, packed["columns"]))
            return pd.Series(_FORESTS[uid].margin(rows))

        p = 1 / (1 + F.exp(-F.col("margin")))
        return df.withColumn("margin", margin(vector_to_array(state["features"]))).withColumn("probability", array_to_vector(F.array(1 - p, p)))
