"""Extremely randomised trees, grown level by level: at each node a few features, one random cut for each, the best of these; no bootstrap.

A node of at most HELD_ROWS rows is grown to its leaves in one task, with the rows of all its task's nodes in memory. Each task reads the written rows
for itself: no row is shuffled, and none comes to the driver. With so many rows at the root, as in most samples, tasks grow whole trees.

Larger nodes are split by passes. A pass is one aggregate: tasks lead their rows down the trees as they stand to the nodes that are being split, and give
for either side of each candidate cut the counts, the class weights and the range of every feature. So when the best candidate is taken, its children's
ranges are known, and the next cuts can be drawn at once. Only these cells leave the tasks, SLOTS nodes at a time.

Rows are read again for each pass and task, so that nothing is lost with an executor. Draws are hashes of seed, tree, node and feature: a model depends on the
rows alone, not on their order or partitions (weights are counted in steps of 2^-20, shares in steps of 2^-40, which makes their sums exact).

The model lives on the driver, as arrays: at most 2 * rows / leaf nodes a tree. Fit on a bounded sample; ``max_nodes`` is checked. Rows with
a NULL or NaN feature or label, or a NULL weight, teach nothing; a NULL group is a group of its own.

Leaving out groups costs no further passes: the trees of all folds grow side by side, each without the rows of its own group. Where only the classes
of the rows left out are wanted (``predict_left_out``), trees stay in the tasks that grow them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileframe.operators.storage import materialise

#: Nodes that are split in one pass over the rows, and rows that are looked at together.
SLOTS = 16_384
ROWS = 4096
#: Rows of a node that a task holds together (some 150 bytes each), and tasks for each core.
HELD_ROWS = 2_000_000
TASKS = 4
#: Rows of a task, about: what tasks give are cells, so few rows in many tasks give the same cells many times.
TASK_ROWS = 20_000
UNIT = 1 << 20
SHARE = 1 << 40


def uniform(seed: int, tree: np.ndarray, node: np.ndarray, feature: np.ndarray | int, what: int) -> np.ndarray:
    """Numbers from 0 to 1 by a hash of all arguments; node is the place in a complete binary tree, from 1."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + tree.astype("uint64") * np.uint64(0xD1B54A32D192ED03)
        for part in (node.astype("uint64"), np.uint64(feature) if np.isscalar(feature) else feature.astype("uint64"), np.uint64(what)):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = (x ^ (x >> np.uint64(31))) + part * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(11)) / float(1 << 53)


@dataclass
class ExtraTrees:
    """Nodes of all trees, the roots first; the right child of a node follows its left child. feature is -1 in leaves."""

    features: tuple[str, ...]
    classes: tuple[int, ...]
    trees: int
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    shares: np.ndarray = field(repr=False)
    folds: tuple = ()

    def lead(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """The node of each row (rows x roots) that it ends in."""
        columns, rows = np.ascontiguousarray(x.T), np.arange(len(x))
        return np.stack([ends(columns, rows, self.feature, self.threshold, self.left, root) for root in roots.tolist()], 1) if len(roots) else np.empty((len(x), 0), "int64")

    def probabilities(self, x: np.ndarray, fold: int = 0) -> np.ndarray:
        """The sum of the class shares of the leaves, for the trees of a fold, in units."""
        columns, rows, total = np.ascontiguousarray(x.T), np.arange(len(x)), np.zeros((len(x), len(self.classes)), "int64")
        for root in range(fold * self.trees, (fold + 1) * self.trees):
            total += in_units(self.shares[ends(columns, rows, self.feature, self.threshold, self.left, root)])
        return total


def in_units(shares: np.ndarray) -> np.ndarray:
    return np.rint(shares * SHARE).astype("int64")


def ends(columns: np.ndarray, rows: np.ndarray, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, root: int) -> np.ndarray:
    """Where rows (places in the columns) end, in one tree."""
    flat, stride = columns.ravel(), columns.shape[1]
    node, live = np.full(len(rows), root, "int64"), np.arange(len(rows))
    while len(live):
        at = node[live]
        f = feature[at].astype("int64")
        inner = f >= 0
        if not inner.all():
            live, at, f = live[inner], at[inner], f[inner]
        node[live] = left[at] + (flat[f * stride + rows[live]] > threshold[at])
    return node


def usable(df: DataFrame, features: Sequence[str], label: str, weight: str | None, group: str | None, keep: Sequence[str] = ()) -> DataFrame:
    """x (NULL is NaN), y, w (in units), g, whether a row teaches, a number, and ``keep`` as keep0, keep1, ..."""
    fine = F.col(label).isNotNull()
    for f in features:
        fine &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    if weight:
        fine &= F.col(weight).isNotNull()
    w = F.round((F.col(weight) if weight else F.lit(1.0)) * UNIT).cast("bigint")
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in features])
    g = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    return df.select(x.alias("x"), F.col(label).cast("int").alias("y"), w.alias("w"), g.alias("g"), fine.alias("teaches"), F.monotonically_increasing_id().alias("id"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])


@dataclass
class Frontier:
    """Nodes that may be split: where they are in the model's arrays, their tree and place in it, and what is known of their rows."""

    at: np.ndarray
    tree: np.ndarray
    place: np.ndarray
    n: np.ndarray
    weights: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def take(self, which: np.ndarray | slice) -> Frontier:
        return Frontier(self.at[which], self.tree[which], self.place[which], self.n[which], self.weights[which], self.low[which], self.high[which])

    def splitting(self, leaf: int) -> np.ndarray:
        return (self.n >= 2 * leaf) & ((self.weights > 0).sum(1) > 1) & (self.high > self.low).any(1)

    @staticmethod
    def joined(parts: Sequence[Frontier]) -> Frontier:
        return Frontier(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("at", "tree", "place", "n", "weights", "low", "high")])


def candidates(nodes: Frontier, seed: int, tries: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes x tries: features (-1: none) and cuts. Features are drawn in hashed order; those without a range don't count, unless the first
    ones all have none: then the next one with a range is taken."""
    tree, place, low, high = nodes.tree, nodes.place, nodes.low, nodes.high
    k = low.shape[1]
    order = np.argsort(np.stack([uniform(seed, tree, place, f, 1) for f in range(k)], 1), 1, kind="stable")
    wide = np.take_along_axis(high > low, order, 1)
    rank = np.cumsum(wide, 1)
    within = np.arange(k) < tries
    taken = wide & (within | ((wide & within).sum(1) == 0)[:, None] & (rank == 1))
    feature, cut = np.full((len(tree), tries), -1), np.zeros((len(tree), tries))
    row, col = np.nonzero(taken)
    slot = np.cumsum(taken, 1)[row, col] - 1
    f = order[row, col]
    feature[row, slot] = f
    a, b = low[row, f], high[row, f]
    found = a + uniform(seed, tree[row], place[row], f, 2) * (b - a)
    cut[row, slot] = np.where(found >= b, a, found)
    return feature, cut


def subtree(columns: np.ndarray, weights: np.ndarray, rows: np.ndarray, tree: int, place: int, deep: int, balance: np.ndarray, leaf: int, seed: int, tries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """feature, threshold, left child and shares of a node and all below it, by levels. columns: features x rows, weights: classes x rows.

    The rows of a node are neighbours in ``rows``; all nodes of a level are split together.
    """
    flat, (k, stride) = columns.ravel(), columns.shape
    place, size, own = np.array([place]), np.array([len(rows)]), weights[:, rows].sum(1)[None, :]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    total = 1
    for level in range(deep + 1):
        feature, threshold, left = np.full(len(place), -1, "int16"), np.zeros(len(place)), np.zeros(len(place), "int32")
        levels.append((feature, threshold, left, own))
        at = np.flatnonzero((size >= 2 * leaf) & ((own > 0).sum(1) > 1))
        if level == deep or not len(at):
            break
        if len(at) < len(size):
            live = np.zeros(len(size), bool)
            live[at] = True
            rows, place, size, own = rows[np.repeat(live, size)], place[at], size[at], own[at]
        start = np.cumsum(size) - size
        trees = np.full(len(at), tree)
        order = np.argsort(np.stack([uniform(seed, trees, place, f, 1) for f in range(k)], 1), 1, kind="stable")
        tried, cut, right = np.full((len(at), tries), -1), np.zeros((len(at), tries)), np.zeros((tries, len(rows)), bool)

        def look(which: np.ndarray, rows: np.ndarray, start: np.ndarray, size: np.ndarray, slot: int, j: int) -> np.ndarray:
            """Sides of the rows of some nodes by their j-th feature, which goes to a slot where it has a range."""
            f = order[which, j]
            values = flat[np.repeat(f * stride, size) + rows]
            low, high = np.minimum.reduceat(values, start), np.maximum.reduceat(values, start)
            found = low + uniform(seed, trees[which], place[which], f, 2) * (high - low)
            found = np.where(found >= high, low, found)
            wide = high > low
            tried[which[wide], slot], cut[which[wide], slot] = f[wide], found[wide]
            return values > np.repeat(found, size)

        every = np.arange(len(at))
        for j in range(min(tries, k)):
            right[j] = look(every, rows, start, size, j, j)
        for j in range(tries, k):
            rest = np.flatnonzero((tried < 0).all(1))
            if not len(rest):
                break
            mine = np.zeros(len(at), bool)
            mine[rest] = True
            mine = np.repeat(mine, size)
            right[0, mine] = look(rest, rows[mine], np.cumsum(size[rest]) - size[rest], size[rest], 0, j)
        n, sides = np.zeros((len(at), tries, 2), "int64"), np.zeros((len(at), tries, 2, len(weights)), "int64")
        held = weights[:, rows]
        for j in range(tries):
            n[:, j, 1] = np.add.reduceat(right[j], start, dtype="int64")
            for c in range(len(weights)):
                sides[:, j, 1, c] = np.add.reduceat(held[c] * right[j], start)
        n[:, :, 0], sides[:, :, 0] = size[:, None] - n[:, :, 1], own[:, None] - sides[:, :, 1]
        fits = (tried >= 0) & (n >= leaf).all(2)
        scaled = sides * balance
        gain = np.where(fits, ((scaled**2).sum(3) / np.maximum(scaled.sum(3), 1e-300)).sum(2), -np.inf)
        some = fits.any(1)
        node, best = np.flatnonzero(some), gain.argmax(1)
        if not len(node):
            break
        feature[at[node]], threshold[at[node]], left[at[node]] = tried[node, best[node]], cut[node, best[node]], total + 2 * np.arange(len(node))
        total += 2 * len(node)
        # Rows of left children come before those of right ones, in the order that they have.
        stay = np.repeat(some, size)
        to_right = right[np.repeat(best, size), np.arange(len(rows))][stay]
        rows, was, n, sides = rows[stay], size[node], n[node, best[node]], sides[node, best[node]]
        start = np.cumsum(was) - was
        before = np.cumsum(~to_right) - ~to_right
        before -= np.repeat(before[start], was)
        within = np.arange(len(rows)) - np.repeat(start, was)
        moved = np.empty_like(rows)
        moved[np.repeat(start, was) + np.where(to_right, np.repeat(n[:, 0], was) + within - before, before)] = rows
        rows, size, own, place = moved, n.ravel(), sides.reshape(-1, len(weights)), (2 * place[node][:, None] + [0, 1]).ravel()
    feature, threshold, left, own = (np.concatenate(x) for x in zip(*levels, strict=True))
    return feature, threshold, left, shares_of(own * balance)


def shares_of(scaled: np.ndarray) -> np.ndarray:
    total = scaled.sum(1, keepdims=True)
    return np.where(total > 0, scaled / np.where(total > 0, total, 1), 1 / scaled.shape[1])


def read_whole(rows: DataFrame, parts: int) -> DataFrame:
    """rows with a column part, 0 to parts - 1: a partition with all rows for each part. rows has been written, and is read again by each."""
    spark = rows.sparkSession
    # Two rows without a part, of another partitioning: Spark would lay branches of one partition each on top of each other.
    none = spark.range(0, 2, 1, 2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields], F.lit(-1).alias("part"))
    return reduce(DataFrame.unionAll, [rows.coalesce(1).withColumn("part", F.lit(i)) for i in range(parts)], none)


@dataclass
class Growing:
    """What is known before nodes are grown in tasks: the model as it stands, the frontier with the levels below each node, and how to grow."""

    model: ExtraTrees
    nodes: Frontier
    deep: np.ndarray
    balance: np.ndarray
    groups: list[str] | None
    leaf: int
    seed: int
    tries: int
    max_nodes: int

    def __post_init__(self) -> None:
        order = np.argsort(-self.nodes.n, kind="stable")
        self.nodes, self.deep = self.nodes.take(order), self.deep[order]

    def parts(self, rows: DataFrame) -> int:
        return min(len(self.nodes.at), TASKS * rows.sparkSession.sparkContext.defaultParallelism)

    def grow(self, batches: Iterable[pa.RecordBatch], parts: int) -> Iterator[tuple]:
        """Of a part: the features x rows, the folds and ids of all rows, None; then for each of its nodes its place, its fold, its subtree and its tree.
        Ends early when there are more than ``max_nodes``."""
        names, classes = self.model.features, self.model.classes
        held: list[tuple[np.ndarray, ...]] = []
        part, fold_of = -1, {g: k for k, g in enumerate(self.groups or ())}
        for batch in batches:
            if batch.num_rows and (part := batch.column("part")[0].as_py()) >= 0:
                fold = np.array([fold_of.get(g, -1) for g in batch.column("g").to_pylist()])
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(names)).T
                held.append((x, batch.column("y").fill_null(-1).to_numpy(), batch.column("w").fill_null(0).to_numpy(), batch.column("teaches").to_numpy(zero_copy_only=False), fold, batch.column("id").to_numpy()))
        if not held:
            return
        columns = np.ascontiguousarray(np.concatenate([x[0] for x in held], 1))
        y, w, teaches, fold, ids = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
        del held
        weights = np.where(y == np.array(classes)[:, None], w, 0)
        yield columns, fold, ids, None
        n = 0
        for at in range(part, len(self.nodes.at), parts):
            tree = int(self.nodes.tree[at])
            own = tree // self.model.trees
            rows = np.flatnonzero(teaches & (fold != own)) if self.groups else np.flatnonzero(teaches)
            if self.nodes.place[at] > 1:
                rows = rows[ends(columns, rows, self.model.feature, self.model.threshold, self.model.left, tree) == self.nodes.at[at]]
            grown = subtree(columns, weights, rows, tree, int(self.nodes.place[at]), int(self.deep[at]), self.balance[own], self.leaf, self.seed, self.tries)
            n += len(grown[0])
            yield at, own, grown, tree
            if self.max_nodes and n > self.max_nodes:
                return


def grown_nodes(rows: DataFrame, growing: Growing) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The subtrees of the frontier: the node's place in the model, and the arrays of its subtree."""
    parts = growing.parts(rows)
    shared = rows.sparkSession.sparkContext.broadcast(growing)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, _, grown, tree in shared.value.grow(batches, parts):
            if tree is not None:  # the driver sees from the lengths if there are too many nodes
                yield pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([x.tobytes()], pa.binary()) for x in grown]], ["at", "feature", "threshold", "left", "shares"])

    found = read_whole(rows, parts).mapInArrow(run, "at bigint, feature binary, threshold binary, left binary, shares binary").toArrow().sort_by("at")
    shared.unpersist()
    kinds = {"feature": "int16", "threshold": "float64", "left": "int32", "shares": "float64"}
    return [(int(growing.nodes.at[r["at"].as_py()]), *[np.frombuffer(r[c].as_buffer(), kind) for c, kind in kinds.items()]) for r in (dict(zip(found.column_names, [c[i] for c in found.columns], strict=True)) for i in range(found.num_rows))]


def begun(rows: DataFrame, names: tuple[str, ...], trees: int, leave_out: bool) -> tuple[ExtraTrees, Frontier | None, np.ndarray, list[str]]:
    """A model of roots, these as a frontier (None if there is nothing to learn), the weights of classes by fold, and the groups."""
    k = len(names)
    limits = [f(F.get("x", F.lit(i))).alias(f"{n}{i}") for n, f in (("low", F.min), ("high", F.max)) for i in range(k)]
    # One row for each group and class.
    known = rows.where("teaches").groupBy("g", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w"), *limits).orderBy("g", "y").collect()
    groups, classes = sorted({r.g for r in known}), sorted({r.y for r in known})
    folds = groups if leave_out else [None]
    model = ExtraTrees(names, tuple(classes), trees, np.empty(0, "int16"), np.empty(0), np.empty(0, "int32"), np.empty((0, len(classes))), tuple(folds))
    if not known or leave_out and len(groups) < 2:
        model.trees = 0
        return model, None, np.ones((0, 0)), groups
    balance, roots = np.ones((len(folds), len(classes))), []
    for fold, out in enumerate(folds):
        own = [r for r in known if r.g != out]
        weights = np.array([sum(r.w for r in own if r.y == c) for c in classes], "int64")
        some = weights > 0
        balance[fold] = np.where(some, weights.sum() / (max(1, some.sum()) * np.maximum(weights, 1)), 0.0)
        limits = [np.array([pick(r[f"{name}{i}"] for r in own) for i in range(k)]) for name, pick in (("low", min), ("high", max))]
        tree = np.arange(fold * trees, (fold + 1) * trees)
        roots.append(Frontier(tree, tree, np.ones(trees, "int64"), np.full(trees, sum(r.n for r in own)), np.tile(weights, (trees, 1)), *[np.tile(v, (trees, 1)) for v in limits]))
    nodes = Frontier.joined(roots)
    append(model, shares_of(nodes.weights * balance[nodes.tree // trees]))
    return model, nodes, balance, groups


def append(model: ExtraTrees, shares: np.ndarray) -> np.ndarray:
    """New leaves, and where they are."""
    n = len(shares)
    at = len(model.feature) + np.arange(n)
    model.feature, model.threshold, model.left = np.append(model.feature, np.full(n, -1, "int16")), np.append(model.threshold, np.zeros(n)), np.append(model.left, np.zeros(n, "int32"))
    model.shares = np.concatenate([model.shares, shares])
    return at


def split_large(rows: DataFrame, model: ExtraTrees, active: Frontier, balance: np.ndarray, groups: list[str] | None, depth: int, leaf: int, seed: int, tries: int) -> tuple[Frontier, np.ndarray]:
    """Splits nodes of more than HELD_ROWS rows by passes. The leaves of the model as it then stands, and the levels that each may get."""
    k, trees, classes = len(model.features), model.trees, model.classes
    left, deep = [], []
    rows = rows.coalesce(max(1, int(active.n.max()) // TASK_ROWS))
    for level_no in range(depth + 1):
        splits = active.splitting(leaf)
        small = (active.n <= HELD_ROWS) | ~splits if level_no < depth else np.ones(len(active.n), bool)
        left.append(active.take(small))
        deep.append(np.where(splits[small], depth - level_no, 0))
        active = active.take(~small)
        if not len(active.at):
            break
        following = []
        for start in range(0, len(active.at), SLOTS):
            some = active.take(slice(start, start + SLOTS))
            f, cut = candidates(some, seed, tries)
            n, weights, low, high = level(rows, model, some, f, cut, groups)
            fits = (f >= 0) & (n >= leaf).all(2)
            sides = weights * balance[some.tree // trees][:, None, None, :]  # nodes x tries x side x class
            gain = np.where(fits, ((sides**2).sum(3) / np.maximum(sides.sum(3), 1e-300)).sum(2), -np.inf)
            node, best = np.flatnonzero(fits.any(1)), gain.argmax(1)[fits.any(1)]
            left.append(some.take(~fits.any(1)))
            deep.append(np.zeros(len(left[-1].at), "int64"))
            tree, own = np.repeat(some.tree[node], 2), weights[node, best].reshape(-1, len(classes))
            children = append(model, shares_of(own * balance[tree // trees]))
            at = some.at[node]
            model.feature[at], model.threshold[at], model.left[at] = f[node, best], cut[node, best], children[::2]
            following.append(Frontier(children, tree, (2 * some.place[node][:, None] + [0, 1]).ravel(), n[node, best].ravel(), own, low[node, best].reshape(-1, k), high[node, best].reshape(-1, k)))
        active = Frontier.joined(following)
    return Frontier.joined(left), np.concatenate(deep)


def fit_extra_trees(
    df: DataFrame, features: Sequence[str], label: str = "target", weight: str | None = "weight", trees: int = 128, depth: int = 24, leaf: int = 8, seed: int = 20260821,
    tries: int | None = None, leave_out: str | None = None, max_nodes: int = 50_000_000,
) -> ExtraTrees:
    """tries: features looked at in a node, by default the square root of their number. Classes are balanced by weight.

    leave_out: a column of groups; the model then has ``trees`` trees for each group (``folds``, in order), grown without its rows.
    """
    names, tries = tuple(features), tries or max(1, int(len(features) ** 0.5))
    rows = materialise(usable(df, features, label, weight, leave_out).where("teaches"), "tree-rows")
    model, nodes, balance, groups = begun(rows, names, trees, leave_out is not None)
    if nodes is None:
        return model
    groups = groups if leave_out else None
    nodes, deep = split_large(rows, model, nodes, balance, groups, depth, leaf, seed, tries)
    nodes, deep = nodes.take(deep > 0), deep[deep > 0]
    if len(nodes.at):
        found = grown_nodes(rows, Growing(model, nodes, deep, balance, groups, leaf, seed, tries, max_nodes))
        if len(model.feature) + sum(len(f) - 1 for _, f, *_ in found) > max_nodes:
            raise ValueError(f"more than {max_nodes} nodes: fit on a smaller sample or with larger leaves")
        # The first node of a subtree is in the model; the others come after what is there.
        arrays, end = [(model.feature, model.threshold, model.left, model.shares)], len(model.feature)
        for at, feature, threshold, left, shares in found:
            below = np.where(feature >= 0, left + (end - 1), 0).astype("int32")
            model.feature[at], model.threshold[at], model.left[at] = feature[0], threshold[0], below[0]
            arrays.append((feature[1:], threshold[1:], below[1:], shares.reshape(-1, len(model.classes))[1:]))
            end += len(feature) - 1
        model.feature, model.threshold, model.left, model.shares = (np.concatenate(x) for x in zip(*arrays, strict=True))
    return model


def predict_left_out(
    df: DataFrame, group: str, features: Sequence[str], label: str = "target", weight: str | None = "weight", trees: int = 128, depth: int = 24, leaf: int = 8, seed: int = 20260821, tries: int | None = None, name: str = "pred",
) -> DataFrame:
    """group, label, weight and the class of each row by the trees that were grown without its group, as ``predict`` has it with ``fold_of``. No tree leaves the task that grows it."""
    names, tries = tuple(features), tries or max(1, int(len(features) ** 0.5))
    kept = [group, label, *([weight] if weight else [])]
    rows = materialise(usable(df, features, label, weight, group, kept), "tree-rows")
    model, nodes, balance, groups = begun(rows, names, trees, True)
    if nodes is None:
        return rows.select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(kept)], F.lit(None).cast("int").alias(name))
    nodes, deep = split_large(rows.where("teaches"), model, nodes, balance, groups, depth, leaf, seed, tries)
    growing = Growing(model, nodes, deep, balance, groups, leaf, seed, tries, 0)
    parts = growing.parts(rows)
    shared = rows.sparkSession.sparkContext.broadcast(growing)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        growing, sums = shared.value, None
        model = growing.model
        for at, fold, grown, tree in growing.grow(batches, parts):
            if tree is None:
                columns, folds, ids = at, fold, grown
                fine = ~np.isnan(columns).any(0)
                mine = {f: np.flatnonzero(fine & (folds == f)) for f in range(len(model.folds))}
                sums = np.zeros((columns.shape[1], len(model.classes)), "int64")
                continue
            rows = mine[fold]
            if growing.nodes.place[at] > 1:
                rows = rows[ends(columns, rows, model.feature, model.threshold, model.left, tree) == growing.nodes.at[at]]
            feature, threshold, left, shares = grown
            sums[rows] += in_units(shares[ends(columns, rows, feature, threshold, left, 0)])
        if sums is not None:
            some = np.flatnonzero(sums.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), *[pa.array(sums[some, c]) for c in range(len(model.classes))]], ["id", *[f"s{c}" for c in range(len(model.classes))]])

    sums = [f"s{c}" for c in range(len(model.classes))]
    found = read_whole(rows, parts).mapInArrow(run, ", ".join(f"{x} bigint" for x in ["id", *sums])).groupBy("id").agg(*[F.sum(x).alias(x) for x in sums])
    best = F.array(*sums)
    pred = F.get(F.array(*[F.lit(c) for c in model.classes]), (F.array_position(best, F.array_max(best)) - 1).cast("int"))
    told = found.select("id", pred.cast("int").alias(name))
    return rows.join(told, "id", "left").select(*[F.col(f"keep{i}").alias(c) for i, c in enumerate(kept)], name)


def level(rows: DataFrame, model: ExtraTrees, nodes: Frontier, feature: np.ndarray, cut: np.ndarray, groups: list[str] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node, candidate and side: rows, weight by class, least and greatest value of each feature."""
    s, tries = feature.shape
    k, classes = len(model.features), model.classes
    slot_of = np.full(len(model.feature), -1)
    slot_of[nodes.at] = np.arange(s)
    roots = np.unique(nodes.tree)
    cells = s * tries * 2
    whole = ExtraTrees(model.features, model.classes, model.trees, model.feature, model.threshold, model.left, np.zeros((0, 0)))
    shared = rows.sparkSession.sparkContext.broadcast((whole, slot_of, feature, cut))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, slot_of, feature, cut = shared.value
        n, w = np.zeros(cells, "int64"), np.zeros((cells, len(classes)), "int64")
        low, high = np.full((cells, k), np.inf), np.full((cells, k), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("x").flatten().to_numpy().reshape(-1, k)
                y = np.searchsorted(classes, part.column("y").to_numpy())
                own = part.column("w").to_numpy()
                slot = slot_of[model.lead(x, roots)]
                if groups:
                    fold = np.searchsorted(groups, part.column("g").to_pylist())
                    slot[fold[:, None] == roots // model.trees] = -1
                row, col = np.nonzero(slot >= 0)
                slot = slot[row, col]
                for c in range(tries):
                    f = feature[slot, c]
                    real = f >= 0
                    r, at_slot, f = row[real], slot[real], f[real]
                    cell = (at_slot * tries + c) * 2 + (x[r, f] > cut[at_slot, c])
                    order = np.argsort(cell, kind="stable")
                    cell, r = cell[order], r[order]
                    if not len(cell):
                        continue
                    first = np.flatnonzero(np.diff(cell, prepend=-1))
                    met = cell[first]
                    n[met] += np.diff(np.append(first, len(cell)))
                    np.add.at(w, (cell, y[r]), own[r])
                    values = x[r]
                    low[met] = np.minimum(low[met], np.minimum.reduceat(values, first))
                    high[met] = np.maximum(high[met], np.maximum.reduceat(values, first))
        met = np.flatnonzero(n)
        columns = [met, n[met], *w[met].T, *low[met].T, *high[met].T]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v)) for v in columns], names)

    names = ["cell", "n", *[f"w{i}" for i in range(len(classes))], *[f"low{i}" for i in range(k)], *[f"high{i}" for i in range(k)]]
    schema = ", ".join(f"{v} {'double' if v[0] in 'lh' else 'bigint'}" for v in names)
    ways = {"n": F.sum, "w": F.sum, "l": F.min, "h": F.max}
    found = rows.mapInArrow(run, schema).groupBy("cell").agg(*[ways[v[0]](v).alias(v) for v in names[1:]]).toArrow()
    cell = found.column("cell").to_numpy()
    shape = (s, tries, 2)

    def spread(prefix: str, width: int, kind: str) -> np.ndarray:
        out = np.zeros((cells, width), kind)
        for i in range(width):
            out[cell, i] = found.column(f"{prefix}{i}").to_numpy()
        return out.reshape(*shape, width)

    n = np.zeros(cells, "int64")
    n[cell] = found.column("n").to_numpy()
    out = n.reshape(shape), spread("w", len(classes), "int64"), spread("low", k, "float64"), spread("high", k, "float64")
    shared.unpersist()
    return out


def predict(model: ExtraTrees, df: DataFrame, name: str = "pred", fold_of: str | None = None, only: Column | None = None) -> DataFrame:
    """df with the class of greatest mean share (ties to the lower class); NULL where a feature is NULL or NaN, and where nothing was taught.

    fold_of: a column of groups; each row is judged by the trees that were grown without its group (rows of other groups: NULL).
    only: rows that are judged; others have NULL.
    """
    fields = df.schema.fields
    vector = F.array(*[F.col(f).cast("double") if only is None else F.when(only, F.col(f).cast("double")) for f in model.features])
    group = F.coalesce(F.col(fold_of).cast("string"), F.lit("")) if fold_of else F.lit("")
    picked = df.select(*[F.col(f"`{v.name}`").alias(f"k{i}") for i, v in enumerate(fields)], vector.alias("x"), group.alias("g"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"k{i} {v.dataType.simpleString()}" for i, v in enumerate(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(model.features))
            out, fine = np.full(len(x), np.nan), ~np.isnan(x).any(1)
            g = np.array(batch.column("g").to_pylist(), object)
            for fold, left_out in enumerate(model.folds if model.trees else ()):
                mine = np.flatnonzero(fine & (g == left_out) if fold_of else fine)
                for at in range(0, len(mine), ROWS):
                    some = mine[at : at + ROWS]
                    out[some] = np.array(model.classes)[model.probabilities(x[some], fold).argmax(1)]
            pred = pa.array([None if v != v else int(v) for v in out.tolist()], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pred], [*batch.schema.names[:-2], "pred"])

    return picked.mapInArrow(run, f"{kinds}, pred int").toDF(*[v.name for v in fields], name)
