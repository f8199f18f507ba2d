"""Gradient-boosted trees for counts: Poisson objective with a log link.

Rows are binned once (one byte a feature) and written. Each level of a tree is one pass: tasks sum
gradients, hessians and rows by (node, feature, bin) over their rows, a grouped aggregate adds the
sums up, and the driver picks each node's best split from at most 2**depth x features x bins sums.
Sums are taken over fixed-point numbers whose total stays below 2**53, so they are exact and the
trees don't depend on how rows are dealt to tasks. Every `REFRESH` trees the rows are written again
with their scores so far.

Bins are cut at quantiles of exact bucket counts. Missing values have a bin of their own and go to the side that gains more. Rows take part in a tree
by a hash of their id, so a repeated task draws alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfcast.session import scratch_folder

MAX_BINS = 64
REFRESH = 10
#: Rows whose cells are summed at a time.
TOGETHER = 1 << 17
#: Raw scores stay within this distance below the initial one, means below this multiple of the
#: largest label.
DEPTH, HEIGHT = 20.0, 64.0

#: A written row is a block of up to so many rows, each column one array's bytes.
BLOCK = 2048
KINDS = {"bins": np.uint8, "label": np.float64, "held": np.bool_, "rid": np.int64, "raw": np.float64}
ROWS = pa.schema([(name, pa.binary()) for name in KINDS])
ROWS_DDL = ", ".join(f"{name} binary" for name in KINDS)


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def add(self) -> int:
        for column, blank in ((self.feature, -1), (self.threshold, 0), (self.missing_left, True), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            column.append(blank)
        return len(self.feature) - 1

    def nodes(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of each row, of features x rows bins. Rows are told apart by one comparison of a
        whole column for each inner node."""
        small = np.uint8 if len(self.feature) <= 256 else np.int32
        at = np.zeros(columns.shape[1], dtype=small)
        inside = {0: np.ones(columns.shape[1], dtype=bool)}
        for node, feature in enumerate(self.feature):  # parents come before children
            rows = inside.pop(node)
            if feature < 0:
                at += rows.astype(small) * small(node)
                continue
            goes = columns[feature] <= self.threshold[node]
            if not self.missing_left[node]:
                goes &= columns[feature] != 0
            goes &= rows
            inside[self.left[node]], inside[self.right[node]] = goes, rows & ~goes
        return at


@dataclass
class Split:
    gain: float
    feature: int
    threshold: int
    missing_left: bool
    left: tuple[float, float]
    right: tuple[float, float]
    left_rows: float = 0.0


def best_split(
    gradient: np.ndarray, hessian: np.ndarray, count: np.ndarray, allowed: np.ndarray, l2: float, min_rows: int
) -> Split | None:
    """Of one node: arrays of features x bins; bin 0 holds missing values."""

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + l2)

    g, h = float(gradient[0].sum()), float(hessian[0].sum())
    best: Split | None = None
    for missing_left in (True, False):
        start = 0 if missing_left else 1
        gl, hl, nl = (np.cumsum(x[:, start:], axis=1) for x in (gradient, hessian, count))
        n = int(count[0].sum())
        ok = (nl >= min_rows) & (n - nl >= min_rows) & allowed[:, None]
        gain = np.where(ok, worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), -np.inf)
        place = int(gain.argmax())
        f, b = divmod(place, gain.shape[1])
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best.gain + 1e-12):
            left = (float(gl[f, b]), float(hl[f, b]))
            best = Split(float(gain[f, b]), f, b + start, missing_left, left, (g - left[0], h - left[1]), float(nl[f, b]))
    return best


class BoostedCounts:
    """A fitted model: bin edges, trees, gains."""

    def __init__(self, features: list[str], edges: list[np.ndarray], mean: float, top: float):
        self.features, self.edges, self.initial = features, edges, math.log(mean)
        self.limits = (self.initial - DEPTH, math.log(HEIGHT * max(mean, top)))
        self.trees: list[Tree] = []
        self.gains = np.zeros(len(features))
        self.valid_deviance: list[float] = []

    def bins(self, columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(columns[0]), len(columns)), dtype=np.uint8)
        for i, (values, edges) in enumerate(zip(columns, self.edges)):
            known = ~np.isnan(values)
            out[known, i] = 1 + np.searchsorted(edges, values[known], side="left")
        return out

    def raw(self, bins: np.ndarray, trees: list[Tree], start: np.ndarray | float) -> np.ndarray:
        out = np.zeros(len(bins)) + start
        columns = np.ascontiguousarray(bins.T)
        for tree in trees:
            out += np.array(tree.value)[tree.nodes(columns)]
        return np.clip(out, *self.limits)

    def predict(self, df: DataFrame, name: str = "y_pred") -> DataFrame:
        model = self

        @F.arrow_udf("double")
        def score(*columns: pa.Array) -> pa.Array:
            bins = model.bins([_numbers(c) for c in columns])
            return pa.array(np.exp(model.raw(bins, model.trees, model.initial)))

        return df.withColumn(name, score(*[_as_double(c) for c in self.features]))

    def importances(self) -> list[tuple[str, float]]:
        """Shares of the total gain, largest first."""
        total = self.gains.sum() or 1.0
        return sorted(zip(self.features, (self.gains / total).tolist()), key=lambda p: -p[1])


def _as_double(name: str) -> Column:
    value = F.col(name).cast("double")
    return F.when(~F.isnan(value), value)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)


#: Low bits of a double that a quantile bucket leaves out: buckets are 1/256 wide, relatively.
COARSE = 44


def value_buckets(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; close values share one."""
    bits = (values + 0.0).view(np.int64)  # + 0.0: minus zero is zero
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits) >> COARSE


def bin_edges(df: DataFrame, features: list[str], bins: int = MAX_BINS) -> list[np.ndarray]:
    """Up to `bins` - 2 cut points a feature at its quantiles: counts of value buckets, summed over all
    rows, so the same however rows are dealt. A cut point is the largest value of its bucket."""
    schema = pa.schema([("feature", pa.int32()), ("bucket", pa.int64()), ("n", pa.int64()), ("top", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_columns):
                values = np.sort(_numbers(b.column(i)))
                values = values[: np.searchsorted(values, np.nan)]  # missing ones sort last
                if len(values):
                    bucket = value_buckets(values)
                    last = np.flatnonzero(np.append(bucket[1:] != bucket[:-1], True))
                    columns = np.full(len(last), i, np.int32), bucket[last], np.diff(last, prepend=-1), values[last]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    found = df.select(*[_as_double(c).alias(f"x{i}") for i, c in enumerate(features)])
    found = found.mapInArrow(run, "feature int, bucket long, n long, top double")
    found = found.groupBy("feature", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))
    upward = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({"so_far": F.sum("n").over(upward), "whole": F.sum("n").over(Window.partitionBy("feature"))})
    # buckets in which a quantile falls: at most bins - 1 rows a feature
    marks = f"so_far * {bins - 1} div whole > (so_far - n) * {bins - 1} div whole"
    rows = found.filter(marks).select("feature", "top").collect()
    out: list[list[float]] = [[] for _ in features]
    for r in rows:
        out[r["feature"]].append(r["top"])
    return [np.unique(np.array(x, dtype=np.float64))[: bins - 1] for x in out]


class _Data:
    """The binned rows of a fit, and the passes over them."""

    def __init__(self, df: DataFrame, model: BoostedCounts, label: str, held: str, row_id: Column, parts: int):
        self.spark, self.model, self.turn, self.parts = df.sparkSession, model, 0, parts
        self.folder = f"{scratch_folder(self.spark)}/boosting"
        n = len(model.features)
        rows = df.select(
            *[_as_double(c).alias(f"x{i}") for i, c in enumerate(model.features)],
            F.col(label).cast("double").alias("label"), F.col(held).alias("held"), row_id.alias("rid"),
        ).filter(F.col("label").isNotNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = model.bins([_numbers(b.column(i)) for i in range(n)])
                rest = [b.column(n + i).to_numpy(zero_copy_only=False) for i in range(3)]
                yield from _batches(bins, *rest, np.full(len(bins), model.initial))

        self.rows = self._write(rows.mapInArrow(run, ROWS_DDL).coalesce(parts))  # few rows: few tasks

    def _write(self, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{self.turn}"
        self.turn += 1
        rows.write.parquet(path)
        return self.spark.read.schema(ROWS_DDL).parquet(path)

    def refresh(self, trees: list[Tree]) -> None:
        model = self.model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bins, label, held, rid, raw in _blocks(batches, model):
                yield from _batches(bins, label, held, rid, model.raw(bins, trees, raw))

        self.rows = self._write(self.rows.mapInArrow(run, ROWS_DDL))

    def sums(
        self, trees: list[Tree], tree: Tree, open_nodes: list[int], use: np.ndarray, scale: float, keep: int, salt: int
    ) -> tuple[np.ndarray, float, float]:
        """(3 x open nodes x features in use x bins sums, held-out deviance, held-out rows)."""
        model, bins_each = self.model, 1 + max(1, *(len(x) for x in self.model.edges))
        width = len(use) * bins_each
        place = {node: i for i, node in enumerate(open_nodes)}
        schema = pa.schema([("cell", pa.int64()), ("g", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros((3, len(place), len(use), bins_each), dtype=np.int64), np.zeros(3, dtype=np.int64)
            number = np.full(len(tree.feature), -1)
            number[list(place)] = list(place.values())
            waiting: list[tuple] = []

            def add() -> None:
                if waiting:
                    columns, slot, g, h = (np.concatenate(x, axis=-1) for x in zip(*waiting))
                    total[...] += cell_sums(columns, slot, (g, h, None), len(place), bins_each)
                    waiting.clear()

            for bins, label, held, rid, start in _blocks(batches, model):
                if len(tree.feature) == 1 and held.any():  # a new tree: how good were those before it
                    mean = np.exp(model.raw(bins[held], trees, start[held]))
                    loss[0] += int(np.rint(deviance(label[held], mean) * scale).sum())
                    loss[2] += int(held.sum())
                own = ~held & (_draw(rid, salt) < keep)
                bins, label, start = bins[own], label[own], start[own]
                slot = number[tree.nodes(np.ascontiguousarray(bins.T))]
                inside = slot >= 0
                bins, label = bins[inside], label[inside]
                mean = np.exp(model.raw(bins, trees, start[inside]))
                waiting.append((np.ascontiguousarray(bins[:, use].T), slot[inside], np.rint((mean - label) * scale), np.rint(mean * scale)))
                if sum(len(x[1]) for x in waiting) >= TOGETHER:
                    add()
            add()
            flat = total.reshape(3, -1)
            used = np.flatnonzero(flat[2])
            yield _sum_batch(schema, used, *flat[:, used])
            yield _sum_batch(schema, np.array([-1]), loss[:1], loss[1:2], loss[2:])

        found = self.rows.mapInArrow(run, "cell long, g long, h long, n long")
        if self.parts == 1:
            found = found.coalesce(1)  # spares the shuffle of a single task's sums
        table = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toArrow()
        cell, columns = table["cell"].to_numpy(), [table[c].to_numpy() for c in ("g", "h", "n")]
        out = np.zeros((3, len(open_nodes) * width))
        inner = cell >= 0
        for i, values in enumerate(columns):
            out[i, cell[inner]] = values[inner] / (1.0 if i == 2 else scale)
        rest = [float(c[~inner].sum()) for c in columns]
        return out.reshape(3, len(open_nodes), len(use), bins_each), rest[0] / scale, rest[2]


def cell_sums(columns: np.ndarray, slot: np.ndarray, weights: tuple, slots: int, bins: int) -> np.ndarray:
    """weights x slots x features x bins sums of whole numbers. Two features are counted at a time, by
    slot and both bins, and summed to one another's margins."""
    out = np.zeros((len(weights), slots, len(columns), bins), dtype=np.int64)
    base = slot.astype(np.int64) * bins
    for f in range(0, len(columns), 2):
        both = f + 1 < len(columns)
        at = base + columns[f]
        if both:
            at *= bins
            at += columns[f + 1]
        shape = (slots, bins, bins) if both else (slots, bins, 1)
        for i, w in enumerate(weights):
            found = np.bincount(at, w, math.prod(shape)).reshape(shape)
            out[i, :, f] = found.sum(axis=2)
            if both:
                out[i, :, f + 1] = found.sum(axis=1)
    return out


def _batches(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One block each: Spark hands over few large values instead of many small ones."""
    for lo in range(0, len(columns[0]), BLOCK):
        blocks = (np.ascontiguousarray(c[lo : lo + BLOCK], dtype=kind) for c, kind in zip(columns, KINDS.values()))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in blocks], schema=ROWS)


def _sum_batch(schema: pa.Schema, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], schema=schema)


def _blocks(batches: Iterator[pa.RecordBatch], model: BoostedCounts) -> Iterator[tuple[np.ndarray, ...]]:
    """bins (rows x features), label, held, rid, raw of each block."""
    for b in batches:
        for row in zip(*b.columns):
            bins, *rest = (np.frombuffer(x.as_buffer(), kind) for x, kind in zip(row, KINDS.values()))
            yield bins.reshape(-1, len(model.features)), *rest


def _draw(rid: np.ndarray, salt: int) -> np.ndarray:
    """A number below 1000 for each row and tree."""
    mixed = (rid.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(33)) % np.uint64(1000)


def deviance(label: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson deviance of each row."""
    log = np.where(label > 0, label * np.log(np.where(label > 0, label, 1.0) / mean), 0.0)
    return 2 * (log - (label - mean))


def fit_boosted_counts(
    train: DataFrame,
    valid: DataFrame,
    features: list[str],
    label: str,
    max_iter: int = 40,
    max_depth: int = 5,
    step: float = 0.1,
    l2: float = 1.0,
    min_rows: int = 20,
    row_share: float = 0.8,
    feature_share: float = 0.8,
    patience: int = 10,
    max_bins: int = MAX_BINS,
    seed: int = 42,
    row_key: list[str] | None = None,
    rows_per_part: int = 50_000,
) -> BoostedCounts:
    """Labels must not be negative; rows without a label are left out. Stops when the validation
    deviance hasn't fallen for `patience` trees and keeps the trees up to the best one."""
    facts = train.agg(
        F.count(label).alias("n"), F.avg(label).alias("mean"), F.max(F.col(label).cast("double")).alias("top"),
        F.min(F.col(label).cast("double")).alias("low"),
    ).first()
    if facts["n"] and facts["low"] < 0:
        raise ValueError("counts must not be negative")
    mean = max(facts["mean"] or 0.0, 1e-6)
    model = BoostedCounts(features, bin_edges(train, features, max_bins), mean, facts["top"] or 0.0)
    if not facts["n"] or not facts["top"]:
        return model
    rows = train.withColumn("_held", F.lit(False)).unionByName(valid.withColumn("_held", F.lit(True)))
    data = _Data(rows, model, label, "_held", F.xxhash64(*(row_key or features)), math.ceil(facts["n"] / rows_per_part))
    scale = 2.0 ** min(20, math.floor(math.log2(2.0**52 / ((HEIGHT * max(facts["top"], mean) + 1) * facts["n"]))))
    written, best, draw = 0, 0, np.random.default_rng(seed)
    for number in range(max_iter):
        if number - written == REFRESH:
            data.refresh(model.trees[written:])
            written = number
        allowed = np.zeros(len(features), dtype=bool)
        allowed[draw.permutation(len(features))[: max(1, round(feature_share * len(features)))]] = True
        tree, gains, open_nodes, use = Tree(), [], [0], np.flatnonzero(allowed)
        # of two siblings, the one of fewer rows is summed, the other is what its parent has besides
        asked, others = [0], {}
        for depth in range(max_depth):
            sums, loss, held = data.sums(model.trees[written:], tree, asked, use, scale, round(1000 * row_share), seed * 1009 + number)
            own = {node: sums[:, i] for i, node in enumerate(asked)}
            own |= {node: parent - own[sibling] for node, (parent, sibling) in others.items()}
            asked, others = [], {}
            if depth == 0:
                model.valid_deviance.append(loss / held if held else 0.0)
                if model.valid_deviance[-1] < model.valid_deviance[best] - 1e-12:
                    best = number
                g, h = own[0][0, 0].sum(), own[0][1, 0].sum()
                tree.value[0] = -step * g / (h + l2)
            following = []
            for node in open_nodes:
                split = best_split(*own[node], np.ones(len(use), dtype=bool), l2, min_rows)
                if split is None:
                    continue
                split.feature = int(use[split.feature])
                tree.feature[node], tree.threshold[node], tree.missing_left[node] = split.feature, split.threshold, split.missing_left
                for side, (g, h) in (("left", split.left), ("right", split.right)):
                    child = tree.add()
                    getattr(tree, side)[node] = child
                    tree.value[child] = -step * g / (h + l2)
                    following.append(child)
                fewer = following[-2:] if 2 * split.left_rows <= own[node][2, 0].sum() else following[:-3:-1]
                asked.append(fewer[0])
                others[fewer[1]] = own[node], fewer[0]
                gains.append((split.feature, split.gain))
            open_nodes = following
            if not open_nodes:
                break
        if held and number - best >= patience:
            break
        if not gains:
            break
        model.trees.append(tree)
        for f, gain in gains:
            model.gains[f] += gain
    else:
        _, loss, held = data.sums(model.trees[written:], Tree(), [0], np.arange(1), scale, 0, 0)
        if held and loss / held < model.valid_deviance[best] - 1e-12:
            best = len(model.trees)
        model.valid_deviance.append(loss / held if held else 0.0)
    if len(model.valid_deviance) > 1 and held:
        model.trees = model.trees[:best] if best else model.trees[:1]
    return model
