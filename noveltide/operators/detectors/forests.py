"""Isolation forests grown by Spark: samples drawn from all rows in one pass, trees grown in tasks by tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noveltide import session
from noveltide.operators.detectors.common import map_scores
from noveltide.operators.pivots import matrix

_GAMMA = 0.5772156649015329
#: The first draw aims at so many standard deviations over the rows wanted; where that isn't enough, it is doubled.
MARGIN = 8.0


def path_length(n: np.ndarray | float) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, "f8")
    m = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(m - 1) + _GAMMA) - 2 * (m - 1) / m))


class Tree:
    """An isolation tree as arrays: feature (-1 for a leaf), threshold, children, and path length at leaves."""

    def __init__(self, feature, threshold, left, right, path):
        self.feature, self.left, self.right = (np.asarray(v, "i4") for v in (feature, left, right))
        self.threshold, self.path = np.asarray(threshold, "f8"), np.asarray(path, "f8")

    @classmethod
    def grow(cls, x: np.ndarray, rng: np.random.Generator) -> Tree:
        """A tree over all rows of x: random features that vary, random thresholds inside their range, depth up to log2 of the rows."""
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        nodes: list[list] = [[], [], [], [], []]

        def add(x: np.ndarray, depth: int) -> int:
            node = len(nodes[0])
            for v, start in zip(nodes, (-1, 0.0, 0, 0, 0.0), strict=True):
                v.append(start)
            spread = np.flatnonzero(np.ptp(x, axis=0) > 0) if len(x) > 1 else np.zeros(0, int)
            if depth >= limit or not len(spread):
                nodes[4][node] = depth + float(path_length(len(x)))
                return node
            f = int(rng.choice(spread))
            t = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            below = x[:, f] < t
            nodes[0][node], nodes[1][node] = f, t
            nodes[2][node] = add(x[below], depth + 1)
            nodes[3][node] = add(x[~below], depth + 1)
            return node

        add(x, 0)
        return cls(*nodes)

    def walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Path length, and the mean distance of the row to the thresholds on its way."""
        node, away, steps = np.zeros(len(x), int), np.zeros(len(x)), np.zeros(len(x))
        rows = np.arange(len(x))
        while True:
            f = self.feature[node]
            go = f >= 0
            if not go.any():
                return self.path[node], away / np.maximum(steps, 1)
            gap = x[rows[go], f[go]] - self.threshold[node[go]]
            away[go] += np.abs(gap)
            steps[go] += 1
            node[go] = np.where(gap < 0, self.left[node[go]], self.right[node[go]])


def draw(train: DataFrame, samples: int, rows: int, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """(sample, place, row_id, features): `rows` distinct rows for each of `samples` numbers, or all where there are fewer.

    Each row has a key for each sample, -ln(u) / weight, u by hash of seed, sample and row id (Efraimidis and Spirakis); a sample is
    the rows of the least keys, numbered from 1 by `place`. All rows are looked at in one pass without a shuffle, which keeps the few
    under a bound that total weight and `rows` give; where a sample comes out short, the bound is doubled. Rows with a
    weight of 0 or null aren't drawn. The result is written to the shared folder.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    base = train.select(F.col("row_id").cast("long").alias("row_id"), F.col("features").cast("array<double>").alias("features"), w.alias("w")).where("w > 0")
    n, total = base.agg(F.count("*"), F.sum("w")).first()
    want = min(rows, n)
    if not want:
        return base.select(F.lit(0).alias("sample"), F.lit(0).alias("place"), "row_id", "features").limit(0)
    # The chance of a key under the bound is 1 - exp(-w * bound), so about total * bound rows of small weight are kept.
    bound = (want + MARGIN * want**0.5 + MARGIN**2) / total
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("sample"), F.col("row_id")), 11).cast("double") + 0.5) / float(1 << 53)
    keys = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample")).withColumn("key", -F.log(unit) / F.col("w"))
    while True:
        # No key is over 38 / w, as u is 2 ** -54 at least; weights may lie far apart.
        kept = session.materialize(keys.where(F.col("key") < bound), "forest-samples")
        if kept.groupBy("sample").agg(F.count("*").alias("n")).where(F.col("n") >= want).count() == samples:
            break
        session.discard(kept)
        bound *= 2
    packed = kept.groupBy("sample").agg(F.slice(F.array_sort(F.collect_list(F.struct("key", "row_id", "features"))), 1, want).alias("rows"))
    return packed.select("sample", F.posexplode("rows").alias("p", "r")).select("sample", (F.col("p") + 1).alias("place"), "r.row_id", "r.features")


_TREE = "sample int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"
_FIELDS = pa.schema([("sample", pa.int32()), ("feature", pa.list_(pa.int32())), ("threshold", pa.list_(pa.float64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())), ("path", pa.list_(pa.float64()))])


def grow(drawn: DataFrame, seed: int = 42, represent: Callable[[np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(sample, feature, threshold, left, right, path): a tree for each sample of `draw`, grown in the sample's task from a generator of seed and sample.

    `represent(rows, sample)` maps the rows before.
    """
    session.ship(drawn.sparkSession)

    def one(rows: pa.Table) -> pa.Table:
        k = rows["sample"][0].as_py()
        order = np.argsort(rows["place"].to_numpy())
        x = matrix(rows["features"])[order]
        t = Tree.grow(x if represent is None else represent(x, k), np.random.default_rng([seed, k]))
        return pa.Table.from_pylist([{"sample": k, "feature": t.feature.tolist(), "threshold": t.threshold.tolist(), "left": t.left.tolist(), "right": t.right.tolist(), "path": t.path.tolist()}], _FIELDS)

    return drawn.groupBy("sample").applyInArrow(one, _TREE)


def collected(grown: DataFrame) -> list[Tree]:
    """The trees by sample. A forest has a row a tree, of fewer than twice the sample's rows nodes, whatever the table."""
    return [Tree(r.feature, r.threshold, r.left, r.right, r.path) for r in sorted(grown.collect(), key=lambda r: r.sample)]


class Forest(NamedTuple):
    """An isolation forest, and how many rows each of its trees has seen."""

    trees: list[Tree]
    sample: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path)."""
        return 2 ** (-np.mean([t.walk(x)[0] for t in self.trees], 0) / max(float(path_length(self.sample)), 1e-12))


def fit_forest(train: DataFrame, members: int = 100, sample: int = 256, seed: int = 42) -> Forest:
    drawn = draw(train, members, sample, seed)
    drawn = session.materialize(drawn, "forest")
    sizes = drawn.groupBy("sample").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if not sizes:
        raise ValueError("no rows to fit on")
    return Forest(collected(grow(drawn, seed)), sizes)


def isolation_forest(test: DataFrame, train: DataFrame, trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """(row_id, score): 2 ** (-mean path / expected path); each tree sees `sample` rows drawn from all of `train`."""
    session.ship(test.sparkSession)
    sent = test.sparkSession.sparkContext.broadcast(tuple(fit_forest(train, trees, sample, seed)))
    return map_scores(test, lambda x: Forest(*sent.value).score(x))


class Representation(NamedTuple):
    """Random tanh nets that share weights and differ by vectors on inputs and outputs of each layer."""

    shared: list[np.ndarray]
    vectors: list[list[tuple[np.ndarray, np.ndarray]]]

    @classmethod
    def make(cls, d: int, members: int, hidden: tuple[int, ...], out: int, rng: np.random.Generator) -> Representation:
        sizes = [d, *hidden, out]
        pairs = list(zip(sizes[:-1], sizes[1:], strict=True))
        return cls([rng.normal(0, 1, (a, b)) / np.sqrt(a) for a, b in pairs], [[(rng.normal(1, 0.5, a), rng.normal(1, 0.5, b)) for a, b in pairs] for _ in range(members)])

    def __call__(self, x: np.ndarray, member: int) -> np.ndarray:
        for w, (r, s) in zip(self.shared, self.vectors[member], strict=True):
            x = np.tanh(((x * r) @ w) * s)
        return x


def _moments(train: DataFrame, net: Representation, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each member's representation over all rows: sums per task about the first row's, added up by Spark."""
    sent = train.sparkSession.sparkContext.broadcast(tuple(net))
    members = len(net.vectors)
    first = np.array(train.select(F.col("features").cast("array<double>")).first()[0])[None]
    base = np.concatenate([net(first, k)[0] for k in range(members)])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, s, q = Representation(*sent.value), 0, np.zeros(members * out), np.zeros(members * out)
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                x = matrix(b.slice(a, 1000).column(0))
                z = np.concatenate([own(x, k) for k in range(members)], axis=1) - base
                n, s, q = n + len(x), s + z.sum(0), q + (z * z).sum(0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s)), pa.int32()), pa.array(np.full(len(s), n)), pa.array(s), pa.array(q)], ["i", "n", "s", "q"])

    parts = train.select(F.col("features").cast("array<double>").alias("x")).mapInArrow(partial, "i int, n long, s double, q double")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").collect()  # members * out rows
    n, s, q = (np.array([r[c] for r in rows], "f8") for c in ("n", "s", "q"))
    std = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
    return (base + s / n).reshape(members, out), std.reshape(members, out) + 1e-9


def deep_isolation_forest(test: DataFrame, train: DataFrame, members: int = 50, trees: int = 6, sample: int = 256, hidden: tuple[int, ...] = (500, 100), out: int = 20, seed: int = 42) -> DataFrame:
    """Isolation forests on random tanh representations; path scores times the mean deviation on the way, averaged over members.

    Representations are standardised by the moments of all training rows, never by the scored batch. Each of
    the members * trees trees sees `sample` rows drawn from all of `train`, mapped and grown in the tree's task.
    """
    session.ship(test.sparkSession)
    head = train.select("features").first()
    if head is None:
        raise ValueError("no rows to fit on")
    net = Representation.make(len(head[0]), members, hidden, out, np.random.default_rng(seed))
    mean, std = _moments(train, net, out)
    context = test.sparkSession.sparkContext
    sent = context.broadcast((tuple(net), mean, std))

    def represent(x: np.ndarray, member: int) -> np.ndarray:
        own, m, s = sent.value
        return np.tanh((Representation(*own)(x, member) - m[member]) / s[member])

    drawn = session.materialize(draw(train, members * trees, sample, seed), "deep-forest")
    seen = drawn.groupBy("sample").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    grown = collected(grow(drawn, seed, lambda x, k: represent(x, k // trees)))
    forest = context.broadcast([grown[k * trees : (k + 1) * trees] for k in range(members)])
    expected = max(float(path_length(seen)), 1e-12)

    def score(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for k, own in enumerate(forest.value):
            z = represent(x, k)
            walks = [t.walk(z) for t in own]
            total += 2 ** (-np.mean([w[0] for w in walks], 0) / expected) * np.mean([w[1] for w in walks], 0)
        return total / members

    return map_scores(test, score)
