"""An honest forest of effects, grown and read as Spark aggregates, with row-wise errors from bags of trees.

Outcome and treatment are residuals of cross-fitted models. Every bag draws half of the rows by a hash of
the key, and each of its trees deals that half in two: one part chooses the splits, the other fills
the leaves. All trees grow together, a level a pass: tasks add up histograms of (tree, node, covariate,
bin), the best split of each node is picked where its histogram meets, and only splits reach the driver.
A row is read by the trees of the bags that haven't drawn it; how much bag means differ beyond what
trees within a bag do is its error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.storage import checkpointed

BAGS, PER_BAG, DEPTH, BINS = 120, 4, 4, 32
#: Rows that all trees read at once.
AT_ONCE = 1000
#: A child has so many growing rows at least, and so large a share of its parent's.
LEAST_ROWS, LEAST_SHARE = 5, 0.05


def _uniform(h: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each hash, another for each seed."""
    x = h.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53


@dataclass
class Forest:
    """Trees in heap order (node k has children 2k and 2k + 1): the covariate (-1: leaf) and the last bin that goes left."""

    xs: list[str]
    edges: list[np.ndarray]
    bags: int
    per_bag: int
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    sums: np.ndarray | None = None

    def codes(self, b: pd.DataFrame) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, b[c].to_numpy(float), "left") for c, e in zip(self.xs, self.edges, strict=True)])

    def part(self, h: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that grow a tree, and rows that fill it."""
        drawn, grows = _uniform(h, tree // self.per_bag) < 0.5, _uniform(h, 10_000 + tree) < 0.5
        return drawn & grows, drawn & ~grows

    def nodes(self, codes: np.ndarray, tree: int, steps: int) -> np.ndarray:
        """The node of each row after so many steps; rows stay in leaves."""
        at, rows = np.ones(len(codes), np.int64), np.arange(len(codes))
        for _ in range(steps):
            f = self.feature[tree, at]
            right = codes[rows, np.maximum(f, 0)] > self.cut[tree, at]
            at = np.where(f < 0, at, 2 * at + right)
        return at


def _level(d: DataFrame, forest: Forest, level: int) -> list:
    """(tree, node, covariate, cut) of the best split of each node of a level."""
    width, p = 1 << level, len(forest.xs)
    size = p * BINS

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = forest.bags * forest.per_bag
        total = np.zeros((3, trees, width * size))
        for b in batches:
            codes, h = forest.codes(b), b["h"].to_numpy()
            tt, ty = b["wt"].to_numpy() ** 2, b["wt"].to_numpy() * b["wy"].to_numpy()
            for t in range(trees):
                rows = np.flatnonzero(forest.part(h, t)[0])
                node = forest.nodes(codes[rows], t, level)
                rows, node = rows[node >= width], node[node >= width] - width
                cells = ((node * size)[:, None] + np.arange(p) * BINS + codes[rows]).ravel()
                for k, w in enumerate((None, tt, ty)):
                    total[k, t] += np.bincount(cells, None if w is None else np.repeat(w[rows], p), width * size)
        yield pd.DataFrame({"tree": np.arange(trees), "h": [total[:, t].tobytes() for t in range(trees)]})

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        n, tt, ty = sum(np.frombuffer(x) for x in rows["h"]).reshape(3, width, p, BINS)
        every, total = n[:, :1].sum(axis=2, keepdims=True), tt[:, :1].sum(axis=2, keepdims=True)
        effect = ty[:, :1].sum(axis=2, keepdims=True) / np.maximum(total, 1e-300)
        # how far the children's effects are from the node's, by the gradients of its equation
        gap = np.cumsum(ty - effect * tt, axis=2)
        left = np.cumsum(n, axis=2)
        right = every - left
        least = np.maximum(LEAST_ROWS, LEAST_SHARE * every)
        gain = np.where((left >= least) & (right >= least), gap**2 / np.maximum(left, 1) + gap**2 / np.maximum(right, 1), 0.0).reshape(width, size)
        best = gain.argmax(axis=1)
        node = np.flatnonzero(gain[np.arange(width), best] > 0)
        return pd.DataFrame({"tree": int(rows["tree"].iloc[0]), "node": node + width, "feature": best[node] // BINS, "cut": best[node] % BINS})

    return d.mapInPandas(add, "tree int, h binary").groupBy("tree").applyInPandas(choose, "tree int, node int, feature int, cut int").collect()


def grow(d: DataFrame, xs: list[str], bags: int = BAGS, per_bag: int = PER_BAG, depth: int = DEPTH) -> Forest:
    """The forest of d (h, xs, wt, wy: hash of the key, covariates, residuals of treatment and outcome)."""
    shares = [k / BINS for k in range(1, BINS)]
    edges = [np.unique(q) for q in d.agg(*[F.percentile_approx(c, shares, 10_000) for c in xs]).first()]
    trees, size = bags * per_bag, 1 << (depth + 1)
    forest = Forest(xs, edges, bags, per_bag, depth, np.full((trees, size), -1), np.zeros((trees, size), int))
    for level in range(depth):
        splits = _level(d, forest, level)
        if not splits:
            break
        for r in splits:
            forest.feature[r["tree"], r["node"]], forest.cut[r["tree"], r["node"]] = r["feature"], r["cut"]

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((3, trees, size))
        for b in batches:
            codes, h = forest.codes(b), b["h"].to_numpy()
            tt, ty = b["wt"].to_numpy() ** 2, b["wt"].to_numpy() * b["wy"].to_numpy()
            for t in range(trees):
                rows = np.flatnonzero(forest.part(h, t)[1])
                node = forest.nodes(codes[rows], t, depth)
                for k, w in enumerate((None, tt, ty)):
                    total[k, t] += np.bincount(node, None if w is None else w[rows], size)
        t, k = np.nonzero(total[0])
        yield pd.DataFrame({"tree": t, "node": k, "n": total[0, t, k], "tt": total[1, t, k], "ty": total[2, t, k]})

    made = d.mapInPandas(fill, "tree int, node int, n double, tt double, ty double").groupBy("tree", "node").agg(*[F.sum(c).alias(c) for c in ("n", "tt", "ty")])
    sums = np.zeros((3, trees, size))
    for r in made.collect():  # as many as there are leaves
        sums[:, r["tree"], r["node"]] = r["n"], r["tt"], r["ty"]
    for node in range(size // 2 - 1, 0, -1):  # a leaf that nothing fills is read as its parent
        sums[:, :, node] += sums[:, :, 2 * node] + sums[:, :, 2 * node + 1]
    for node in range(2, size):
        none = sums[1, :, node] <= 0
        sums[:, none, node] = sums[:, none, node // 2]
    forest.sums = sums
    return forest


def read(d: DataFrame, key: str, forest: Forest) -> DataFrame:
    """(key, cate, se) of every row of d, by trees whose bag has not drawn it."""
    kind = d.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # every tree's figures of a row are held at once, so few rows are read together
        for b in (b.iloc[at : at + AT_ONCE] for b in batches for at in range(0, len(b), AT_ONCE)):
            codes, h = forest.codes(b), b["h"].to_numpy()
            n = len(b)
            top, under = np.zeros((forest.bags, forest.per_bag, n)), np.zeros((forest.bags, forest.per_bag, n))
            for t in range(forest.bags * forest.per_bag):
                count, tt, ty = forest.sums[:, t, forest.nodes(codes, t, forest.depth)]
                top[t // forest.per_bag, t % forest.per_bag] = ty / np.maximum(count, 1)
                under[t // forest.per_bag, t % forest.per_bag] = tt / np.maximum(count, 1)
            out = np.stack([_uniform(h, g) >= 0.5 for g in range(forest.bags)])
            bags = np.maximum(out.sum(0), 1)
            mean = lambda x: np.where(out, x.mean(1), 0.0).sum(0) / bags
            base = np.maximum(mean(under), 1e-12)
            cate = mean(top) / base
            psi = (top - cate * under) / base
            between = np.where(out, psi.mean(1) ** 2, 0.0).sum(0) / bags
            within = np.where(out, psi.var(1), 0.0).sum(0) / bags
            # what the chance of a bag's own few trees adds to its mean is taken off; what chance leaves in the mean of all bags is added
            variance = np.maximum(between - within / max(forest.per_bag - 1, 1), 0.0) + between / bags
            yield pd.DataFrame({key: b[key], "cate": cate, "se": np.sqrt(variance)})

    return d.mapInPandas(work, f"`{key}` {kind}, cate double, se double")


def honest_effects(rows: DataFrame, key: str, xs: list[str], treatment: str, outcome: str, mean: str, chance: str, bags: int = BAGS, per_bag: int = PER_BAG, depth: int = DEPTH) -> DataFrame:
    """(key, cate, se, score) of rows with mean and chance, the cross-fitted outcome and treatment given xs.

    score is the row's doubly robust effect around the forest's; its mean over any rows is their average effect.
    """
    wt, wy = F.col(treatment) - F.col(chance), F.col(outcome) - F.col(mean)
    d = checkpointed(rows.select(F.col(key), F.xxhash64(key).alias("h"), *xs, wt.alias("wt"), wy.alias("wy"), F.col(chance).alias("_e")))
    got = read(d.drop("_e"), key, grow(d.select("h", *xs, "wt", "wy"), xs, bags, per_bag, depth))
    e = F.col("_e")
    score = F.col("cate") + F.col("wt") / (e * (1 - e)) * (F.col("wy") - F.col("wt") * F.col("cate"))
    return got.join(d.select(key, "wt", "wy", "_e"), key).select(key, "cate", "se", score.alias("score"))
