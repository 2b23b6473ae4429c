"""What the two classifiers share: held-out rows, bounded labelled samples, isotonic regression, boosted trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each label that a classifier is fitted on at most, and bytes of text of each such row. The rows are
#: the first by a hash of the id. Scores cover all rows and whole texts.
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 40_000


def remainder(id_col: Column, m: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % m


def sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS) -> tuple[pd.DataFrame, float]:
    """(doc_id, text, y) of at most ``rows`` labelled rows of each label for which ``keep`` holds, in a fixed order, and
    the share of label 1 among all those rows."""
    lab = labels.where(keep & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__i"), F.col(label).cast("int").alias("y"))
    share = lab.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("__i"), F.col("__i"), F.col("y")]
    some = lab.where("y = 0").orderBy(*order).limit(rows).unionByName(lab.where("y = 1").orderBy(*order).limit(rows))
    got = docs.select("doc_id", "text").join(F.broadcast(some), docs["doc_id"] == F.col("__i")).where(F.octet_length("text") <= SAMPLE_BYTES)
    got = got.groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # rows that repeat an id count once
    out = got.select("doc_id", "text", "y", F.xxhash64("doc_id").alias("h")).toPandas()
    return out.sort_values(["h", "doc_id", "y", "text"], kind="stable").drop_duplicates("text").reset_index(drop=True), share


def label_weights(y: np.ndarray, share: float | None) -> np.ndarray:
    """Weights that give label 1 the share it has among all labels."""
    if share is None or not 0 < y.mean() < 1:
        return np.ones(len(y))
    return np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))


def without_copies(df: pd.DataFrame) -> pd.DataFrame:
    """One row of those that share a stretch of text at their start or middle."""
    for key in (df["text"].str[:40], df["text"].map(lambda t: t[len(t) // 2 : len(t) // 2 + 40])):
        df = df[~(key.loc[df.index].duplicated() & (df["text"].str.len() >= 80))]
    return df.reset_index(drop=True)


class Isotonic:
    """Pool-adjacent-violators on (x, y): a level for each pool, a slope in the gaps between pools, and a hundredth of the
    logistic curve, so that x keep their order inside a pool; between 0 and 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None):
        order = np.argsort(x, kind="stable")
        xs, ys, ws = x[order].astype(float), y[order].astype(float), (np.ones(len(x)) if weight is None else weight[order])
        blocks: list[list[float]] = []
        for a, b, w in zip(xs, ys, ws, strict=True):
            blocks.append([b * w, w, a, a])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                good, w, _, end = blocks.pop()
                blocks[-1] = [blocks[-1][0] + good, blocks[-1][1] + w, blocks[-1][2], end]
        self.x = np.array([edge for b in blocks for edge in b[2:]] or [0.0])
        self.y = np.repeat([(b[0] + 0.5) / (b[1] + 1) for b in blocks], 2) if blocks else np.array([0.5])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 0.99 * np.clip(np.interp(x, self.x, self.y), 0.0, 1.0) + 0.01 / (1 + np.exp(-np.clip(x, -30, 30)))


class Logistic:
    """Logistic regression on standardised inputs, by Newton steps with a slight pull to zero; gives the margin."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, pull: float = 1e-3, steps: int = 50):
        self.mid, self.width = x.mean(0), x.std(0) + 1e-9
        z, weight = self._inputs(x), weight / weight.sum()
        self.w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            slope = z.T @ (weight * (p - y)) + pull * self.w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + pull * np.eye(len(self.w))
            step = np.linalg.solve(curve, slope)
            self.w -= step
            if np.abs(step).max() < 1e-9:
                break

    def _inputs(self, x):
        return np.concatenate([np.ones((len(x), 1)), (x - self.mid) / self.width], 1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._inputs(x) @ self.w


class Boosted:
    """Gradient-boosted trees of depth 3 on quantile bins, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 80, rate: float = 0.15, depth: int = 3, bins: int = 32, least: float = 8.0):
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
        b = self._bin(x)
        p = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base, self.rate, self.trees = float(np.log(p / (1 - p))), rate, []
        f = np.full(len(y), self.base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-f))
            g, h = weight * (y - q), weight * q * (1 - q)
            node = np.zeros(len(y), int)
            tree = []
            for _level in range(depth):
                tree.append({n: self._split(b, g, h, node == n, least) for n in np.unique(node).tolist()})
                node = self._step(b, node, tree[-1])
            leaf = {n: rate * g[node == n].sum() / (h[node == n].sum() + 1.0) for n in np.unique(node).tolist()}
            self.trees.append((tree, leaf))
            f += np.array([leaf[n] for n in node.tolist()])

    def _bin(self, x):
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1)

    @staticmethod
    def _split(b, g, h, rows, least):
        best = (1e-6, 0, 10**6)
        gs, hs = g[rows], h[rows]
        for k in range(b.shape[1]):
            c = b[rows, k]
            if len(c) < 2:
                continue
            gl, hl = np.cumsum(np.bincount(c, gs)), np.cumsum(np.bincount(c, hs))
            gr, hr = gl[-1] - gl, hl[-1] - hl
            n = np.cumsum(np.bincount(c))
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - gl[-1] ** 2 / (hl[-1] + 1)
            gain[(n < least) | (n[-1] - n < least)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (float(gain[i]), k, i)
        return best[1:]

    @staticmethod
    def _step(b, node, level):
        out = node * 2
        for n, (k, cut) in level.items():
            rows = node == n
            out[rows] += (b[rows, k] > cut).astype(int)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        f = np.full(len(x), self.base)
        for tree, leaf in self.trees:
            node = np.zeros(len(x), int)
            for level in tree:
                node = self._step(b, node, level)
            f += np.array([leaf.get(n, 0.0) for n in node.tolist()])
        return f
