"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

The model gives every block node the probability that it holds main text. The decoder then picks the labelling of the
whole tree with the best total log-probability under which nothing below a dropped node is kept, so an ancestor and its
descendants never contradict each other. The fitting sample is bounded: ``TRAIN_PAGES`` generated pages.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches
from webquire.llm.dom_tree import decode, features, kept_text, labels, parse
from webquire.llm.sample_pages import labelled_pages

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN_PAGES = 1_500
TREES, DEPTH, RATE = 60, 5, 0.25
BINS = 16
# Nodes scored at once.
GROUP_NODES = 20_000


@dataclass
class Boosted:
    """Complete trees as arrays: ``feature`` and ``cut`` of the inner nodes, ``leaf`` values."""

    bias: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            while at.size and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            z += leaf[at - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, l2: float = 2.0, share: float = 0.4, seed: int = 3) -> Boosted:
    """Newton boosting of the logistic loss on histograms; all nodes of a level split together.

    Each tree looks for its splits on a random ``share`` of the rows and sets its leaves by all of them.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(q, c, "left") for q, c in zip(cuts, x.T)], axis=1)  # code > b  <=>  x > cuts[b]
    n, m = x.shape
    inner = (1 << depth) - 1
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    z = np.full(n, bias)
    out = Boosted(bias, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    cells = np.arange(m) * (bins + 1)
    rng = np.random.default_rng(seed)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, dtype=np.int64)
        some = np.flatnonzero(rng.random(n) < share)
        part, g_part, h_part = cells + code[some], np.repeat(g[some], m), np.repeat(h[some], m)
        for d in range(depth):
            first, width = (1 << d) - 1, 1 << d
            slot = ((at[some] - first)[:, None] * (m * (bins + 1)) + part).ravel()
            size = width * m * (bins + 1)
            gs = np.bincount(slot, g_part, size).reshape(width, m, bins + 1).cumsum(axis=2)
            hs = np.bincount(slot, h_part, size).reshape(width, m, bins + 1).cumsum(axis=2)
            gt, ht = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            gain[(hs < 1) | (ht - hs < 1)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, c = divmod(int(b), bins + 1)
                if gain[k, f, c] > 1e-6 and c < len(cuts[f]):
                    out.feature[t, first + k], out.cut[t, first + k] = f, cuts[f][c]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t, at]] > out.cut[t, at])
        leaf = at - inner
        out.leaf[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        z += out.leaf[t][leaf]
    return out


@lru_cache(maxsize=2)
def trained(pages: int = TRAIN_PAGES, seed: int = 1) -> Boosted:
    """The model of ``pages`` generated pages."""
    parsed = [parse(p) for p in labelled_pages(pages, seed)]
    return fit(np.concatenate([features(p) for p in parsed]), np.concatenate([labels(p) for p in parsed]))


def extract(texts: list[str], model: Boosted) -> list[str]:
    """Main texts of pages."""
    out, group, nodes = [], [], 0

    def close() -> None:
        if group:
            p = model.predict(np.concatenate([features(page) for page in group]))
            at = 0
            for page in group:
                out.append(kept_text(page, decode(page, p[at : at + len(page.nodes)])))
                at += len(page.nodes)
            group.clear()

    for text in texts:
        group.append(parse(text))
        nodes += len(group[-1].nodes)
        if nodes >= GROUP_NODES:
            close()
            nodes = 0
    close()
    return out


def main_text(pages: DataFrame, html_col: str = "html", model: Boosted | None = None) -> DataFrame:
    """``pages`` without ``html_col`` and with ``text`` and ``n_chars``, which replace columns of these names.

    A null or empty html gives an empty text; pages without main text too. Rows are independent, so repeated ones give
    equal results. An empty table gives no rows.
    """
    model = model or trained()
    bounded_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    schema = StructType([*(pages.schema[c] for c in kept), *StructType.fromDDL("text string, n_chars long")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = extract([h.as_py() or "" for h in batch.column(html_col)], model)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], schema=arrow)

    return pages.select(*kept, html_col).mapInArrow(run, schema)
