"""Toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms: lower-cased words and their first four and five letters. The score is
``sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>)``: an additive weight for each term and a learned interaction for
each pair, so a mention next to an insult can count for more than both alone.

The machine is fitted on a bounded sample of labelled rows: ``train_rows`` documents, those with the smallest hash of
their id. Terms enter it when their presence separates the classes by at least ``min_z`` standard errors. The fitted
model has at most ``max_terms`` terms and goes to the executors with the scoring function.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 20
TRAIN_ROWS = 8_000
MAX_TERMS = 4_096
MIN_Z = 5.0
FACTORS = 8
THRESHOLD = 0.3
# Words whose terms a scoring task remembers.
MEMO = 1 << 18

_letters = re.compile(r"[^\W\d_]+").findall


def word_terms(word: str) -> tuple[int, ...]:
    """Hash buckets of a lower-cased word's terms."""
    keys = {"=" + word, "4" + word[:4], "5" + word[:5]} if len(word) > 3 else {"=" + word}
    return tuple(zlib.crc32(k.encode("utf-8", "surrogatepass")) % BUCKETS for k in sorted(keys))


def text_terms(text: str | None) -> list[int]:
    """The set of a text's buckets, sorted."""
    return sorted({t for w in set(_letters((text or "").lower())) for t in word_terms(w)})


@dataclass
class Machine:
    """A fitted model: ``index`` maps a bucket to its row in ``w`` and ``v``."""

    index: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, terms: list[int]) -> float:
        """Probability of the class; ``terms`` are rows of the model."""
        z = self.bias
        if terms:
            v = self.v[terms]
            z += float(self.w[terms].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select_terms(rows: list[np.ndarray], labels: np.ndarray, min_z: float, max_terms: int) -> np.ndarray:
    """Buckets whose presence differs between the classes by ``min_z`` standard errors, the strongest ``max_terms``."""
    pos, neg = (np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == k] or [np.zeros(0, np.int64)]), minlength=BUCKETS) for k in (1, 0))
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))
    share = (pos + neg + 1) / (n1 + n0 + 2)
    z = np.abs(pos / n1 - neg / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    z[pos + neg < 3] = 0
    best = np.argsort(-z, kind="stable")[:max_terms]
    return np.sort(best[z[best] >= min_z])


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, steps: int = 2_400, rate: float = 0.3, l2: float = 1e-5, l2_pairs: float = 3e-4, min_z: float = MIN_Z, max_terms: int = MAX_TERMS, positive: float = 2.0, seed: int = 5) -> Machine:
    """Fit by Adagrad on the logistic loss, where a row of class 1 counts ``positive`` times.

    One class only gives its base rate; no rows give a score near 0.
    """
    if not len(labels) or labels.min() == labels.max():
        rate_of = (labels.sum() + 1e-3) / (len(labels) + 1) if len(labels) else 1e-6
        return Machine({}, float(np.log(rate_of / (1 - rate_of))), np.zeros(0), np.zeros((0, factors)))
    kept = select_terms(rows, labels, min_z, max_terms)
    index = {int(b): i for i, b in enumerate(kept)}
    known = [np.searchsorted(kept, r[np.isin(r, kept)]) for r in rows]
    rng = np.random.default_rng(seed)
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    w, v = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), factors))
    gb, gw, gv = 1e-8, np.full(len(kept), 1e-8), np.full(v.shape, 1e-8)
    for _ in range(-(-steps * 256 // max(256, len(rows)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            size = np.array([len(known[i]) for i in part])
            flat, row = np.concatenate([known[i] for i in part]), np.repeat(np.arange(len(part)), size)
            s, q, lin = np.zeros((len(part), factors)), np.zeros((len(part), factors)), np.zeros(len(part))
            np.add.at(s, row, v[flat])
            np.add.at(q, row, v[flat] ** 2)
            np.add.at(lin, row, w[flat])
            z = bias + lin + 0.5 * (s**2 - q).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) * np.where(labels[part] == 1, positive, 1.0) / len(part)
            dw, dv = l2 * w, l2_pairs * v
            np.add.at(dw, flat, g[row])
            np.add.at(dv, flat, g[row, None] * (s[row] - v[flat]))
            gb, gw, gv = gb + g.sum() ** 2, gw + dw**2, gv + dv**2
            bias -= rate * g.sum() / np.sqrt(gb)
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
    return Machine(index, bias, w, v)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text leaves remainder 2 by 4. A null id is not held out."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the ``train_rows`` labelled ids of ``labels`` with the smallest hash, without the held-out ones.

    Of an id with several labels the largest counts; null labels and ids are passed over; of several texts for an id all
    are used.
    """
    bounded_batches(docs.sparkSession)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    chosen = ids.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)  # bounded, so it may be broadcast
    schema = StructType.fromDDL("key long, y int, terms array<int>")
    arrow = to_arrow_schema(schema)

    def hash_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = pa.array([text_terms(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms], schema=arrow)

    rows = docs.join(F.broadcast(chosen), docs[id_col] == chosen["__id"]).select(F.coalesce(F.col(id_col).try_cast("long"), F.xxhash64(id_col)).alias("key"), F.col("__y").alias("y"), text_col)
    got = rows.mapInArrow(hash_terms, schema).toArrow().sort_by([("key", "ascending"), ("y", "ascending")])
    terms = got.column("terms").combine_chunks()
    flat, ends = terms.values.to_numpy(zero_copy_only=False).astype(np.int64), terms.offsets.to_numpy()
    return fit([flat[a:b] for a, b in zip(ends, ends[1:])], got.column("y").to_numpy().astype(np.int64))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1) and ``predicted_col`` (1 if the score reaches ``threshold``), which replace columns of these names.

    Only the text enters a score; a null or empty text gets the model's bias. Every row is scored, repeated and null ids
    included. Without usable labels all scores are near 0. An empty table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, label_col, train_rows)
    docs = docs.drop(score_col, predicted_col)
    schema = StructType([*docs.schema, *StructType.fromDDL(f"`{score_col}` double, `{predicted_col}` int")])
    arrow = to_arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for text in batch.column(text_col):
                found: set[int] = set()
                for word in set(_letters((text.as_py() or "").lower())):
                    known = memo.get(word)
                    if known is None:
                        if len(memo) >= MEMO:
                            memo.clear()
                        known = memo[word] = tuple(model.index[t] for t in word_terms(word) if t in model.index)
                    found.update(known)
                scores.append(model.score(sorted(found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], schema=arrow)

    return docs.mapInArrow(judge, schema)
