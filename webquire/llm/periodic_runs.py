"""Periodic runs of words inside a text, by seeds on diagonals.

A run is a maximal stretch of words in which words ``q`` apart are equal, ``q`` being its smallest period, and whose
length is at least ``LEAST`` words and ``COPIES`` periods. On the diagonal of lag ``q`` (position ``i`` against
``i + q``) such a run is a stretch of at least ``max(LEAST - q, 2 q)`` equal pairs. So lags are taken in scales: for
lags below 16 every run holds a pair of equal 16-grams at its lag, and for lags from ``K / 2`` to ``K - 1`` a pair of
equal ``K``-grams. The grams of each scale are named by doubling, so equal names mean equal grams.

Of the occurrences of a gram only the next three are paired. That loses no run. Let ``w`` be a ``K``-gram inside a run
of period ``q < K``. If ``q <= K / 2``, the smallest period of ``w`` is ``q`` (Fine and Wilf), so the next occurrence of
``w`` is ``q`` words on. Otherwise some window of the run has a smallest period above ``K / 4``: if all had smaller ones
they would share it, and the run would have it too. Occurrences of that window that overlap are more than ``K / 4``
apart, so the one ``q < K`` words on is at most the third.

A pair is extended along its diagonal to both sides until words differ. Per lag the furthest word covered so far is
kept, and pairs before it are passed over, so a stretch is extended once per lag however many grams seed it.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import WORD, bounded_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# words in a run at least, and periods in it
LEAST, COPIES = 24, 3
# the shortest gram, for which no run's diagonal is too short; and how many next occurrences are paired
GRAM, PARTNERS = 16, 3
# characters split into words at once
PIECE = 1 << 20

RUN = "struct<start:long,length:long,period:long>"

_words = re.compile(WORD).finditer
_space = re.compile(r"[\x20\x09-\x0D]").search
Rewrite = Callable[[object, int], "np.ndarray | None"]


def _numbered(text: str) -> tuple[np.ndarray, list[str]]:
    """The words of ``text`` as numbers, and the word of each number."""
    number: dict[str, int] = {}
    found, at = array("i"), 0
    while at < len(text):
        gap = _space(text, min(len(text), at + PIECE))
        end = gap.start() if gap else len(text)
        found.extend(number.setdefault(m.group(), len(number)) for m in _words(text, at, end))
        at = end
    return np.frombuffer(found, dtype=np.int32).astype(np.int64) if found else np.zeros(0, np.int64), list(number)


def _repeats_gram(x: np.ndarray) -> bool:
    """Can two ``GRAM``-grams of ``x`` be equal? Equal grams have equal hashes, so a no is certain."""
    h, k = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while k < GRAM:
        h = h[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + (h[k:] ^ (h[k:] >> np.uint64(29)))
        k *= 2
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def _doubled(names: np.ndarray, k: int) -> np.ndarray:
    """Names of the ``2 k``-grams from those of the ``k``-grams; equal names mean equal grams."""
    return np.unique(names[:-k] * (int(names.max()) + 1) + names[k:], return_inverse=True)[1].astype(np.int64)


def _same_until(x: np.ndarray, lag: int, at: int) -> int:
    """The first position from ``at`` on whose word differs from the one ``lag`` on."""
    step, stop = 64, len(x) - lag
    while at < stop:
        end = min(stop, at + step)
        differ = x[at:end] != x[at + lag : end + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = end, min(step * 2, 1 << 16)
    return stop


def _same_since(x: np.ndarray, lag: int, at: int) -> int:
    """The first position of the equal stretch on the diagonal that ends before ``at``."""
    step = 64
    while at > 0:
        start = max(0, at - step)
        differ = x[start:at] != x[start + lag : at + lag]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, step = start, min(step * 2, 1 << 16)
    return 0


def _prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] * (n > 1)


def _smallest(x: np.ndarray, start: int, period: int) -> bool:
    """Has the run of ``period`` at ``start`` no smaller period? One would divide it, as the run holds three copies."""
    for prime in _prime_factors(period):
        less = period // prime
        if np.array_equal(x[start : start + period], x[start + less : start + period + less]):
            return False
    return True


def _seeds(names: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of occurrences with a lag from ``low`` to ``high``: lags and first positions, in this order."""
    order = np.argsort(names, kind="stable")
    ranked, lags, firsts = names[order], [], []
    for r in range(1, PARTNERS + 1):
        first = order[:-r][ranked[r:] == ranked[:-r]]
        lag = order[r:][ranked[r:] == ranked[:-r]] - first
        near = (lag >= low) & (lag <= high)
        lags.append(lag[near])
        firsts.append(first[near])
    lag, first = np.concatenate(lags), np.concatenate(firsts)
    order = np.lexsort((first, lag))
    return lag[order], first[order]


def find_runs(x: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run among the numbered words ``x``, by start, then period."""
    n = len(x)
    if n < LEAST or not _repeats_gram(x):
        return []
    names, k = x, 1
    while k < GRAM:
        names, k = _doubled(names, k), 2 * k
    out, low = [], 1
    while low <= n // COPIES:
        lags, firsts = _seeds(names, low, min(k - 1, n // COPIES))
        starts = np.flatnonzero(np.diff(lags, prepend=-1))
        for a, b in zip(starts, [*starts[1:], len(lags)]):
            lag, at = int(lags[a]), firsts[a:b]
            i = 0
            while i < len(at):
                start, covered = _same_since(x, lag, int(at[i])), _same_until(x, lag, int(at[i]) + k)
                length = covered - start + lag
                if length >= max(LEAST, COPIES * lag) and _smallest(x, start, lag):
                    out.append((start, length, lag))
                i = int(np.searchsorted(at, covered))
        if len(names) <= k or int(names.max()) + 1 == len(names):
            break  # no gram occurs twice, so no longer one does
        low = k
        names, k = _doubled(names, k), 2 * k
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when each run keeps its first period only."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``id_col, n_words, runs, collapsed`` for every row of ``docs``.

    ``runs`` is an array of ``(start, length, period)`` in words, by start, then period. ``collapsed`` is the text
    without the words that a run holds after its first period, words joined by one space. Runs of different periods may
    overlap; each is listed. ``rewrite(id, n)`` may give, per word, the position of the word to take instead.

    Null and empty texts have no words, no runs and an empty ``collapsed``. Rows are judged one by one, so null and
    repeated ids and repeated rows all stay. Other columns of ``docs`` are left out, so their names cannot clash. An
    empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    schema = StructType([docs.schema[id_col], *StructType.fromDDL(f"n_words long, runs array<{RUN}>, collapsed string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for key, text in zip(batch.column(0), batch.column(1)):
                x, words = _numbered(text.as_py() or "")
                taken = rewrite(key.as_py(), len(x)) if rewrite else None
                x = x if taken is None else x[taken]
                runs = find_runs(x)
                counts.append(len(x))
                found.append([{"start": s, "length": length, "period": p} for s, length, p in runs])
                texts.append(" ".join([words[i] for i in (x[kept_words(len(x), runs)] if runs else x)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, arrow.field("runs").type), pa.array(texts, arrow.field("collapsed").type)], schema=arrow
            )

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run with the most copies of its period, exactly; of equals the first by start, then period; null without runs."""

    def better(best: Column, r: Column) -> Column:
        more, least = r["length"] * best["period"], best["length"] * r["period"]
        sooner = F.struct(r["start"], r["period"]) < F.struct(best["start"], best["period"])
        return F.when(best.isNull() | (more > least) | ((more == least) & sooner), r).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def repeated_tail(key: object, n: int) -> np.ndarray | None:
    """A ``rewrite`` that makes the words of some texts repeat from some word on, chosen by the CRC-32 of the id.

    A null id and a text without words stay as they are.
    """
    h = zlib.crc32(str(key).encode())
    if key is None or not n or h % 10:
        return None
    g = h // 10
    since = g % n
    period = 1 + (n - since) // (3 + g % 8)
    return np.concatenate([np.arange(since), since + np.arange(n - since) % period])
