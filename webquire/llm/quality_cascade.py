"""Quality rules as a short-circuit cascade whose order is learned from a sample.

Every rule is timed and its rejections are recorded on a bounded sample. The rule with the most rejections per
nanosecond among the rows that earlier rules leave runs next. A document stops at its first rejection. The verdict is
the conjunction of all rules, so the order changes the cost and never the outcome.
"""

from __future__ import annotations

import re
import sys
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import WORD, bounded_batches, flush

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_words = re.compile(WORD).findall


def repeated_words(words: Sequence[str]) -> int:
    """Words inside 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


@dataclass
class Text:
    """One text with the measures that rules ask for, each computed at most once."""

    text: str
    words: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.words = _words(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if _words(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def base_failed(self) -> bool:
        return self.n_words < 50 or 100 * self.n_repeat_words > 50 * self.n_words


@dataclass(frozen=True)
class Rule:
    """``rejects`` sees a text that has at least one word."""

    name: str
    rejects: Callable[[Text], bool]


def _shouts(t: Text) -> bool:
    upper = sum(map(str.isupper, t.text))
    return 2 * upper > t.word_chars


def _few_letters(t: Text) -> bool:
    return 2 * sum(map(str.isalpha, t.text)) < t.word_chars


def _one_word(t: Text) -> bool:
    return 2 * Counter(t.words).most_common(1)[0][1] > t.n_words


RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: not 5 * t.n_words <= 2 * t.word_chars <= 24 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > len(t.lines)),
    Rule("shouting", _shouts),
    Rule("exclamations", lambda t: 2 * t.text.count("!") > t.n_words),
    Rule("letters", _few_letters),
    Rule("one_word", _one_word),
)


def profile(docs: DataFrame, text_col: str, rules: Sequence[Rule], sample_fraction: float, sample_rows: int, seed: int) -> list[int]:
    """Order of ``rules`` by rejections per cost on a sample; the given order if it is empty.

    The sample is ``sample_fraction`` of the rows, or less, so that about ``sample_rows`` are drawn. They are measured
    where they are read: only counts by pattern leave a task.
    """
    schema = StructType.fromDDL("pattern long, n long, ns array<double>")
    arrow = to_arrow_schema(schema)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: Counter = Counter()
        ns = [0.0] * len(rules)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = _words(text or "")
                if not words:
                    continue
                pattern = 0
                for i, rule in enumerate(rules):
                    t = Text(text)  # a rule pays for its own measures
                    start = time.perf_counter_ns()
                    pattern |= bool(rule.rejects(t)) << i
                    ns[i] += time.perf_counter_ns() - start
                patterns[pattern] += 1
        yield from flush([(p, n, ns if k == 0 else None) for k, (p, n) in enumerate(patterns.items())], arrow)

    fraction = min(sample_fraction, sample_rows / max(1, docs.count()))
    sample = docs.select(F.col(text_col).alias("text")).sample(fraction, seed)
    got = sample.mapInArrow(measure, schema).groupBy("pattern").agg(F.sum("n").alias("n"), *(F.sum(F.col("ns")[i]).alias(f"r{i}") for i in range(len(rules)))).collect()  # at most 2^rules rows
    cost = [max(1.0, sum(row[f"r{i}"] or 0 for row in got)) for i in range(len(rules))]
    left, order = {row["pattern"]: row["n"] for row in got}, []
    while len(order) < len(rules):
        rest = [i for i in range(len(rules)) if i not in order]
        best = max(rest, key=lambda i: (sum(n for p, n in left.items() if p >> i & 1) / cost[i], -i))
        order.append(best)
        left = {p: n for p, n in left.items() if not p >> best & 1}
    return order


def quality_cascade(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES,
    sample_fraction: float = 0.02, sample_rows: int = 2_000, seed: int = 7,
) -> DataFrame:
    """Base measures and the cascade's verdict for every row: ``id_col, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, rejected_by, n_rules_run``.

    A null or blank text has no words and fails the base rule. Repeated and null ids stay separate rows. Other columns
    of ``docs`` are left out, so their names cannot clash. ``rejected_by`` (null: kept; ``base``) and ``n_rules_run``
    describe the run and depend on the learned order; the other columns don't. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    order = profile(docs, text_col, rules, sample_fraction, sample_rows, seed)
    cascade = [rules[i] for i in order]
    schema = StructType([docs.schema[id_col], *StructType.fromDDL(", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, rejected_by string, n_rules_run int")])
    arrow = to_arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = Text(text.as_py() or "")
                by, run = ("base", 0) if t.base_failed else (None, 0)
                for rule in cascade if by is None else ():
                    run += 1
                    if rule.rejects(t):
                        by = rule.name
                        break
                rows.append((key, *(getattr(t, c) for c in BASE), t.base_failed, by is None, by, run))
            yield from flush(rows, arrow)

    return docs.select(id_col, text_col).mapInArrow(judge, schema)
