"""Token counts per section by offset-mapped attribution.

A document is encoded once and as a whole. The cumulated byte lengths of its tokens are their spans in the text, which
an interval join (two binary searches per token, since both sides are sorted) maps to the spans of the sections. Rules
for a token that crosses a boundary:

* ``majority``: the section that holds most of its bytes; of equals the earlier one.
* ``first``: the section that holds its first byte, or else the first section that it reaches.

A token that touches no section (line breaks between paragraphs) goes to the section before it, at the start of a text
to the first one. So every token counts once, and the counts of a document sum to its tokens.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from webquire.llm.common import bounded_batches
from webquire.llm.tokens import Encoder, ship

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RULES = ("majority", "first")
FLUSH_ROWS = 50_000
Spans = tuple[np.ndarray, np.ndarray]


def line_sections(text: str) -> Spans:
    """Start and end, in code points, of the lines that are not empty."""
    starts, ends, at = [], [], 0
    for line in text.split("\n"):
        if line:
            starts.append(at)
            ends.append(at + len(line))
        at += len(line) + 1
    return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64)


def byte_spans(raw: np.ndarray, spans: Spans) -> Spans:
    """Spans in code points as spans in the bytes of the UTF-8 text ``raw``."""
    if not len(raw) or raw.max() < 0x80:
        return spans
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return at[spans[0]], at[spans[1]]


def attribute(token_ends: np.ndarray, spans: Spans, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token reaches outside it. ``spans`` are disjoint, sorted, not empty."""
    starts, ends = spans
    token_starts = np.append(0, token_ends[:-1])
    last = len(starts) - 1
    low = np.searchsorted(ends, token_starts, "right")  # the first section that ends after the token's start
    high = np.searchsorted(starts, token_ends, "left") - 1  # the last one that starts before its end
    section = np.minimum(low, last)
    none = low > high
    section[none] = np.clip(high[none], 0, last)
    if rule == "majority":
        for i in np.flatnonzero(high > low):
            k = np.arange(low[i], high[i] + 1)
            section[i] = k[np.argmax(np.minimum(ends[k], token_ends[i]) - np.maximum(starts[k], token_starts[i]))]
    outside = (token_starts < starts[section]) | (token_ends > ends[section])
    return section, outside


def section_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[str], Spans] = line_sections,
    rule: str = "majority", vocabulary: str | None = None,
) -> DataFrame:
    """``id_col, section, start, stop, n_tokens, n_crossing``: a row per section with its span in code points.

    ``n_crossing`` counts its tokens that reach outside the span. A text without sections (null, empty, only line
    breaks) gives one row with section 0, an empty span, and all its tokens. Repeated and null ids keep their own rows.
    Other columns are left out. An empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    bounded_batches(docs.sparkSession)
    shipped = ship(docs.sparkSession, vocabulary)
    schema = StructType([docs.schema[id_col], *StructType.fromDDL("section int, start long, stop long, n_tokens long, n_crossing long")])
    arrow = to_arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shipped.value)
        for batch in batches:
            owner: list[int] = []
            parts: list[np.ndarray] = []
            held = 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py() or ""
                lengths = encoder.lengths[encoder.encode(text)]
                spans = sections(text)
                n = len(spans[0])
                if n:
                    raw = np.frombuffer(text.encode(), dtype=np.uint8)
                    section, outside = attribute(np.cumsum(lengths), byte_spans(raw, spans), rule)
                    tokens, crossing = np.bincount(section, minlength=n), np.bincount(section, outside, minlength=n).astype(np.int64)
                    parts.append(np.stack([np.arange(n), *spans, tokens, crossing]))
                else:
                    parts.append(np.array([[0], [0], [0], [len(lengths)], [0]]))
                owner += [row] * parts[-1].shape[1]
                held += parts[-1].shape[1]
                if held >= FLUSH_ROWS or row == batch.num_rows - 1:
                    columns = np.concatenate(parts, axis=1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(columns[0].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[1:])], schema=arrow)
                    owner, parts, held = [], [], 0

    return docs.select(id_col, text_col).mapInArrow(count, schema)
