"""Combine: pack ordered documents into word-bounded parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquire.functions.text import word_count
from webquire.operators.packing import CHUNK_BYTES, DEFAULT_MAX_WORDS, assign_parts, corpus_summary, part_chunks, parts_of
from webquire.session import cut


@dataclass
class Combined:
    parts: DataFrame
    summary: DataFrame
    assigned: DataFrame
    chunks: DataFrame  # the text of the parts in rows of bounded size


def combine(
    docs: DataFrame,
    max_words: int | None = DEFAULT_MAX_WORDS,
    group_by: Column | str | None = None,
    output: str = "combined.md",
    path: str = "path",
    content: str = "content",
    chunk_bytes: int = CHUNK_BYTES,
) -> Combined:
    """Parts, summary, assignment and chunks of ``docs``; only path and word count enter the packing.

    ``parts`` has a part in one row; take ``chunks`` where parts may be large, or without a cap.

    A document with NULL content could not be read: it counts as a file, no more.
    """
    readable = docs.filter(F.col(content).isNotNull())
    measured = readable.select(
        "*", word_count(content).alias("_words"), (F.col(content) == "").alias("_empty")
    )
    # used three times below; one narrow table instead of three folds
    assigned = cut(assign_parts(measured, max_words, group_by, path, "_words", "_empty"), "assigned")
    named = (docs, assigned, max_words, output, path, content, group_by)
    return Combined(parts_of(*named), corpus_summary(docs, assigned, group_by), assigned, part_chunks(*named, chunk_bytes))
