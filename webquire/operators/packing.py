"""Word-bounded packing of ordered documents into parts.

The rule is a sequential fold: a new part starts where the current one, if not
empty, would grow past the cap.  It is run here without ever gathering a group:

1. Document metadata (never content) is range-partitioned by (group, path) and
   written.  Keys are unique, so a group holding most of the rows is simply cut
   into many blocks of even size.
2. A block that lies wholly inside one group is summarised as a table "words in
   the open part on entry -> words in the open part on exit, parts started".
   Only rows inside the first cap of words can be the first start, so the table
   has at most min(rows, cap + 1) entries; it travels as one row of arrays.
3. The open state is walked along the blocks of each spanning group; it is one
   row per block.
4. Every block is folded on its own, given its entry state.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquire.functions.text import part_path, path_order_key
from webquire.operators.ranking import PARTITION_BITS
from webquire.session import checkpoint, cut

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEFAULT_MAX_WORDS = 500_000  # fixed value: the cap used for 0 or less
SEPARATOR = "\n\n---\n\n"  # fixed value: stands between two documents of a part
CHUNK_BYTES = 16 << 20  # of a part's text in one row

STEP = "grp string, block int, reach array<bigint>, words_out array<bigint>, parts array<bigint>, total bigint"
ENTRY = "block int, words_in bigint, parts_in bigint"
ASSIGNED = "grp string, path string, words bigint, seq bigint, part bigint, leading boolean"


def _group(group_by: Column | str | None) -> Column:
    """The group as text; one group, the empty text, without ``group_by``."""
    grp = F.lit("") if group_by is None else (F.col(group_by) if isinstance(group_by, str) else group_by)
    return F.coalesce(grp.cast("string"), F.lit(""))


def effective_cap(max_words: int | None) -> int:
    """``None`` is unlimited; 0 or less is the default cap."""
    if max_words is None:
        return 2**62
    return max_words if max_words > 0 else DEFAULT_MAX_WORDS


def segment_steps(words: np.ndarray, cap: int, most: int = 2**62) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step function of one run of documents: for each possible first start
    ``(reach, words_out, parts)``, where ``reach`` is the running word count up to it.

    The first start for an entry of ``c`` words is the first row with ``reach > cap - c``;
    ``most`` is the largest entry that can come, and starts that it cannot cause are left out
    (but the first row, for an entry without a part).
    """
    n = len(words)
    reach = np.cumsum(words)
    row = np.arange(n)
    start_before = reach - words
    following = np.maximum(row + 1, np.searchsorted(reach, start_before + cap, side="right"))
    # pointer doubling along the chain of starts, up to the last start of the run
    jump = np.where(following < n, following, row)
    parts = (following < n).astype(np.int64)
    while True:
        ahead = parts[jump]
        if not ahead.any():
            break
        parts = parts + ahead
        jump = jump[jump]
    possible = (row <= np.searchsorted(reach, cap, side="right")) & ((row == 0) | (reach > cap - most))
    first_of_reach = np.r_[True, reach[1:] != reach[:-1]] if n else np.zeros(0, bool)
    pick = possible & first_of_reach
    last = jump[pick]
    return reach[pick], reach[-1] - start_before[last] if n else reach, parts[pick] + 1


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    """Consecutive rows of one group, batch by batch."""
    for pdf in batches:
        if len(pdf):
            edges = np.flatnonzero(pdf["grp"].to_numpy()[1:] != pdf["grp"].to_numpy()[:-1]) + 1
            for piece in np.split(np.arange(len(pdf)), edges):
                yield pdf["grp"].iloc[piece[0]], pdf.iloc[piece]


def _summarise(batches: Iterator[pd.DataFrame], cap: int, most: int, inner: frozenset, tail: frozenset) -> Iterator[pd.DataFrame]:
    """One row per block: the step table of a block inside one group, or the exit state of a group that starts here."""
    group, words, block = None, [], None
    for grp, run in _runs(batches):
        if grp != group:
            group, words = grp, []
        block = int(run["block"].iloc[0])
        if block not in inner and block not in tail:
            continue
        words.append(run.loc[~run["empty"], "words"].to_numpy(np.int64))
    if block is None or (block not in inner and block not in tail):
        return
    flat = np.concatenate(words)
    reach, words_out, parts = segment_steps(flat, cap, most) if len(flat) else (flat, flat, flat)
    if block in tail:  # starts fresh: only the first row can be the first start
        reach, words_out, parts = reach[:1], words_out[:1], parts[:1]
    row = {"grp": group, "block": block, "reach": reach, "words_out": words_out, "parts": parts, "total": int(flat.sum())}
    yield pd.DataFrame([row])


def _walk(batches: Iterator[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """Carry the open state along the blocks of each group: one row and one search per block."""
    group, words, parts = None, 0, 0
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.grp != group:
                group, words, parts = row.grp, 0, 0
            else:
                out.append((row.block, words, parts))
            # a fresh group starts at its first document, whatever its size
            at = 0 if parts == 0 else int(np.searchsorted(row.reach, cap - words, side="right"))
            if at < len(row.reach):
                words, parts = int(row.words_out[at]), parts + int(row.parts[at])
            elif parts:
                words += int(row.total)
        yield pd.DataFrame(out, columns=["block", "words_in", "parts_in"])


def _starts(reach: np.ndarray, words: np.ndarray, cap: int, first: int) -> np.ndarray:
    """Which documents start a part, ``first`` being the first to.

    A start points to the next one.  Marks spread along the pointers while the pointers double, so the chain is marked
    in as many rounds as its length has bits.
    """
    n = len(words)
    row = np.arange(n)
    jump = np.append(np.maximum(row + 1, np.searchsorted(reach, reach - words + cap, side="right")), n)
    marked = np.zeros(n + 1, bool)
    marked[first] = True
    while True:
        ahead = jump[marked]
        if (ahead == n).all():
            return marked[:n]
        marked[ahead] = True
        jump = jump[jump]


def _fold(batches: Iterator[pd.DataFrame], cap: int, entry: dict[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
    """Assign parts inside a block, from its entry state, a run of one group at a time."""
    group, first = None, True
    words = parts = 0
    for grp, run in _runs(batches):
        if first or grp != group:
            words, parts = entry.get(int(run["block"].iloc[0]), (0, 0)) if first else (0, 0)
            group, first = grp, False
        empty = run["empty"].to_numpy(bool)
        count = run.loc[~empty, "words"].to_numpy(np.int64)
        reach = np.cumsum(count)
        n = len(count)
        starts = _starts(reach, count, cap, 0 if parts == 0 else int(np.searchsorted(reach, cap - words, side="right")))
        # the state ahead of each text, and behind the last: parts so far, and words in the open one
        number = parts + np.r_[0, np.cumsum(starts)]
        since = np.maximum.accumulate(np.r_[-words, np.where(starts, reach - count, -words)])
        filled = np.r_[0, reach] - since
        # an empty document never opens a part: ahead of the first text it is invisible
        ahead = np.cumsum(~empty)[empty]
        leading, part = np.zeros(len(run), bool), np.empty(len(run), np.int64)
        leading[empty] = (number[ahead] == 0) | (filled[ahead] > cap)
        part[empty] = number[ahead] + leading[empty]
        part[~empty] = number[1:]
        words, parts = int(filled[n]), int(number[n])
        yield run[["grp", "path", "words", "seq"]].assign(part=part, leading=leading)


def assign_parts(
    docs: DataFrame,
    max_words: int | None = DEFAULT_MAX_WORDS,
    group_by: Column | str | None = None,
    path: str = "path",
    words: str = "words",
    empty: str | None = None,
) -> DataFrame:
    """``(grp, path, words, seq, part, leading)``: the part of each document, in walk order.

    ``docs`` has ``path``, unique in its group, and ``words``; ``empty`` names a boolean column for
    documents without any characters.  Without ``group_by`` all documents are one group.
    ``leading`` marks empty documents that no part shows.
    """
    cap = effective_cap(max_words)
    meta = docs.select(
        _group(group_by).alias("grp"),
        F.col(path).alias("path"),
        F.coalesce(F.col(words), F.lit(0)).cast("bigint").alias("words"),
        (F.coalesce(F.col(empty), F.lit(False)) if empty else F.lit(False)).alias("empty"),
    )
    # Written first: a range sort reads its input twice, and that must not be the content.
    meta = cut(meta, "metadata")
    ordered = meta.orderBy("grp", path_order_key("path"), "path").select(
        "*",
        F.spark_partition_id().alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )
    # A checkpoint keeps the sort partitions as they are, so both passes below are narrow.
    blocks = checkpoint(ordered)

    # One row per block: bounded by the number of sort partitions, whatever the data.
    ends = sorted(
        (r["block"], r["head"], r["last"])
        for r in blocks.groupBy("block").agg(F.min("grp").alias("head"), F.max("grp").alias("last")).collect()
    )
    joints = [(b, nb) for (b, _, last), (nb, head, _) in zip(ends, ends[1:]) if last == head]
    goes_on, comes_in = {b for b, _ in joints}, {nb for _, nb in joints}
    inner = frozenset(b for b, head, last in ends if head == last and b in goes_on and b in comes_in)
    tail = frozenset(goes_on - inner)

    entry: dict[int, tuple[int, int]] = {}
    if joints:
        # no entry exceeds the words before it, so without a cap a block has one step
        most = min(cap, blocks.agg(F.sum("words")).first()[0] or 0)
        steps = blocks.mapInPandas(partial(_summarise, cap=cap, most=most, inner=inner, tail=tail), STEP)
        # the last block of a group needs an entry state but no step table
        stops = blocks.sparkSession.createDataFrame(
            [(head, b, [], [], [], 0) for b, head, _ in ends if b in comes_in and b not in inner], STEP
        )
        walked = (
            steps.unionByName(stops)
            .repartition("grp")
            .sortWithinPartitions("grp", "block")
            .mapInPandas(partial(_walk, cap=cap), ENTRY)
        )
        entry = {r["block"]: (r["words_in"], r["parts_in"]) for r in walked.collect()}
    return blocks.mapInPandas(partial(_fold, cap=cap, entry=entry), ASSIGNED)


def placed_texts(
    docs: DataFrame,
    assigned: DataFrame,
    max_words: int | None = DEFAULT_MAX_WORDS,
    output: str = "combined.md",
    path: str = "path",
    content: str = "content",
    group_by: Column | str | None = None,
) -> DataFrame:
    """``(grp, part, seq, file, words, content)``: each shown document with the file that it goes to.

    Paths are unique within a group, so content meets its assignment by both.
    """
    cap = effective_cap(max_words)
    totals = assigned.groupBy("grp").agg((F.sum("words") > cap).alias("split"))
    shown = assigned.filter(~F.col("leading")).join(totals, "grp")
    text = docs.select(_group(group_by).alias("grp"), F.col(path).alias("path"), F.col(content).alias("content"))
    file = part_path(F.lit(output), F.col("part"), F.col("split"))
    return text.join(shown, ["grp", "path"]).select("grp", "part", "seq", file.alias("file"), "words", "content")


def parts_of(
    docs: DataFrame,
    assigned: DataFrame,
    max_words: int | None = DEFAULT_MAX_WORDS,
    output: str = "combined.md",
    path: str = "path",
    content: str = "content",
    group_by: Column | str | None = None,
) -> DataFrame:
    """``(grp, part, file, words, files, content)``: the text of every part as one row.

    Content moves twice: to its assignment, and to its part.  For parts that are large in
    bytes, or without a cap, ``sources.writers.write_parts`` writes the files as streams.
    """
    return (
        placed_texts(docs, assigned, max_words, output, path, content, group_by)
        .groupBy("grp", "part", "file")
        .agg(
            F.sum("words").alias("words"),
            F.count("*").alias("files"),
            F.expr(f"listagg(content, {SEPARATOR!r}) within group (order by seq)").alias("content"),
        )
        .select("grp", "part", "file", "words", "files", "content")
    )


def part_chunks(
    docs: DataFrame,
    assigned: DataFrame,
    max_words: int | None = DEFAULT_MAX_WORDS,
    output: str = "combined.md",
    path: str = "path",
    content: str = "content",
    group_by: Column | str | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(grp, part, chunk_no, file, content)``: the text of every part in rows of less than twice ``chunk_bytes``.

    The chunks of a part, in order, are its text.  A document is a unit, a longer one several; a unit goes to the chunk
    in which its first byte falls.  Where that is follows from prefix sums of byte counts, made per block of the
    packing's sort and then over the blocks, so a part that holds the whole corpus is cut by many tasks at once.
    """
    letters = max(1, chunk_bytes // 4)  # a character has four bytes at most
    text = F.col("content")
    units = F.when(F.octet_length(text) <= chunk_bytes, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{letters}}}+"), F.lit(0)))
    named = docs.filter(F.col(content).isNotNull()).select(_group(group_by).alias("grp"), F.col(path).alias("path"), F.col(content).alias("content"))
    sizes = named.select("grp", "path", F.transform(units, lambda u: F.octet_length(u).cast("long")).alias("sizes"))
    cap = effective_cap(max_words)
    split = assigned.groupBy("grp").agg((F.sum("words") > cap).alias("split"))
    shown = assigned.filter(~F.col("leading"))
    firsts = shown.groupBy("grp", "part").agg(F.min("seq").alias("first"))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    lead = F.when(F.col("seq") == F.col("first"), 0).otherwise(len(SEPARATOR))
    spans = shown.join(firsts, ["grp", "part"]).join(sizes, ["grp", "path"]).select(
        "grp", "path", "part", "seq", "sizes", lead.alias("lead"), (lead + total).alias("bytes"), F.shiftright("seq", PARTITION_BITS).alias("block")
    )
    spans = cut(spans, "part-spans")
    # one row per part and block; their sums come before those inside a block
    blocks = spans.groupBy("grp", "part", "block").agg(F.sum("bytes").alias("bytes"))
    before = Window.partitionBy("grp", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("grp", "part", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("grp", "part", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("at", F.coalesce(F.sum("bytes").over(inside), F.lit(0))).join(blocks, ["grp", "part", "block"])
    start = F.col("base") + F.col("at")
    # where each unit begins; the separator goes with the first
    begins = F.transform("sizes", lambda x, i: start + F.when(i == 0, 0).otherwise(F.col("lead") + F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, y: a + y)))
    chunks = F.transform(begins, lambda b: F.floor(b / chunk_bytes))
    where = placed.join(split, "grp").select("grp", "path", "part", "seq", "lead", chunks.alias("chunks"), part_path(F.lit(output), F.col("part"), F.col("split")).alias("file"))
    pieces = named.join(where, ["grp", "path"]).select("grp", "part", "file", "seq", "lead", "chunks", F.posexplode(units).alias("nth", "text"))
    body = F.when((F.col("nth") == 0) & (F.col("lead") > 0), F.concat(F.lit(SEPARATOR), F.col("text"))).otherwise(F.col("text"))
    rows = pieces.select("grp", "part", "file", F.get("chunks", F.col("nth")).alias("chunk_no"), F.struct("seq", "nth").alias("place"), body.alias("text"))
    joined = F.expr("listagg(text, '') within group (order by place)")
    return rows.groupBy("grp", "part", "chunk_no", "file").agg(joined.alias("content"))


def corpus_summary(docs: DataFrame, assigned: DataFrame, group_by: Column | str | None = None) -> DataFrame:
    """``(grp, files, words, parts)`` per corpus.  ``files`` also counts documents that could
    not be read; separators hold no words."""
    listed = docs.groupBy(_group(group_by).alias("grp")).agg(F.count("*").alias("files"))
    packed = assigned.groupBy("grp").agg(
        F.sum("words").alias("words"),
        F.coalesce(F.max(F.when(~F.col("leading"), F.col("part"))), F.lit(0)).alias("parts"),
    )
    zero = F.lit(0).cast("bigint")
    return listed.join(packed, "grp", "left").select(
        "grp", "files", F.coalesce("words", zero).alias("words"), F.coalesce("parts", zero).alias("parts")
    )
