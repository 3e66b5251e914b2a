"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document draws ``u`` from a hash of its id and gets the exponential key ``-ln(u) / quality``. Within its source the
documents are taken in key order until the words reach the source's budget. Whole epochs come first: a source whose
target is 2.4 times its size gives every document twice, and the keys choose the rest.

No source is sorted in one task. The keys of a source follow a mixture of exponentials, one per quality; its distribution
function over the source's quality classes turns keys into even ranks, which are cut into buckets in proportion to the
source's documents. Bucket sums are prefix-summed per source, and only inside a bucket do rows get a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquire.llm.common import n_words, small
from webquire.session import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DOCS = 4_096
LEAST_QUALITY = 0.05
# classes of quality, even on a logarithmic scale
CLASSES = 24
SYMBOLS = "#*$%&|<>{}[]_=~^"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, falling with the share of markup symbols; 0.05 at least."""
    length = F.length(text)
    symbols = length - F.length(F.translate(text, SYMBOLS, ""))
    return F.when(length > 0, F.greatest(F.lit(LEAST_QUALITY), 1.0 / (1.0 + 20.0 * symbols / length))).otherwise(F.lit(LEAST_QUALITY))


def uniform(key: Column) -> Column:
    """A draw from (0, 1), fixed by ``key``: 52 bits of its MD5."""
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, n_docs, target`` from ``source, size``: one row per source.

    Weights go to the sources in code-point order, null last. The target is ``min(max_epochs * size, level * weight)``
    with the one level at which the targets sum to all sizes: the fixed point of handing the excess on by weight.
    """
    total = F.col("total")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    weighted = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    capped = (
        weighted.withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("cap_before", F.sum("cap").over(by_level) - F.col("cap"))
    )
    # the level if exactly the sources before this one in the order are full
    leveled = capped.withColumn("level", (total - F.col("cap_before")) / F.col("weight_left"))
    level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "source", "level"))).over(everything)["level"]
    return leveled.withColumn("level", level).select(
        "source", "source_size", "n_docs",
        F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))).alias("target"),
    )


def key_buckets(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """``narrow`` with its source's ``targets`` and a ``bucket`` that rises with ``key``; about ``BUCKET_DOCS`` rows each.

    A source's share of keys up to ``k`` is about the sum over its quality classes of ``n * (1 - exp(-quality * k))``,
    whatever the qualities are. The sum rises with ``k`` for any classes, so these touch the evenness alone.
    """
    place = F.floor(F.log(F.col("quality") / LEAST_QUALITY) / F.log(F.lit(1 / LEAST_QUALITY)) * CLASSES)
    classes = narrow.groupBy("source", place.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"))
    classes = classes.groupBy(F.col("source").alias("__of")).agg(F.collect_list(F.struct("n", "q")).alias("classes"))  # CLASSES + 1 at most
    known = targets.join(classes, F.col("source").eqNullSafe(F.col("__of"))).drop("__of").withColumn("buckets", 1 + F.floor(F.col("n_docs") / BUCKET_DOCS))
    known = cut(known.withColumnRenamed("source", "__s"), "mix-targets")
    # sources beyond the broadcast limit are many and small; a hot one among them is spread by AQE's skew join
    keyed = narrow.join(small(known, known.count()), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    below = F.aggregate("classes", F.lit(0.0), lambda a, c: a + c["n"] * (1.0 - F.exp(-c["q"] * F.col("key"))))
    return keyed.withColumn("bucket", F.floor(below / F.col("n_docs") * F.col("buckets"))).drop("classes", "buckets")


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], max_epochs: int, seed: str) -> DataFrame:
    """``id, source, size, tie, source_size, target, copies`` for every row."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text).alias("size"), quality_weight(text).alias("quality"), F.xxhash64(text).alias("tie"))
    u = uniform(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    narrow = cut(rows.withColumn("key", -F.log(u) / F.col("quality")), "mix-sizes")
    keyed = key_buckets(narrow, source_targets(narrow, weights, max_epochs))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("s")).select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    # rows that nothing tells apart are peers: they share the running sum and so the decision
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size", "tie")
    run = keyed.withColumn("reach", F.sum("size").over(inside)).join(sums, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    chosen = (F.col("size") > 0) & (F.col("offset") + F.col("reach") - F.col("size") / 2 <= rest) & (F.col("epochs") < max_epochs)
    return run.withColumn("epochs", epochs).select("id", "source", "size", "tie", "source_size", "target", (F.col("epochs") + chosen.cast("int")).cast("int").alias("copies"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """One row per document: ``id_col, source, size, source_size, target, copies, taken``.

    ``copies`` is how often the mix holds the document (0 to ``max_epochs``), ``taken = copies * size``. The document at
    the edge of the budget is taken if that brings the source nearer to its target. Null texts have size 0 and quality
    0.05; a null source is a source of its own; rows that share an id share their draw and are ordered by size and text
    hash, and rows that agree in these as well get the same number of copies. Other columns of ``docs`` are left out. An
    empty table gives no rows.
    """
    plan = _plan(docs, id_col, text_col, source_col, weights, max_epochs, seed)
    return plan.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def draw(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix",
) -> DataFrame:
    """``docs`` as the mix holds them, in their own columns: a row for each of ``mix``'s copies. Texts move once."""
    plan = _plan(docs, id_col, text_col, source_col, weights, max_epochs, seed).where("copies > 0")
    plan = plan.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("tie").alias("__tie"), F.col("copies").alias("__copies")).distinct()
    same = docs[id_col].eqNullSafe(plan["__id"]) & docs[source_col].eqNullSafe(plan["__source"]) & (F.xxhash64(docs[text_col]) == plan["__tie"])
    return docs.join(plan, same).select(*(docs[c] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")).drop("__copy")
