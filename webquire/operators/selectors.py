"""Which elements a CSS selector picks, over tokens with intervals.

A selector is a chain of compounds: ``aside``, ``div.ad.wide``, ``#top``, ``a[rel=next]`` or ``[role]``, joined by white
space (somewhere inside) or ``>`` (directly inside).  A compound is a test of one start tag.  A step to the inside asks
whether an element picked so far still spans the token, by a running maximum of ends; a step to a child asks whether the
parent was picked, by a window over the tokens of one depth.  All windows stay within the page.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webquire.functions.markup import END_OF_PAGE, WS, attribute, attributes

_NAME = r"-?[A-Za-z_\u0080-\U0010ffff][\w\u0080-\U0010ffff-]*"
_PART = re.compile(rf"#(?P<id>[\w\u0080-\U0010ffff-]+)|\.(?P<cls>{_NAME})|\[\s*(?P<attr>[\w-]+)\s*(?:=\s*(?P<value>\"[^\"]*\"|'[^']*'|[\w-]+)\s*)?\]")
_STEP = re.compile(r"\s*>\s*|\s+")


@dataclass
class Compound:
    """Tests of one element; ``child``: its parent, else some ancestor, is what the compound before picks."""

    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str | None]] = field(default_factory=list)
    child: bool = False


def parse(selector: str) -> list[Compound]:
    """The compounds of ``selector``; anything else than the forms named above is a ``ValueError``."""
    chain, at, child = [], 0, False
    text = selector.strip()
    while at < len(text) or not chain:
        tag = re.compile(rf"{_NAME}|\*").match(text, at)
        compound = Compound(tag=tag.group().lower() if tag and tag.group() != "*" else None, child=child)
        start, at = at, tag.end() if tag else at
        while part := _PART.match(text, at):
            at = part.end()
            if part["id"]:
                compound.ids.append(part["id"])
            elif part["cls"]:
                compound.classes.append(part["cls"])
            else:
                value = part["value"]
                compound.attributes.append((part["attr"].lower(), value[1:-1] if value and value[0] in "\"'" else value))
        if at == start:
            raise ValueError(f"selector not supported: {selector!r}")
        chain.append(compound)
        if at == len(text):
            break
        step = _STEP.match(text, at)
        if not step or step.end() == len(text):
            raise ValueError(f"selector not supported: {selector!r}")
        at, child = step.end(), ">" in step.group()
    return chain


def _test(compound: Compound) -> Column:
    """Does a start tag meet the compound? Attributes are read only where the tag mentions them."""
    token, lower = F.col("token"), F.lower("token")

    def read(name: str, decode: bool = True) -> Column:
        return F.when(lower.contains(name), attribute(token, name, decode)).otherwise("")

    test = F.col("kind").isin("start", "void", "raw")
    if compound.tag:
        test = test & (F.col("tag") == compound.tag)
    for value in compound.ids:
        test = test & (read("id") == value)
    if compound.classes:
        names = F.split(read("class", decode=False), rf"[{WS}]+")
        for name in compound.classes:
            test = test & F.array_contains(names, name)
    for name, value in compound.attributes:
        has = F.when(lower.contains(name), F.map_contains_key(attributes(token), F.lit(name))).otherwise(F.lit(False))
        test = test & (has if value is None else read(name) == value)
    return test


def _with_depth(tokens: DataFrame, key: str) -> DataFrame:
    """Add ``depth``, the number of elements around a token: starts before it less the ends before it."""
    ends = F.col("kind").eqNullSafe("start") & F.col("close_pos").isNotNull()
    here, there = F.struct(F.col("pos").alias("at"), F.lit(0).alias("role")), F.struct(F.col("close_pos").cast("int").alias("at"), F.lit(1).alias("role"))
    events = tokens.select("*", F.explode(F.when(ends, F.array(here, there)).otherwise(F.array(here))).alias("event"))
    before = Window.partitionBy(key).orderBy("event.at", "event.role").rowsBetween(Window.unboundedPreceding, -1)
    step = F.when(F.col("event.role") == 1, -1).when(F.col("kind") == "start", 1).otherwise(0)
    return events.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0))).filter("event.role = 0").drop("event")


def _parent_picked(tokens: DataFrame, key: str, picked: str) -> DataFrame:
    """Add ``inside``: is a token's parent ``picked``? The parent is the last start one level up."""
    as_child, as_parent = F.struct(F.col("depth").alias("level"), F.lit(False).alias("parent")), F.struct((F.col("depth") + 1).alias("level"), F.lit(True).alias("parent"))
    roles = tokens.select("*", F.explode(F.when(F.col("kind") == "start", F.array(as_child, as_parent)).otherwise(F.array(as_child))).alias("as"))
    before = Window.partitionBy(key, "as.level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("as.parent"), F.col(picked)), ignorenulls=True).over(before)
    return roles.withColumn("inside", F.coalesce(found, F.lit(False))).filter("not as.parent").drop("as")


def with_selected(tokens: DataFrame, key: str, selectors: Sequence[str]) -> DataFrame:
    """Add ``selected``: does any of the ``selectors`` pick the element that a token starts?

    ``tokens`` are paired: ``pos, kind, tag, token, close_pos``.  An element without an end spans the rest of the page.
    """
    chains = [parse(s) for s in selectors]
    if any(c.child for chain in chains for c in chain):
        tokens = _with_depth(tokens, key)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    until = F.when(F.col("kind") == "start", F.coalesce("close_pos", F.lit(END_OF_PAGE))).otherwise(F.col("pos"))
    added = ["depth"] if "depth" in tokens.columns else []
    for i, chain in enumerate(chains):
        tokens = tokens.withColumn(f"picked{i}", _test(chain[0]))
        added.append(f"picked{i}")
        for compound in chain[1:]:
            if compound.child:
                tokens = _parent_picked(tokens, key, f"picked{i}")
            else:
                tokens = tokens.withColumn("inside", F.coalesce(F.max(F.when(F.col(f"picked{i}"), until)).over(before) >= F.col("pos"), F.lit(False)))
            tokens = tokens.withColumn(f"picked{i}", F.col("inside") & _test(compound)).drop("inside")
    hit = F.greatest(F.lit(False), F.lit(False), *(F.col(f"picked{i}") for i in range(len(chains))))
    return tokens.withColumn("selected", hit).drop(*added)
