"""Text, path and hash column functions (all Catalyst expressions)."""

from __future__ import annotations

import functools
import html as _stdlib_html
import html.entities as _entities
import json
import re
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def by_name(make: Callable[..., Column]) -> Callable[..., Column]:
    """Build a long expression once per application and tuple of column names.

    A Column over names is immutable and may stand in any plan; building one takes
    hundreds of calls to the JVM.
    """
    built: dict[tuple, Column] = {}

    @functools.wraps(make)
    def column(*args: ColumnOrName) -> Column:
        context = SparkContext._active_spark_context
        if context is None or not all(isinstance(a, str) for a in args):
            return make(*args)
        key = (context.applicationId, *args)
        if key not in built:
            built[key] = make(*args)
        return built[key]

    return column


def trim_unicode(c: ColumnOrName) -> Column:
    """Trim Unicode white space (``trim`` only knows the ASCII blank)."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def word_count(c: ColumnOrName) -> Column:
    """Number of maximal runs of non-white-space, by the Unicode definition."""
    return F.regexp_count(_col(c), F.lit(r"(?U)\S+")).cast("bigint")


def tidy_newlines(c: ColumnOrName) -> Column:
    """At most one blank line in a row, no outer white space, one final newline."""
    collapsed = F.regexp_replace(_col(c), r"\n{3,}", "\n\n")
    return F.concat(trim_unicode(collapsed), F.lit("\n"))


def md_path(c: ColumnOrName) -> Column:
    """Swap the last extension of a path for ``.md``; directories stay."""
    return F.concat(F.regexp_replace(_col(c), r"\.[^./]*$", ""), F.lit(".md"))


def part_path(base: ColumnOrName, n: ColumnOrName, split: ColumnOrName | bool = True) -> Column:
    """``combined.md`` or, when split, ``combined-001.md`` (wider from 1000 on)."""
    base, n = _col(base), _col(n)
    split = F.lit(split) if isinstance(split, bool) else _col(split)
    ext = F.regexp_extract(base, r"(\.[^./]*)$", 1)
    stem = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    return F.when(split, F.format_string("%s-%03d%s", stem, n, ext)).otherwise(base)


def path_order_key(c: ColumnOrName) -> Column:
    """Sort key that orders paths as a directory walk does: by component, in byte order."""
    return F.split(_col(c), "/")


def split_list(c: ColumnOrName) -> Column:
    """Comma list to its trimmed, non-empty items."""
    return F.filter(F.transform(F.split(_col(c), ","), trim_unicode), lambda x: x != "")


def split_names(names: str | list[str] | tuple[str, ...] | None) -> list[str]:
    """The same rule for a Python argument, so that callers may pass ``"nav, footer"``."""
    if names is None:
        return []
    items = names.split(",") if isinstance(names, str) else names
    return [i.strip() for i in items if i.strip()]


# Character references. The table is the one in Python's standard library.
_NAMED = {"&" + name: text for name, text in _entities.html5.items()}
_BARE = sorted((n for n in _NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
_C1 = {f"{c:X}": _stdlib_html.unescape(f"&#{c};") for c in range(0x80, 0xA0)}
_REFERENCE = (
    r"&#[0-9]+;?|&#[xX][0-9A-Fa-f]+;?|&[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(map(re.escape, _BARE)) + r")|[^&]+|&"
)


def _json_map(table: dict[str, str]) -> Column:
    # One literal that the optimizer folds once, not thousands of expression nodes.
    return F.from_json(F.lit(json.dumps(table)), "map<string,string>")


def _code_point(digits: Column, base: int) -> Column:
    """Numeric reference to its character; out-of-range ones become U+FFFD."""
    significant = F.ltrim(digits, F.lit("0"))
    # at most eight digits fit the valid range in either base
    code = F.when(F.length(significant) <= 8, F.conv(F.when(significant == "", "0").otherwise(significant), base, 16))
    code = F.lpad(code, 8, "0")
    bad = (
        code.isNull()
        | (code == "00000000")
        | (code > "0010FFFF")
        | ((code >= "0000D800") & (code <= "0000DFFF"))
    )
    return F.when(bad, F.lit("�")).otherwise(
        F.coalesce(
            F.element_at(_json_map(_C1), F.ltrim(code, F.lit("0"))),
            F.decode(F.unhex(code), "UTF-32"),
        )
    )


@by_name
def unescape_html(c: ColumnOrName) -> Column:
    """Decode character references in one pass (``&amp;lt;`` gives ``&lt;``)."""
    text = _col(c)
    named = _json_map(_NAMED)

    def decode(piece: Column) -> Column:
        prefix = F.regexp_extract(piece, "^(" + "|".join(map(re.escape, _BARE)) + ")", 1)
        return (
            F.when(~piece.startswith("&") | (piece == "&"), piece)
            # by far the most frequent ones, ahead of the look-up in the full table
            .when(piece == "&amp;", "&")
            .when(piece == "&lt;", "<")
            .when(piece == "&gt;", ">")
            .when(piece == "&quot;", '"')
            .when(piece.rlike(r"^&#[0-9]"), _code_point(F.regexp_extract(piece, r"([0-9]+)", 1), 10))
            .when(piece.rlike(r"^&#[xX]"), _code_point(F.regexp_extract(piece, r"^&#[xX]([0-9A-Fa-f]+)", 1), 16))
            .otherwise(
                F.coalesce(
                    F.element_at(named, piece),
                    F.when(
                        piece.rlike("^(?:" + "|".join(map(re.escape, _BARE)) + ")"),
                        F.concat(
                            F.element_at(named, prefix),
                            F.substring(piece, F.length(prefix) + 1, F.length(piece)),
                        ),
                    ),
                    piece,
                )
            )
        )

    pieces = F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(text)
