"""Marks and attributes of HTML tags, as patterns and column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquire.functions.text import unescape_html

WS = r" \t\n\f\r"
END_OF_PAGE = 2147483647
ATTRIBUTE = rf"([^{WS}/>=][^{WS}/>=]*)(?:[{WS}]*=[{WS}]*(\"[^\"]*\"|'[^']*'|[^{WS}>]+))?"


def bare_value(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def attribute(token: Column, name: str, decode: bool = True) -> Column:
    """Value of the first attribute of that name in a start tag, ``''`` if there is none.

    ``decode=False`` leaves character references alone (class and role names hold none).
    """
    other = rf"(?!{name}[{WS}=/>])[^{WS}/>=]++(?:[{WS}]*+=[{WS}]*+(?:\"[^\"]*+\"|'[^']*+'|[^{WS}>\"'][^{WS}>]*+))?+"
    pattern = (
        rf"(?is)^<[a-z][^{WS}/>]*+(?:[{WS}/=]++|{other})*+"
        rf"{name}[{WS}]*+=[{WS}]*+(\"[^\"]*+\"|'[^']*+'|[^{WS}>\"'][^{WS}>]*+)"
    )
    value = bare_value(F.regexp_extract(token, pattern, 1))
    return unescape_html(value) if decode else value


def attributes(token: Column) -> Column:
    """All attributes of a start tag as a map; names lower-case, the first of a name wins."""
    inner = F.regexp_replace(token, rf"^<[A-Za-z][^{WS}/>]*|/?>$", "")
    names = F.transform(F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(1)), lambda n: F.lower(n))
    values = F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(2))
    first = F.filter(
        F.arrays_zip(names.alias("name"), values.alias("value"), F.sequence(F.lit(1), F.size(names)).alias("nth")),
        lambda a: F.array_position(names, a["name"]) == a["nth"],
    )
    pairs = F.transform(first, lambda a: F.struct(a["name"], unescape_html(bare_value(a["value"]))))
    empty = F.create_map().cast("map<string,string>")
    return F.when(F.size(names) > 0, F.map_from_entries(pairs)).otherwise(empty)
