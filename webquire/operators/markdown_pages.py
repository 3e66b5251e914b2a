"""One pass over the tokens of a page that writes its Markdown; ``markdown.to_markdown`` says where they come from.

The pass knows, at each token, what is open (lists, quotes, headings, code, links), cuts the tokens into blocks at
every block-level tag, and joins the blocks. Inside a block, inline markup is first written as non-characters
(U+FDD0...), so that white space can be moved out of it before the final signs are put in.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values -------------------------------------------------------------
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody thead tfoot tr ul video".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LISTS = frozenset(("ul", "ol"))
RULE = "* * *"
FENCE = "```"
# stand-ins for inline signs while a block is put together
S_OPEN, S_CLOSE, E_OPEN, E_CLOSE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
C_OPEN, C_CLOSE, L_OPEN, L_CLOSE, L_END = "\ufdd4", "\ufdd5", "\ufdd6", "\ufdd7", "\ufdd8"
SIGNS = {"b": (S_OPEN, S_CLOSE), "strong": (S_OPEN, S_CLOSE), "i": (E_OPEN, E_CLOSE), "em": (E_OPEN, E_CLOSE)}
CODES = dict.fromkeys(("code", "kbd", "samp", "tt"), (C_OPEN, C_CLOSE))
# white space by the Unicode definition
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# begin and end of a line, where a line ends as in java.util.regex; no line begins at the end of the text
BOL = r"(?:\A|(?<=[\n\x85\u2028\u2029])|(?<=\r)(?!\n))(?!\Z)"
EOL = r"(?=\Z|[\r\x85\u2028\u2029]|(?<!\r)\n)"
# pages in one batch of results, and characters
PAGES, CHARACTERS = 512, 8 << 20
# ------------------------------------------------------------------------------

# all but a single space
_blanks = re.compile(r"[ \t\n\f\r]{2,}|[\t\n\f\r]")
_marks = re.compile(r"([\\*\[\]`])")
_underscore = re.compile(r"(?<!\w)_|_(?!\w)")
_return = re.compile(r"\r\n?")
_code_ends = re.compile(r"\A\n|\n+(?=\Z|(?:\r\n|[\n\r\x85\u2028\u2029])\Z)")
_inline = re.compile(f"[{S_OPEN}-{L_END}]")
_opens, _closes = f"[{S_OPEN}{E_OPEN}{C_OPEN}{L_OPEN}]", f"[{S_CLOSE}{E_CLOSE}{C_CLOSE}]"
_loosen = [
    (re.compile(p), to)
    for p, to in (
        (f"{S_OPEN}([ \n]*){S_CLOSE}|{E_OPEN}([ \n]*){E_CLOSE}|{C_OPEN}([ \n]*){C_CLOSE}", r"\1\2\3"),
        (f"{L_OPEN}([ \n]*){L_CLOSE}[^{L_END}]*{L_END}", r"\1"),
        (f"({_opens}+)([ \n]+)", r"\2\1"),
        (f"([ \n]+)({_closes}+)", r"\2\1"),
        (f"([ \n]+)({L_CLOSE}[^{L_END}]*{L_END})", r"\2\1"),
    )
]
_spaces, _break = re.compile(" {2,}"), re.compile(" ?\n ?")
# ends of lines other than a line feed
_other_ends = re.compile("[\r\x85\u2028\u2029]")
_signed = re.compile(rf"{BOL}[#>+\-0-9]")
_block_signs = [(re.compile(rf"{BOL}(#{{1,6}}(?= |{EOL})|>|[-+](?= ))"), r"\\\1"), (re.compile(rf"{BOL}([0-9]{{1,9}})([.)])(?= )"), r"\1\\\2")]
_paragraph, _line = re.compile(r"\n{2,}"), re.compile(r"(?<!\n)\n(?!\n)")
_signs = [
    (re.compile(p), to)
    for p, to in (
        (f"{C_OPEN}([^{C_CLOSE}]*`[^{C_CLOSE}]*){C_CLOSE}", r"`` \1 ``"),
        (f"[{C_OPEN}{C_CLOSE}]", "`"),
        (f"[{S_OPEN}{S_CLOSE}]", "**"),
        (f"[{E_OPEN}{E_CLOSE}]", "*"),
        (L_OPEN, "["),
        (L_CLOSE, "]"),
        (L_END, ")"),
    )
]
_lines_of_title = re.compile(r" *\n+")
_bare_lines = re.compile(rf"{BOL}((?:> )*>) +{EOL}|{BOL} +{EOL}")


def polish(text: str) -> str:
    """Move white space out of inline markup, drop empty markup, put the signs in."""
    if inline := not text.isascii() and _inline.search(text):
        for pattern, to in _loosen:
            text = pattern.sub(to, text)
    if "  " in text:
        text = _spaces.sub(" ", text)
    if "\n" in text:
        text = _break.sub("\n", text)
    text = text.strip(" \n")
    if text[:1] in "#>+-0123456789" or (("\n" in text or _other_ends.search(text)) and _signed.search(text)):
        for pattern, to in _block_signs:
            text = pattern.sub(to, text)
    if "\n" in text:
        text = _line.sub("  \n", _paragraph.sub("\n\n", text))
    if inline and _inline.search(text):
        for pattern, to in _signs:
            text = pattern.sub(to, text)
    return text


class Context:
    """What a token stands in."""

    __slots__ = ("heading", "in_code", "in_pre", "indent", "item", "link", "list", "list_depth", "nth", "outer", "quote_id", "quotes", "width")


class List:
    __slots__ = ("at", "first", "item", "items", "ordered", "width")

    def __init__(self, at: int, ordered: bool, first: int):
        self.at, self.ordered, self.first, self.item, self.items, self.width = at, ordered, first, None, 0, 2


def contexts(tokens: list[tuple]) -> tuple[list[Context], list[int]]:
    """The context and the block number of each token."""
    found, blocks, steps = [], [], []
    block = depth = quotes = 0
    pre_to = code_to = -2
    rules = 0
    heading = link = outer_quotes = quote_id = None
    opened: dict[int, List] = {}
    lists: dict[int, List] = {}
    for pos, kind, tag, open_pos, close_pos, region_end, _, tail, number, _, _ in tokens:
        own = None
        rule_here = False
        step = 0
        if tag:
            start = kind == "start"
            paired_end = kind == "end" and open_pos is not None
            closes = region_end if close_pos is None else close_pos
            if tag in BLOCK_TAGS and kind in ("start", "end", "void"):
                block += 1
            rule_here = tag == "hr"
            if tag in LISTS:
                if start:
                    depth += 1
                    opened[depth] = lists.setdefault(pos, List(pos, tag == "ol", number))
                    if depth == 1:
                        outer_quotes = quotes
                    step = 1
                elif paired_end:
                    depth -= 1
                    own = depth + 1
                    step = -1
            elif tag == "blockquote":
                if start:
                    quotes += 1
                    if quotes == 1:
                        quote_id = pos
                elif paired_end:
                    quotes -= 1
            if start:
                if tag == "pre":
                    pre_to = max(pre_to, closes)
                elif tag in CODES:
                    code_to = max(code_to, -1 if close_pos is None else close_pos)
                elif tag in HEADINGS:
                    heading = (closes, int(tag[1]))
                if tail is not None:
                    link = (pos, -1 if close_pos is None else close_pos, tail)
        c = Context()
        own = depth if own is None else own
        c.list = here = opened.get(own) if own > 0 else None
        if here is not None and kind == "start" and tag == "li":
            here.item, here.items = pos, here.items + 1
        c.list_depth, c.quotes, c.quote_id, c.link = depth, quotes, quote_id, link
        c.in_pre, c.in_code = pre_to >= pos, code_to >= pos
        c.heading = heading[1] if heading is not None and heading[0] >= pos else None
        c.outer = (outer_quotes or 0) if depth > 0 else quotes
        c.item, c.nth = (None, None) if here is None else (here.item, here.items + here.first - 1)
        found.append(c)
        blocks.append(block + rules)
        steps.append(step)
        rules += rule_here
    indent = None  # a sum of nothing but unknown widths is unknown
    for c, step in zip(found, steps):
        here = c.list
        if here is not None and here.ordered and here.width == 2:
            here.width = len(str(here.items + here.first - 1)) + 2
        c.width = None if here is None else here.width
        if not step:
            indent = indent or 0
        elif c.width is not None:
            indent = (indent or 0) + step * c.width
        c.indent = indent
    return found, blocks


def block_text(tokens: list[tuple], found: list[Context]) -> str:
    """The tokens of a block, each with its context, as text; markup opened or closed elsewhere is completed here."""
    head, first, last = found[0], tokens[0][0], tokens[-1][0]
    parts, unclosed, rule, lang = [], [], False, ""
    for (pos, kind, tag, open_pos, close_pos, _, text, tail, _, named, _), c in zip(tokens, found):
        if kind == "text" or kind == "raw":
            if c.in_pre:
                parts.append(_return.sub("\n", text))
            else:
                text = _blanks.sub(" ", text)
                if not c.in_code:
                    text = _marks.sub(r"\\\1", text)
                    if "_" in text:
                        text = _underscore.sub(r"\\_", text)
                parts.append(text)
            continue
        if not tag:
            continue
        if kind == "void" and tag == "hr":
            rule = True
        if c.in_pre:
            if kind == "start" and named is not None:
                lang = max(lang, named)
            sign = "t"
        elif signs := CODES.get(tag) or (SIGNS.get(tag) if not c.in_code else None):
            sign = "o" if kind == "start" else "c" if kind == "end" else "t"
        elif c.in_code:
            sign = "t"
        elif kind == "start" and tail is not None:
            sign, signs = "o", (L_OPEN, c.link[2])
        elif kind == "end" and tag == "a" and c.link is not None and open_pos == c.link[0]:
            sign, signs = "l", ("", c.link[2])
        else:
            sign = "t"
        if sign == "t":
            if tag == "br":
                if kind in ("void", "end"):
                    parts.append("\n")
            elif tag == "hr":
                if kind == "void":
                    parts.append(RULE)
            elif kind == "start" and tag in ("td", "th"):
                parts.append(" ")
            continue
        mate = close_pos if close_pos is not None else open_pos if open_pos is not None else -1
        if sign == "o":
            parts.append(signs[0])
            if mate < 0 or mate > last:
                unclosed.append(signs[1])
        elif sign == "l" or mate >= first:
            parts.append(signs[1])
    parts += reversed(unclosed)
    if head.link is not None and head.link[0] < first < head.link[1] and not head.in_pre:  # a link around the whole block is opened again in it
        parts.insert(0, L_OPEN)
        if head.link[1] > last:
            parts.append(head.link[2])
    if rule:
        return RULE
    raw = "".join(parts)
    if not found[-1].in_pre:
        return polish(raw)
    code = _code_ends.sub("", raw)
    fence = FENCE + "`" if FENCE in code else FENCE
    return f"{fence}{lang}\n{code}\n{fence}" if code.strip(WHITE) else ""


def page_text(tokens: list[tuple]) -> tuple[Any, str]:
    """What stands for one page, and its Markdown from its tokens in order, before its line breaks are made tidy."""
    found, blocks = contexts(tokens)
    out, pages, above, marked, n, kept = [], [], None, set(), len(tokens), 0
    a = 0
    while a < n:
        b = a + 1
        while b < n and blocks[b] == blocks[a]:
            b += 1
        text, c, page = block_text(tokens[a:b], found[a:b]), found[b - 1], tokens[b - 1][-1]
        a = b
        if page is not None:
            pages.append(page)
        if text:
            mark = c.item is not None and c.item not in marked
            marked.add(c.item)
            if c.indent is not None:
                out += (_gap(c, above, mark) if kept else "", _lines(c, text, mark))
        elif page is None:
            continue
        above, kept = c, kept + 1
    # rows that share a key are one page; the largest of theirs stands for it
    largest = pages[0] if len(pages) == 1 else max(pages, key=lambda p: [(v is not None, v) for v in p.values()], default=None)
    return largest, "".join(out)


def _lines(c: Context, text: str, marked: bool) -> str:
    outer, inner = "> " * c.outer, "> " * (c.quotes - c.outer)
    rest = outer + " " * c.indent + inner
    lead = rest
    if marked:
        sign = f"{c.nth}." if c.list.ordered else "-"
        lead = outer + " " * (c.indent - c.width) + sign.ljust(c.width)[: c.width] + inner
    title = ""
    if c.heading is not None and not c.in_pre:
        title, text = "#" * c.heading + " ", _lines_of_title.sub(" ", text)
    text = text.replace("\n", "\n" + rest)
    if " \n" in text or text.endswith(" ") or _other_ends.search(text):
        text = _bare_lines.sub(r"\1", text)
    return lead + title + text


def _gap(c: Context, above: Context, marked: bool) -> str:
    if marked and above.list_depth > 0 and above.quotes == c.quotes:
        if above.list_depth != c.list_depth or (above.list is not None and above.list is c.list):
            return "\n"
    if above.quote_id is not None and above.quote_id == c.quote_id and above.quotes > 0 and c.quotes > 0:
        shared = min(c.outer, above.outer)
        if shared > 0:
            return "\n" + ("> " * shared).rstrip(" ") + "\n"
    return "\n\n"


def _values(column: pa.Array) -> list:
    """``to_pylist``, faster for strings, for whole numbers and for what is mostly null."""
    if pa.types.is_string(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_integer(column.type):
        numbers = column.fill_null(0).to_numpy(zero_copy_only=False).astype(object)
        numbers[~column.is_valid().to_numpy(zero_copy_only=False)] = None
        return numbers.tolist()
    values = [None] * len(column)
    for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)).tolist():
        values[i] = column[i].as_py()
    return values


def pages_text(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows ``key, pos, kind, tag, open_pos, close_pos, region_end, text, link, number, lang, page``, sorted by key and
    position, to one row ``key, page, markdown`` of each key."""
    done: list[tuple[Any, Any, str]] = []
    key, tokens, size = None, [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def close() -> None:
        done.append((key, *page_text(tokens)))

    for rows in batches:
        for of, *token in zip(*map(_values, rows.columns)):
            if tokens and of != key:
                close()
                tokens, size = [], size + len(done[-1][2])
                if len(done) >= PAGES or size > CHARACTERS:
                    size = 0
                    yield batch()
            key = of
            tokens.append(token)
    if tokens:
        close()
    if done:
        yield batch()
