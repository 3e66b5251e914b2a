"""Column functions: URLs, text and paths."""

from webquire.functions.text import (
    md_path,
    part_path,
    path_order_key,
    split_list,
    split_names,
    tidy_newlines,
    trim_unicode,
    unescape_html,
    word_count,
)
from webquire.functions.urls import (
    cache_key,
    canonical_path,
    encode_path,
    host_of,
    in_scope,
    is_http,
    normalize_url,
    resolve_href,
    url_parts,
    url_to_filename,
)

__all__ = [
    "cache_key", "canonical_path", "encode_path", "host_of", "in_scope", "is_http", "md_path",
    "normalize_url", "part_path", "path_order_key", "resolve_href", "split_list", "split_names",
    "tidy_newlines", "trim_unicode", "unescape_html", "url_parts", "url_to_filename", "word_count",
]
