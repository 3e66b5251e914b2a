"""URL column functions.

Every component is one regular expression on the URL string, because
``parse_url`` raises (ANSI mode) on inputs such as ``https://x.com/a b`` that
must be accepted and percent-encoded here.  Invalid input gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquire.functions.text import ColumnOrName, _col, by_name, trim_unicode

SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
CONTROL = r"[\x00-\x1f\x7f]"
BAD_ESCAPE = r"%(?![0-9A-Fa-f]{2})"
# Characters a default-encoded path leaves bare, and those a raw path may hold.
PATH_BARE = r"A-Za-z0-9\-_.~$&+,/:;=@"
PATH_RAW = PATH_BARE + r"!'()*\[\]%"
HOST_BARE = r"A-Za-z0-9\-_.~!$&'()*+,;=:\[\]<>\""
USER_BARE = r"A-Za-z0-9\-._:~!$&'()*+,;=%@"


def _scheme(u: Column) -> Column:
    return F.regexp_extract(u, f"^({SCHEME}):", 1)


def _authority(u: Column) -> Column:
    return F.regexp_extract(u, f"^{SCHEME}://([^/?#]*)", 1)


def _path(u: Column) -> Column:
    return F.regexp_extract(u, f"^{SCHEME}://[^/?#]*([^?#]*)", 1)


def _query(u: Column) -> Column:
    """Query with its leading ``?`` (kept verbatim, also when it is only ``?``)."""
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def _fragment(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^#]*#(.*)", 1)


def _host(authority: Column) -> Column:
    """Host with port: what follows the last ``@``."""
    return F.substring_index(authority, "@", -1)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A Column used many times is otherwise copied into the plan many times over.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _fields(**fields: Column) -> Column:
    """Struct whose names also hold inside lambda functions."""
    return F.named_struct(*[c for name, value in fields.items() for c in (F.lit(name), value)])


def _host_ok(authority: Column) -> Column:
    def check(host: Column) -> Column:
        return (
            (host != "")
            & ~host.rlike(rf"[^{HOST_BARE}%\x{{80}}-\x{{10FFFF}}]")
            & ~host.rlike(r"%(?![89A-Fa-f][0-9A-Fa-f])")
            & ~F.regexp_replace(host, r"^\[.*\]", "").rlike(r"^\[|:[^:]*[^:0-9][^:]*$")
        )

    user_ok = ~F.regexp_extract(authority, r"^(.*)@", 1).rlike(rf"[^{USER_BARE}]")
    return let(_host(authority), check) & user_ok


def _encode(c: Column, bare: str) -> Column:
    """Default percent-encoding, byte-exact: a bare character stays, an escape of a
    bare character is undone, everything else becomes upper-case escapes."""

    def piece(x: Column) -> Column:
        char = F.chr(F.conv(F.substring(x, 2, 2), 16, 10).cast("int"))
        return (
            F.when((F.length(x) == 3) & char.rlike(f"^[{bare}]$"), char)
            .when(F.length(x) == 3, F.upper(x))
            .when(x.rlike(f"^[{bare}]$"), x)
            .otherwise(F.regexp_replace(F.hex(F.encode(x, "UTF-8")), "(..)", "%$1"))
        )

    pieces = F.regexp_extract_all(c, F.lit(r"(?s)%[0-9A-Fa-f]{2}|."), F.lit(0))
    return F.when(c.rlike(f"^[{bare}]*$"), c).otherwise(F.array_join(F.transform(pieces, piece), ""))


@by_name
def canonical_path(c: ColumnOrName) -> Column:
    """Default encoding of a path; two paths are the same bytes iff these are equal."""
    return _encode(_col(c), PATH_BARE)


@by_name
def encode_path(c: ColumnOrName) -> Column:
    """Percent-encode a path only when it holds a character a URL may not hold."""
    path = _col(c)
    return F.when(path.rlike(f"^[{PATH_RAW}]*$"), path).otherwise(canonical_path(path))


def _normal_authority(authority: Column) -> Column:
    def normal(host: Column) -> Column:
        decoded = F.lower(F.coalesce(F.try_url_decode(F.replace(host, F.lit("+"), F.lit("%2B"))), host))
        lowered = F.when(F.contains(host, F.lit("%")), decoded).otherwise(F.lower(host))
        return let(lowered, lambda h: _encode(h, HOST_BARE))

    return F.concat(F.regexp_extract(authority, r"^(.*@)", 1), let(_host(authority), normal))


def _normal_path(path: Column) -> Column:
    """Encoded path without trailing slashes; the root path stays ``/``.

    A trimmed path is re-encoded by default rules, one that was not keeps its spelling.
    """
    trimmed = F.rtrim(canonical_path(path), F.lit("/"))
    return (
        F.when(path.isin("", "/"), F.lit("/"))
        .when(path.rlike("(?:/|%2[fF])$"), F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("/")))
        .otherwise(encode_path(path))
    )


def _normal(parts: Column) -> Column:
    """Normalised URL of a struct of parts, NULL where these are not valid."""
    valid = (
        ~parts["control"]
        & _host_ok(parts["authority"])
        & ~parts["path"].rlike(BAD_ESCAPE)
        & ~parts["fragment"].rlike(BAD_ESCAPE)
    )
    text = F.concat(
        F.lower(parts["scheme"]),
        F.lit("://"),
        _normal_authority(parts["authority"]),
        _normal_path(parts["path"]),
        parts["query"],
    )
    return F.when(valid, text)


def _split(u: Column) -> Column:
    return _fields(
        scheme=_scheme(u),
        authority=_authority(u),
        path=_path(u),
        query=_query(u),
        fragment=_fragment(u),
        control=u.rlike(CONTROL),
    )


@by_name
def normalize_url(url: ColumnOrName) -> Column:
    """Canonical form: lower-case scheme and host, no fragment, no trailing slash.

    NULL when the URL has no scheme or host or is malformed.  Dot segments stay.
    """
    return let(let(trim_unicode(url), _split), _normal)


def url_parts(url: ColumnOrName) -> Column:
    """Struct of the parsed fields; ``host`` is without port, ``authority`` keeps it."""
    u = _col(url)
    authority = _authority(u)
    host = _host(authority)
    return F.struct(
        F.lower(_scheme(u)).alias("scheme"),
        authority.alias("authority"),
        F.regexp_replace(host, r":[0-9]*$", "").alias("host"),
        F.regexp_extract(host, r":([0-9]*)$", 1).alias("port"),
        _path(u).alias("path"),
        F.regexp_replace(_query(u), r"^\?", "").alias("query"),
    )


def host_of(url: ColumnOrName) -> Column:
    """Lower-case host with port, the usual grouping key of a site."""
    return F.lower(_host(_authority(_col(url))))


def _remove_dot_segments(path: Column) -> Column:
    """Resolve ``.`` and ``..``; the last one leaves a trailing slash."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(seg))),
    )
    tail = F.when(path.rlike(r"(?:^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.regexp_replace(joined, "^//", "/")).otherwise(rooted)


def _reference_parts(href: Column) -> Column:
    hier = F.regexp_extract(href, r"^([^?#]*)", 1)  # scheme, authority and path
    return _fields(
        hier=hier,
        rest=F.regexp_replace(hier, f"^{SCHEME}:", ""),
        scheme=_scheme(hier),
        query=_query(href),
        fragment=_fragment(href),
        control=href.rlike(CONTROL),
    )


def _merge(base: Column, ref: Column) -> Column:
    """Parts of the target URL; an opaque or malformed reference gets no authority."""
    rest, scheme = ref["rest"], ref["scheme"]
    # a lone "//" is an empty path, and "///x" is a path
    has_authority = rest.rlike("^//[^/]")
    own_path = F.when(has_authority, F.regexp_extract(rest, r"^//[^/]*(.*)", 1)).otherwise(
        F.when(rest == "//", F.lit("")).otherwise(rest)
    )
    malformed = (
        ((scheme == "") & ref["hier"].rlike("^[^/]*:"))
        | ((scheme != "") & ~has_authority)
        | own_path.rlike(BAD_ESCAPE)
    )

    def against_base(path: Column) -> Column:
        base_path = encode_path(_path(base))
        return (
            F.when(has_authority | path.startswith("/"), path)
            .when(path == "", base_path)
            .otherwise(F.concat(F.regexp_extract(base_path, r"^(.*/)", 1), path))
        )

    same_document = (own_path == "") & (ref["query"] == "") & ~has_authority
    return _fields(
        scheme=F.when(scheme != "", scheme).otherwise(_scheme(base)),
        authority=F.when(malformed, "")
        .when(has_authority, F.regexp_extract(rest, r"^//([^/]*)", 1))
        .otherwise(_authority(base)),
        path=let(let(encode_path(own_path), against_base), _remove_dot_segments),
        query=F.when(same_document, _query(base)).otherwise(ref["query"]),
        fragment=ref["fragment"],
        control=ref["control"],
    )


@by_name
def resolve_href(base: ColumnOrName, href: ColumnOrName) -> Column:
    """Resolve a reference against an absolute base URL, then normalise.

    NULL for opaque references (``mailto:``), malformed ones, and a base without host.
    The reference is not trimmed first.
    """
    base, href = _col(base), _col(href)
    return let(let(_reference_parts(href), lambda ref: _merge(base, ref)), _normal)


@by_name
def in_scope(base: ColumnOrName, target: ColumnOrName) -> Column:
    """Same host and port, and the target path is the base path or lies below it.

    The scheme is not compared.  A base such as ``/docs/index.html`` has only
    itself in scope.
    """
    base, target = _col(base), _col(target)
    prefix = F.concat(F.regexp_replace(canonical_path(_path(base)), "/$", ""), F.lit("/"))
    path = canonical_path(_path(target))
    return (
        (host_of(base) == host_of(target))
        & (path.startswith(prefix) | (path == F.rtrim(prefix, F.lit("/"))))
    )


def is_http(url: ColumnOrName) -> Column:
    url = _col(url)
    return url.startswith("http://") | url.startswith("https://")


@by_name
def url_to_filename(url: ColumnOrName) -> Column:
    """Relative file path of a page: host, then the decoded path, ending in ``.html``.

    Query and scheme play no part, so different URLs can share a name.
    """
    u = _col(url)
    raw = _path(u)
    decoded = F.when(
        F.contains(raw, F.lit("%")),
        F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw),
    ).otherwise(raw)
    name = F.trim(decoded, F.lit("/"))
    name = F.replace(F.when(name == "", F.lit("index")).otherwise(name), F.lit(".."), F.lit("__"))
    name = F.when(name.endswith(".html"), name).otherwise(F.concat(name, F.lit(".html")))
    joined = F.concat(_host(_authority(u)), F.lit("/"), name)
    cleaned = F.regexp_replace(F.regexp_replace(joined, r"/(?:\./)+", "/"), r"/{2,}", "/")
    cleaned = F.regexp_replace(cleaned, r"/(?:\./)+", "/")
    return F.when(~raw.rlike(BAD_ESCAPE) & (_scheme(u) != ""), cleaned)


def cache_key(url: ColumnOrName) -> Column:
    """Lower-case hex SHA-256 of the URL string."""
    return F.sha2(_col(url), 256)
