"""URL and key functions as Catalyst expressions (Column -> Column).

Everything here is built from ``regexp_*``, ``split``/``aggregate`` and
friends, so it stays inside whole-stage codegen and is pushed into scans
wherever Catalyst can push it. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import PY_WS, py_strip

# --- fixed values that must equal the reference's behaviour -------------
# File extensions that mark a link as an asset, not a documentation page.
ASSET_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "svg", "ico", "webp",
    "css", "js", "json", "xml", "zip", "tar", "gz",
    "pdf", "mp4", "mp3", "woff", "woff2", "ttf", "eot",
]
# Schemes for which relative resolution applies (Python's urljoin list).
RELATIVE_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https",
    "shttp", "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn",
    "svn+ssh", "ws", "wss",
]
# Schemes that carry an authority (Python's uses_netloc list).
NETLOC_SCHEMES = [
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file",
    "mms", "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu",
    "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss",
    "itms-services",
]
# ------------------------------------------------------------------------

# One regex splits a URL into scheme, authority, path, query, fragment.
# Groups: 1 scheme, 2 "//" marker, 3 authority, 4 path, 5 "?", 6 query,
# 7 "#", 8 fragment.
URL_PARTS_RE = (r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)"
                r"(\?([^#]*))?(#(.*))?")

ASSET_RE = r"\.(" + "|".join(ASSET_EXTENSIONS) + r")$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Binds ``value`` once and evaluates ``body(x)`` on it.

    URL functions refer to their input many times; nesting them (or letting
    the optimizer push a filter through an alias) would copy the input
    expression into every reference. A one-element ``transform`` is a
    ``let``: the input is computed once and the body sees a variable.
    """
    return F.get(F.transform(F.array(value), body), 0)


def materialize_cols(df, cols: dict):
    """Adds computed columns through a one-row ``inline`` generator, so a
    later filter on them cannot be pushed below and re-evaluate them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def _part(url, idx: int) -> Column:
    return F.regexp_extract(_c(url), URL_PARTS_RE, idx)


def url_scheme(url) -> Column:
    """Scheme, lower-cased as Python's parser does; '' when absent."""
    return F.lower(_part(url, 1))


def url_authority(url) -> Column:
    """``netloc``: host with port and userinfo, case kept, '' if none (URL-2)."""
    return _part(url, 3)


def url_path(url) -> Column:
    return _part(url, 4)


def url_query(url) -> Column:
    return _part(url, 6)


def _has(url, idx: int) -> Column:
    return F.length(_part(url, idx)) > 0


def same_domain(url, base) -> Column:
    return url_authority(url) == url_authority(base)


def normalize_url(url) -> Column:
    """URL-1: cut the fragment; strip trailing '/' when the path is > 1 char.

    Cutting the fragment re-assembles the URL, which lower-cases the scheme
    and drops an empty '?'. The trailing-slash strip looks at the whole URL
    (so ``/docs?x=/`` loses the slash of its query) and strips all of them.
    """
    return let(_c(url), _normalize)


def _normalize(u: Column) -> Column:
    has_frag = F.instr(u, "#") > 0
    cut = F.substring_index(u, "#", 1)
    cut = F.when(cut.rlike(r"^[^?]*\?$"), F.regexp_replace(cut, r"\?$", "")).otherwise(cut)
    cut = F.when(_has(cut, 1),
                 F.concat(F.lower(_part(cut, 1)), F.lit(":"),
                          F.regexp_replace(cut, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""))
                 ).otherwise(cut)
    base = F.when(has_frag, cut).otherwise(u)
    return F.when(base.endswith("/") & (F.length(url_path(base)) > 1),
                  F.regexp_replace(base, r"/+$", "")).otherwise(base)


def is_asset(url) -> Column:
    """URL-3: lower-cased path ends in one of the asset extensions."""
    return F.lower(url_path(url)).rlike(ASSET_RE)


def in_base_path(url, base, fold_base: bool = False,
                 strict_segments: bool = False) -> Column:
    """URL-4: lower-cased path starts with the base path minus trailing '/'.

    Kept quirks: the base path is not lower-cased and there is no segment
    boundary. ``fold_base`` / ``strict_segments`` give the repaired forms.
    """
    path = F.lower(url_path(url))
    bp = url_path(base)
    pref = F.regexp_replace(F.lower(bp) if fold_base else bp, r"/+$", "")
    ok = path.startswith(pref)
    if strict_segments:
        ok = ok & ((F.length(path) == F.length(pref))
                   | (F.substring(path, F.length(pref) + 1, 1) == "/")
                   | (F.length(pref) == 0))
    return (F.length(bp) == 0) | ok


def is_doc_link(url, base, **kw) -> Column:
    """URL-5 = not an asset, same authority, under the base path."""
    return let(F.struct(_c(url).alias("u"), _c(base).alias("b")),
               lambda s: (~is_asset(s.u)) & same_domain(s.u, s.b) & in_base_path(s.u, s.b, **kw))


def page_id(url) -> Column:
    """URL-7: first 10 hex digits of md5 of the UTF-8 URL."""
    return F.substring(F.md5(F.encode(_c(url), "UTF-8")), 1, 10)


def project_name(url) -> Column:
    """URL-8: authority with every ``www.`` removed."""
    return F.replace(url_authority(url), F.lit("www."), F.lit(""))


def seed_clean(raw) -> Column:
    """URL-10: trim; add https:// unless http(s):// is there."""
    t = py_strip(_c(raw))
    return F.when(t.startswith("http://") | t.startswith("https://"), t) \
            .otherwise(F.concat(F.lit("https://"), t))


def seed_valid(raw) -> Column:
    """URL-10: the cleaned seed has a dot and no space."""
    t = seed_clean(raw)
    return (F.instr(t, ".") > 0) & (F.instr(t, " ") == 0)


def download_name_single(name) -> Column:
    """URL-11, server single-file export: spaces -> '_' + '_docs.md'."""
    return F.concat(F.replace(_c(name), F.lit(" "), F.lit("_")), F.lit("_docs.md"))


def download_name_zip(name) -> Column:
    from .text import slugify
    return F.concat(slugify(_c(name)), F.lit("_docs.zip"))


def download_name_client(name) -> Column:
    """URL-11, client side: whitespace runs -> '_', empty -> 'export'."""
    from .text import JS_WS
    n = F.regexp_replace(_c(name), "[" + JS_WS + "]+", "_")
    return F.concat(F.when(F.length(n) > 0, n).otherwise(F.lit("export")),
                    F.lit("_docs.md"))


def _dot_segments(segs: Column) -> Column:
    """Fold '.' and '..' out of a path-segment array (RFC 3986 5.2.4)."""
    folded = F.aggregate(
        segs, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 0,
                                                F.slice(acc, 1, F.size(acc) - 1))
                              .otherwise(acc))
                        .when(s == ".", acc)
                        .otherwise(F.array_append(acc, s)))
    last = F.element_at(segs, -1)
    return F.when(last.isin(".", ".."), F.array_append(folded, F.lit(""))).otherwise(folded)


def resolve_url(base, ref) -> Column:
    """URL-6: reference resolution with the rules of Python's ``urljoin``.

    Absolute, ``//host``, ``/root``, relative, ``../``, ``?q``, ``#f`` and
    empty references. Path merging drops empty middle segments of a
    relative merge, as Python does.
    """
    return let(F.struct(_c(base).alias("b"), _c(ref).alias("r")), lambda s: _resolve(s.b, s.r))


def _resolve(b: Column, r: Column) -> Column:
    bs, rs_raw = url_scheme(b), _part(r, 1)
    rs = F.when(F.length(rs_raw) > 0, F.lower(rs_raw)).otherwise(bs)
    r_has_auth = _has(r, 2)
    r_auth, r_path, r_q, r_f = _part(r, 3), _part(r, 4), _part(r, 6), _part(r, 8)
    b_auth, b_path, b_q = _part(b, 3), _part(b, 4), _part(b, 6)

    def unparse(scheme, auth, path, q, f):
        need_slashes = (F.length(auth) > 0) | scheme.isin(*NETLOC_SCHEMES)
        path2 = F.when((F.length(auth) > 0) & (F.length(path) > 0) & ~path.startswith("/"),
                       F.concat(F.lit("/"), path)).otherwise(path)
        head = F.when(F.length(scheme) > 0, F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
        mid = F.when(need_slashes & ((F.length(auth) > 0) | path2.startswith("/")),
                     F.concat(F.lit("//"), auth, path2)).otherwise(path2)
        return F.concat(head, mid,
                        F.when(F.length(q) > 0, F.concat(F.lit("?"), q)).otherwise(F.lit("")),
                        F.when(F.length(f) > 0, F.concat(F.lit("#"), f)).otherwise(F.lit("")))

    # merged path for a relative reference
    bparts = F.split(b_path, "/")
    bparts = F.when(F.element_at(bparts, -1) != "", F.slice(bparts, 1, F.size(bparts) - 1)) \
              .otherwise(bparts)
    rel = F.concat(bparts, F.split(r_path, "/"))
    n = F.size(rel)
    rel = F.filter(rel, lambda s, i: (i == 0) | (i == n - 1) | (s != ""))
    segs = F.when(r_path.startswith("/"), F.split(r_path, "/")).otherwise(rel)
    merged = F.array_join(_dot_segments(segs), "/")
    merged = F.when(merged == "", F.lit("/")).otherwise(merged)

    no_path = F.length(r_path) == 0
    resolved = F.when(r_has_auth & (F.length(r_auth) > 0),
                      unparse(rs, r_auth, r_path, r_q, r_f)) \
        .when(no_path, unparse(rs, b_auth, b_path,
                               F.when(F.length(r_q) > 0, r_q).otherwise(b_q), r_f)) \
        .otherwise(unparse(rs, b_auth, merged, r_q, r_f))
    return (F.when(F.length(b) == 0, r)
            .when(F.length(r) == 0, b)
            .when((rs != bs) | ~rs.isin(*RELATIVE_SCHEMES), r)
            .otherwise(resolved))


__all__ = [
    "ASSET_EXTENSIONS", "URL_PARTS_RE", "url_scheme", "url_authority", "url_path",
    "url_query", "same_domain", "normalize_url", "is_asset", "in_base_path",
    "is_doc_link", "page_id", "project_name", "seed_clean", "seed_valid",
    "download_name_single", "download_name_zip", "download_name_client",
    "resolve_url", "PY_WS",
]
