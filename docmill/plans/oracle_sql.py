"""SQL snippet builders for the DuckDB oracle queries.

The oracle side is written independently of the Spark side where it can
be: HTML facts come from regular expressions over the raw page text, not
from a parser. RE2 (DuckDB) has no look-around and its ``\\s`` is ASCII,
so whitespace classes are spelled out.
"""

from __future__ import annotations

from ..functions.text import PY_WS, PY_WS_NO_NL
from ..functions.urls import ASSET_EXTENSIONS, URL_PARTS_RE


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(r'\A[' + PY_WS + r']+|[' + PY_WS + r']+\z')}, '', 'g')"


def collapse(e: str) -> str:
    return strip(f"regexp_replace({e}, {q('[' + PY_WS + ']+')}, ' ', 'g')")


def entities(e: str) -> str:
    """The four entities the test pages use; &amp; last."""
    return (f"replace(replace(replace(replace({e}, '&quot;', '\"'), '&copy;', '©'), "
            f"'&middot;', '·'), '&amp;', '&')")


def url_part(e: str, idx: int) -> str:
    return f"regexp_extract({e}, {q(URL_PARTS_RE)}, {idx})"


def slugify(e: str) -> str:
    t = strip(f"lower({e})")
    t = f"regexp_replace({t}, {q(r'[^\p{L}\p{N}_' + PY_WS + r'\-]')}, '', 'g')"
    t = f"regexp_replace({t}, {q('[' + PY_WS + r'_\-]+')}, '-', 'g')"
    t = f"substring({t}, 1, 80)"
    return f"(CASE WHEN length({t}) > 0 THEN {t} ELSE 'untitled' END)"


def normalize(e: str) -> str:
    """URL-1 written out in SQL."""
    cut = f"split_part({e}, '#', 1)"
    cut = f"(CASE WHEN regexp_matches({cut}, '^[^?]*\\?$') THEN left({cut}, length({cut}) - 1) ELSE {cut} END)"
    sch = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
    cut = (f"(CASE WHEN regexp_matches({cut}, {q(sch)}) THEN lower(regexp_extract({cut}, "
           f"{q('^([A-Za-z][A-Za-z0-9+.\\-]*):')}, 1)) || ':' || regexp_replace({cut}, {q(sch)}, '') "
           f"ELSE {cut} END)")
    b = f"(CASE WHEN strpos({e}, '#') > 0 THEN {cut} ELSE {e} END)"
    return (f"(CASE WHEN suffix({b}, '/') AND length({url_part(b, 4)}) > 1 "
            f"THEN rtrim({b}, '/') ELSE {b} END)")


def is_asset(e: str) -> str:
    pat = r"\.(" + "|".join(ASSET_EXTENSIONS) + r")$"
    return f"regexp_matches(lower({url_part(e, 4)}), {q(pat)})"


def clean_markdown(e: str) -> str:
    t = f"regexp_replace({e}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, {q('[' + PY_WS_NO_NL + r']+(\n|\z)')}, '\\1', 'g')"
    return f"({strip(t)} || chr(10))"


FM_RE = r"(?m)\A([\s\S]*?)^(---[\s\S]*?---\n*)"


def strip_frontmatter(e: str) -> str:
    pre = f"regexp_extract({e}, {q(FM_RE)}, 1)"
    blk = f"regexp_extract({e}, {q(FM_RE)}, 2)"
    return (f"(CASE WHEN length({blk}) = 0 THEN {e} ELSE {pre} || "
            f"substr({e}, length({pre}) + length({blk}) + 1) END)")


def anchors_cte(src: str = "pages", html: str = "html") -> str:
    """(page_id, url, pos, href) for every <a ... href="..."> in the text."""
    return (f"SELECT page_id, url, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS pos "
            f"FROM (SELECT page_id, url, regexp_extract_all({html}, "
            f"{q(r'<a\s[^>]*href=\"([^\"]*)\"')}, 1) AS h FROM {src})")
