"""Text helpers as Catalyst expressions: strip, slug, Markdown clean-up,
frontmatter, frontmatter removal, hit counts, code language.

Java's ``\\s`` is ASCII-only and ``trim`` only removes spaces, while the
reference strips with Python's ``str.strip``; ``PY_WS`` spells Python's
whitespace set out so the same pattern text works in Java and in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------
# Python's str.isspace() set, as a regex class body (Java and RE2 syntax).
PY_WS = (r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
PY_WS_NO_NL = (r"\t\x0b\f\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}"
               r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
# JavaScript's \s set (the browser client's whitespace), as a class body.
JS_WS = (r"\t\n\x0b\f\r \xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
         r"\x{205f}\x{3000}\x{feff}")
# Class prefixes that name a code block's language.
CODE_LANGUAGE_PREFIXES = ["language-", "lang-", "highlight-"]
# Separator of the single-file export.
EXPORT_SEPARATOR = "\n\n---\n\n"
# ---------------------------------------------------------------------------

STRIP_RE = r"^[" + PY_WS + r"]+|[" + PY_WS + r"]+$"
# Python \w: letters, numbers, underscore (Unicode); \s as above.
SLUG_DROP_RE = r"[^\p{L}\p{N}_" + PY_WS + r"\-]"
SLUG_RUN_RE = r"[" + PY_WS + r"_\-]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(s) -> Column:
    """Python ``str.strip()``: both ends, Unicode whitespace."""
    return F.regexp_replace(_c(s), r"\A[" + PY_WS + r"]+|[" + PY_WS + r"]+\z", "")


def py_rstrip(s) -> Column:
    return F.regexp_replace(_c(s), r"[" + PY_WS + r"]+\z", "")


def collapse_ws(s) -> Column:
    """Runs of whitespace to one space, then stripped (for text compares)."""
    return py_strip(F.regexp_replace(_c(s), r"[" + PY_WS + r"]+", " "))


def slugify(s) -> Column:
    """URL-9: lower, strip, drop non-word, collapse runs to '-', 80 chars.

    Empty -> 'untitled'. Leading/trailing '-' may remain, as in the
    reference.
    """
    t = py_strip(F.lower(_c(s)))
    t = F.regexp_replace(t, SLUG_DROP_RE, "")
    t = F.regexp_replace(t, SLUG_RUN_RE, "-")
    t = F.substring(t, 1, 80)
    return F.when(F.length(t) > 0, t).otherwise(F.lit("untitled"))


def clean_markdown(s) -> Column:
    """HTM-9: 3+ newlines -> 2; rstrip every line; strip; one final newline.

    Lines are stripped *after* collapsing, so lines of blanks can leave
    3+ newlines behind, as in the reference.
    """
    t = F.regexp_replace(_c(s), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"[" + PY_WS_NO_NL + r"]+(\n|\z)", "$1")
    return F.concat(py_strip(t), F.lit("\n"))


def frontmatter(title, source, date, escape: bool = False) -> Column:
    """HTM-10: '---', title, optional source, scraped_at, '---'.

    ``date`` is a 'yyyy-MM-dd' string column. Quotes in the title are kept
    as they are unless ``escape``.
    """
    t = _c(title)
    if escape:
        t = F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    src = _c(source)
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit('title: "'), t, F.lit('"')),
        F.when(src.isNotNull() & (F.length(src) > 0),
               F.concat(F.lit('source: "'), src, F.lit('"'))),
        F.concat(F.lit('scraped_at: "'), _c(date), F.lit('"')),
        F.lit("---"),
    )


# First block from a line-start '---' to the next '---', plus newlines.
_FM_RE = r"\A([\s\S]*?(?:(?<=[\n\r\u2028\u2029])|\A))(---[\s\S]*?---\n*)"


def strip_frontmatter(s) -> Column:
    """HTM-12: remove the first frontmatter-like block (one removal only).

    ``regexp_replace`` would remove every match, so the prefix before the
    first match and the match itself are measured and the text rebuilt.
    Line starts are after a line feed, a carriage return, U+2028 or U+2029.
    """
    c = _c(s)
    pre = F.regexp_extract(c, _FM_RE, 1)
    blk = F.regexp_extract(c, _FM_RE, 2)
    return F.when(F.length(blk) == 0, c).otherwise(
        F.concat(pre, F.substring(c, F.length(pre) + F.length(blk) + 1, 1 << 30)))


def hit_count(content, term) -> Column:
    """LIB-7: non-overlapping, case-insensitive occurrences of the trimmed term."""
    q = F.lower(py_strip(_c(term)))
    t = F.lower(_c(content))
    n = (F.length(t) - F.length(F.replace(t, q, F.lit("")))) / F.length(q)
    return F.when(F.length(q) == 0, F.lit(0)).otherwise(n.cast("long"))


def first_hit(content, term) -> Column:
    """LIB-7: 1-based offset of the first hit, 0 if none or blank term."""
    q = F.lower(py_strip(_c(term)))
    return F.when(F.length(q) == 0, F.lit(0)).otherwise(F.instr(F.lower(_c(content)), q)).cast("long")


def code_language(classes, extra_classes=None) -> Column:
    """HTM-7: first class starting language-/lang-/highlight- (any case),
    rest of it lower-cased; NULL if none. ``extra_classes`` (e.g. the inner
    ``code`` element's) are looked at after the first list."""
    cls = _c(classes)
    if extra_classes is not None:
        cls = F.concat(F.coalesce(cls, F.array().cast("array<string>")),
                       F.coalesce(_c(extra_classes), F.array().cast("array<string>")))
    pat = r"^(" + "|".join(p.replace("-", r"\-") for p in CODE_LANGUAGE_PREFIXES) + r")"
    hit = F.get(F.filter(cls, lambda x: F.lower(x).rlike(pat)), 0)
    return F.regexp_replace(F.lower(hit), pat, "")


__all__ = [
    "PY_WS", "PY_WS_NO_NL", "JS_WS", "EXPORT_SEPARATOR", "py_strip", "py_rstrip", "collapse_ws",
    "slugify", "clean_markdown", "frontmatter", "strip_frontmatter", "hit_count",
    "first_hit", "code_language",
]
