"""Fill-in-the-middle transformation with cuts found in an indexable skip list.

A text is a sequence of units, ``[A-Za-z]+|[^A-Za-z]``. Its skip list has the
unit starts as nodes. Each unit's height is drawn from a hash of its index, and
the express lane of height h links the units of at least that height. Every
link carries two widths: how many units and how many code points it spans. A
cut after r units is found from the topmost lane down, going right while the
unit widths passed add up to no more than r; the code-point widths passed on the
way add up to where the text is cut.

The text is read in blocks, so that what a task holds besides the text and the
list is bounded; the ground lane isn't kept: below the lowest express lane, a
cut is counted out in the text itself, over a link of a few units.

Which document is cut where, and in which form it is written, depends on the
hash of its id only (``draws``).

Edge cases: a null or empty text is written as it is (plain), as is one that
holds a mark; a null doc_id is hashed as an empty number; repeated rows each get
the same result; further columns are kept, and a column named like a result is
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are transformed, and of those that begin with the suffix.
RATE, SPM_RATE = 90, 20
SEED = 1
#: One in ``FAN`` units of a lane is also in the lane above.
FAN = 16
BLOCK = 1 << 16


class SkipList:
    """Lanes over the units of a text, lowest first. Lane h has the indices of
    its units (ascending) and the units and code points that each link spans;
    the last link reaches to the end."""

    def __init__(self, text: str):
        self.text = text
        heights, starts, before, letter = [], [], 0, False
        for at in range(0, len(text), BLOCK):
            c = np.frombuffer(text[at:at + BLOCK].encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = (c - 65 < 26) | (c - 97 < 26)
            start = ~is_letter
            start[1:] |= ~is_letter[:-1]
            start[0] |= not letter
            place = np.flatnonzero(start)
            letter = bool(is_letter[-1])
            height = self.height(np.arange(before, before + len(place), dtype=np.uint64))
            up = height > 0
            heights.append(height[up])
            starts.append(np.stack([np.flatnonzero(up) + before, place[up] + at]))
            before += len(place)
        #: units in all
        self.units = before
        height = np.concatenate(heights) if heights else np.zeros(0, np.int64)
        nodes = np.concatenate(starts, axis=1) if starts else np.zeros((2, 0), np.int64)
        self.lanes = []
        for h in range(1, int(height.max(initial=0)) + 1):
            lane = np.concatenate([[[0], [0]], nodes[:, height >= h], [[before], [len(text)]]], axis=1)
            self.lanes.append((lane[0, :-1], *np.diff(lane)))

    @staticmethod
    def height(i: np.ndarray) -> np.ndarray:
        """Height of the units: how often ``FAN`` divides a hash of the index."""
        with np.errstate(over="ignore"):
            x = (i + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        out = np.zeros(len(i), np.int64)
        divides = np.ones(len(i), bool)
        for h in range(1, 12):
            divides &= x % np.uint64(FAN ** h) == 0
            out += divides
        return out

    def offset(self, rank: int) -> int:
        """Code points in the first ``rank`` units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        unit, chars = 0, 0
        for index, unit_width, char_width in reversed(self.lanes):
            k = int(np.searchsorted(index, unit, "right")) - 1  # the node that the lane above came to
            while k < len(index) and unit + unit_width[k] <= rank:
                unit += int(unit_width[k])
                chars += int(char_width[k])
                k += 1
        end = len(self.text)
        while unit < rank:  # the ground lane
            if chars < end and _is_letter(self.text[chars]):
                while chars < end and _is_letter(self.text[chars]):
                    chars += 1
            else:
                chars += 1
            unit += 1
        return chars


def _is_letter(c: str) -> bool:
    return "A" <= c <= "Z" or "a" <= c <= "z"


def draws(doc_id, seed: int = SEED) -> list[int]:
    """Four numbers: the first four groups of 8 digits of the hash of the id."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i:i + 8], 16) for i in range(0, 32, 8)]


def transform(text: str, doc_id, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, str, int | None, int | None]:
    """(output, units, form, characters of the prefix, of the middle)."""
    units = SkipList(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return text, units.units, "plain", None, None
    first, second = sorted((h1 % (units.units + 1), h2 % (units.units + 1)))
    a, b = units.offset(first), units.offset(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}", units.units, "spm", a, b - a
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}", units.units, "psm", a, b - a


def restore(output: str, form: str) -> str:
    """The text again, from the output and its form alone."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "spm":
        suffix, prefix = head[len(SUFFIX):].split(PREFIX)
    else:
        prefix, suffix = head[len(PREFIX):].split(SUFFIX)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, output: str = "output") -> DataFrame:
    """``docs`` without its text, with the transformed ``output``, ``n_units``,
    ``form``, ``prefix_chars`` and ``middle_chars``."""
    def start():
        def row(v):
            r = v.as_py()
            return transform(r["text"] or "", r["doc_id"], rate, spm_rate)

        return row

    new = [T.StructField(output, T.StringType()), T.StructField("n_units", T.LongType()), T.StructField("form", T.StringType()),
           T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]
    # id and text go in one column, under the text's name
    both = docs.withColumn("text", F.struct("doc_id", "text"))
    return map_column(both, "text", False, new, start)


def restored(outputs: DataFrame, output: str = "output", out: str = "restored") -> DataFrame:
    """Add ``out``, the text rebuilt from ``output`` and ``form``."""
    def start():
        def row(v):
            r = v.as_py()
            return (restore(r["o"] or "", r["f"]),)

        return row

    both = outputs.withColumn(out, F.struct(F.col(output).alias("o"), F.col("form").alias("f")))
    return map_column(both, out, False, [T.StructField(out, T.StringType())], start)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and
    restored_sha256 of every document."""
    return restored(fill_middle(docs.select("doc_id", "text"))).select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (
  SELECT doc_id, t, len(regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]')) AS n,
    list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS h FROM h),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
         WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(k[1:lo], '') AS pre, array_to_string(k[lo + 1:hi], '') AS mid, array_to_string(k[hi + 1:], '') AS suf
  FROM (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS k FROM c))
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid
         ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
