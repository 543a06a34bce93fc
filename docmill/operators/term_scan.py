"""Many search terms in one pass over the texts (LIB-5).

The terms are taken to the tasks; a task looks at a few megabytes of texts at a
time. Each term is represented by one of its grams (three characters; shorter
terms by themselves): the one that is rarest in those texts. Only texts that
hold it are searched for the term. So the work grows with the texts and the
candidates, not with texts times terms, and no text leaves its task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Q = 3
CODE_BITS = 21
#: Bytes of text looked at together.
PIECE = 8 << 20


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(codes) - q + 1)
    out = np.zeros(n, np.int64)
    for i in range(q):
        out = (out << CODE_BITS) | codes[i:i + n]
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class TermIndex:
    """Terms by length of their grams: all distinct grams, and each term's."""

    def __init__(self, terms: list[str]):
        self.terms, self.sets = terms, []
        for q in range(1, Q + 1):
            own = [k for k, t in enumerate(terms) if (len(t) >= Q if q == Q else len(t) == q)]
            if not own:
                continue
            lists = [np.unique(_grams(_codes(terms[k]), q)) for k in own]
            grams = np.unique(np.concatenate(lists))
            at = np.searchsorted(grams, np.concatenate(lists))
            begin = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
            self.sets.append((q, np.array(own), grams, at, begin))

    def hits(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, term) of all texts that hold a term."""
        out = [(i, k) for k, t in enumerate(self.terms) if not t for i, x in enumerate(texts) if x]
        codes = _codes("".join(texts))
        ends = np.cumsum([len(t) for t in texts])
        for q, own, grams, at, begin in self.sets:
            g = _grams(codes, q)
            place = np.searchsorted(grams, g).clip(0, len(grams) - 1)
            found = np.flatnonzero(grams[place] == g)
            which = np.searchsorted(ends, found, "right")
            found, which = place[found], which
            count = np.bincount(found, minlength=len(grams))
            # the rarest gram of each term: least count first, then least gram
            rank = count[at] * len(grams) + at
            rarest = np.minimum.reduceat(rank, begin) % len(grams)
            pairs = np.unique(found * len(texts) + which)
            gram, text = pairs // len(texts), pairs % len(texts)
            lo, hi = np.searchsorted(gram, rarest), np.searchsorted(gram, rarest, "right")
            for k, a, b in zip(own.tolist(), lo.tolist(), hi.tolist()):
                term = self.terms[k]
                out.extend((i, k) for i in text[a:b].tolist() if term in texts[i])
        return out


def scan(pages: DataFrame, text: str, terms: list[str], out: str = "term_no") -> DataFrame:
    """``pages`` without ``text``, a row for each of ``terms`` (its number in
    the list) that the text holds, exactly as written."""
    shared = pages.sparkSession.sparkContext.broadcast(terms)
    rest = [f for f in pages.schema if f.name != text]
    schema = T.StructType([*rest, T.StructField(out, T.IntegerType())])

    def run(it):
        index = TermIndex(shared.value)
        for b in it:
            own = b.select([f.name for f in rest])
            texts = b.column(text).to_pylist()
            begin, held = 0, 0
            for i, t in enumerate(texts):
                held += len(t)
                if held >= PIECE or i + 1 == len(texts):
                    found = index.hits(texts[begin:i + 1])
                    for s in range(0, len(found), 1 << 16):
                        part = found[s:s + (1 << 16)]
                        rows = own.take(pa.array([begin + x for x, _ in part]))
                        yield pa.record_batch([*rows.columns, pa.array([k for _, k in part], pa.int32())], names=[f.name for f in schema])
                    begin, held = i + 1, 0

    return pages.mapInArrow(run, schema)
