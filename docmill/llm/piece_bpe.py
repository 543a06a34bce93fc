"""SentencePiece BPE encoding by a table of last tokens, and decoding.

The library merges the best scored pair of neighbours again and again. What it
returns can be had without merging: the encoding of a text's prefix is the
encoding of a shorter prefix and one more token, and two tokens may stand side
by side exactly when merging the two alone gives the two back (*compatible*).
So for each prefix, shortest first:

1. an automaton over the vocabulary's pieces gives the pieces that end there;
2. the one compatible with the last token of the prefix before it is this
   prefix's last token: there is exactly one, and its number is stored;
3. from the whole text's last token, the ids are recovered backwards.

Characters that are no piece are tokens of their own, written as byte pieces.

The library's normalised text is first cut into units at places that no piece
crosses: before a run of ``▁``, and where letters and other characters meet.
Each way of cutting is checked once against all pieces; where none passes, a
text is one unit. Distinct units are encoded once per worker and kept, up to
``KEEP`` of them.

Edge cases: a null text counts as empty and has the begin and end ids only;
repeated rows each get their own result; further columns are kept, and a
column named like a result is replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_column

SPACE_MARK = "▁"
#: Units of text and pairs of tokens that a worker remembers (about 0.1 GB in all).
KEEP = 300_000
#: Ways to cut a text, finest first; where they cut depends on the two
#: neighbouring characters alone.
CUTS = (SPACE_MARK + r"*\p{L}+|" + SPACE_MARK + r"*[^\p{L}" + SPACE_MARK + "]+|" + SPACE_MARK + "+",
        f"{SPACE_MARK}+[^{SPACE_MARK}]*|[^{SPACE_MARK}]+", r"(?s:.+)")
#: Longer units are encoded each time.
LONGEST_KEPT = 64

_LOADED: dict = {}


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def library(path: str):
    """The library's processor, once per Python worker."""
    if path not in _LOADED:
        from sentencepiece import SentencePieceProcessor

        _LOADED[path] = SentencePieceProcessor(model_file=path)
    return _LOADED[path]


class PrefixEncoder:
    """Ids of whole texts by a BPE model with byte fallback."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.lib = lib = library(path)
        size = lib.vocab_size()
        #: text of each token; numbers from ``size`` on are characters that are no piece
        self.text = [lib.id_to_piece(i) for i in range(size)]
        normal = [i for i in range(size) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.score = {self.text[i]: lib.get_score(i) for i in normal}
        self.number = {self.text[i]: i for i in normal}
        self.size = size
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.ends = lib.bos_id(), lib.eos_id()
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.text[i], (i, len(self.text[i])))
        self.automaton.make_automaton()
        cuts = map(regex.compile, CUTS)
        self.units = next(c for c in cuts if all(c.fullmatch(t) and c.match(t).end() == len(t) for t in self.score))
        #: by the first token's number times 2^32 plus the second's
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The symbols that merging leaves of a short text: always the pair of
        the best score, the leftmost of equals."""
        s = list(text)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                x = self.score.get(s[i] + s[i + 1])
                if x is not None and (best is None or x > best):
                    best, at = x, i
            if at < 0:
                return s
            s[at:at + 2] = [s[at] + s[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow ``a`` (-1: begin a text)."""
        if a < 0:
            return self.merged(self.text[b]) == [self.text[b]]
        return self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def character(self, c: str) -> int:
        if c not in self.number:
            self.number[c] = len(self.text)
            self.text.append(c)
        return self.number[c]

    def last_tokens(self, unit: str) -> list[int]:
        """For each end, the one token that ends the encoding of that prefix."""
        last, fits, done = [-1], self.fits, 0
        for end, (t, size) in self.automaton.iter(unit):
            if end < done:
                continue
            while done < end:  # characters that end no piece
                last.append(self.character(unit[done]))
                done += 1
            before = last[end + 1 - size]
            pair = before << 32 | t
            try:
                ok = fits[pair]
            except KeyError:
                if len(fits) >= KEEP:
                    fits.clear()
                ok = fits[pair] = self.compatible(before, t)
            if ok:
                last.append(t)
                done += 1
        while done < len(unit):
            last.append(self.character(unit[done]))
            done += 1
        return last

    def encode_unit(self, unit: str) -> bytes:
        last, text, size, end, ids = self.last_tokens(unit), self.text, self.size, len(unit), []
        while end:
            t = last[end]
            end -= len(text[t])
            if t < size:
                ids.append(t)
            else:
                ids.extend(self.bytes[b] for b in reversed(text[t].encode()))
        ids.reverse()
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> np.ndarray:
        """All ids of a text, with begin and end."""
        units = self.units.findall(self.lib.normalize(text)) if text else []
        known = self.known
        if len(known) > KEEP:
            known.clear()
        missing = {}
        for u in set(units).difference(known):
            (known if len(u) <= LONGEST_KEPT else missing)[u] = self.encode_unit(u)
        get = known.__getitem__ if not missing else lambda u: known[u] if u in known else missing[u]
        body = np.frombuffer(b"".join(map(get, units)), np.uint32)
        return np.concatenate([[self.ends[0]], body, [self.ends[1]]]).astype(np.int32)


def _encoder(path: str) -> PrefixEncoder:
    if ("encoder", path) not in _LOADED:
        _LOADED["encoder", path] = PrefixEncoder(path)
    return _LOADED["encoder", path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` without its text, with ``ids`` array<int>: all ids of the whole
    text, begin and end included."""
    def start():
        enc = _encoder(path)
        return lambda v: (enc(v.as_py() or ""),)

    return map_column(docs, text, False, [T.StructField(ids, T.ArrayType(T.IntegerType(), False))], start)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` string, the library's decoding of the ids (null: empty)."""
    def start():
        lib = library(path)
        return lambda v: (lib.decode(v.values.to_numpy().tolist()) if v.is_valid else "",)

    return map_column(tokens, ids, True, [T.StructField(out, T.StringType())], start)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers) and decoded_sha256 of every document, through ``encode`` and the
    library's decoding of its ids."""
    import hashlib

    path = model_path()

    def start():
        lib = library(path)

        def row(v):
            ids = v.values.to_numpy()
            decoded = lib.decode(ids.tolist())
            return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return row

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    # decoded in the task that hashes: one Python process less at a time than through decode()
    return map_column(encode(docs.select("doc_id", "text"), path), "ids", False, fields, start)
