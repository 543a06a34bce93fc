"""Fill-in-middle and SentencePiece encoding against plain versions."""

import hashlib
import random
import re
import struct

import pytest

from docmill.llm import fill_middle as fm
from docmill.llm import piece_bpe as pb

ODD = ["<P>", "a <S> b", "<M", "<", "é", "x", " ", "\n\n", "漢字 かな", "😀 ok", "<s>", "<0x41>", "▁ ▁", "\x00", "ﬁ ½", "a" * 3000, " " * 700, "ab1c" * 20_000, "é<" * 40_000]


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(i, t, "o") for i, t in texts] + [(1000 + i, t, "o") for i, t in enumerate(ODD)] + [(5, "again", "o"), (5, "again", "o"), (None, "no id here", "o")]
    return spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3), rows


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        form, out = "plain", text
    elif h4 % 100 < 20:
        form, out = "spm", "<S>" + suf + "<P>" + pre + "<M>" + mid
    else:
        form, out = "psm", "<P>" + pre + "<S>" + suf + "<M>" + mid
    sizes = (None, None) if form == "plain" else (len(pre), len(mid))
    return (doc_id, len(units), form, *sizes, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def test_fill_middle(table):
    df, rows = table
    assert ordered(fm.digests(df).collect()) == ordered(plain_fill(i, t) for i, t, _ in rows)


def test_fill_middle_keeps_columns(table, no_docs):
    out = fm.fill_middle(no_docs)
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "ids", "kept"]
    df, rows = table  # a column named like the result is replaced
    kept = fm.restored(fm.fill_middle(df)).select("doc_id", "restored").collect()
    assert ordered(kept) == ordered((i, t or "") for i, t, _ in rows)


@pytest.mark.parametrize("n", [0, 1, 3, 100, 70_000, 140_000])
def test_skip_list_reaches_every_rank(n):
    rnd = random.Random(n)
    text = "".join(rnd.choice(["a", "Bc", " ", "é", "😀", "\n", "9", "word", "[", "`", "@", "{"]) for _ in range(n))
    ends = [0]
    for u in re.findall("[A-Za-z]+|[^A-Za-z]", text):
        ends.append(ends[-1] + len(u))
    units = fm.SkipList(text)
    assert units.units == len(ends) - 1
    for r in {0, len(ends) - 1, *(rnd.randrange(len(ends)) for _ in range(200))}:
        assert units.offset(r) == ends[r]
    with pytest.raises(IndexError):
        units.offset(len(ends))
    for index, unit_width, char_width in units.lanes:
        assert unit_width.sum() == units.units and char_width.sum() == len(text) and (index[1:] == unit_width.cumsum()[:-1]).all()


def test_piece_bpe(table):
    from sentencepiece import SentencePieceProcessor

    lib, (df, rows) = SentencePieceProcessor(model_file=pb.model_path()), table
    want = []
    for i, t, _ in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest()))
    assert ordered(pb.digests(df).collect()) == ordered(want)


def test_piece_bpe_random_strings():
    enc, rnd = pb.PrefixEncoder(pb.model_path()), random.Random(4)
    parts = ["a", "b", "the", "▁", " ", "  ", "\n", "é", "ß", "漢", "字", "😀", "\x00", "ing", "tion", "aaaa", "=", "==", "-----", "<s>", "ﬁ", "́", "\t", "0", "12", "²", "क", "्", "ष"]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50)))
        assert enc(t).tolist() == enc.lib.encode(t, add_bos=True, add_eos=True), t


def test_one_last_token_for_each_prefix():
    """Exactly one piece that ends a prefix goes with the table before it."""
    enc, rnd = pb.PrefixEncoder(pb.model_path()), random.Random(5)
    for _ in range(60):
        unit = "▁" + "".join(rnd.choice("eationrs") for _ in range(12))
        last = enc.last_tokens(unit)
        for end in range(1, len(unit) + 1):
            fits = [enc.number[unit[b:end]] for b in range(end) if unit[b:end] in enc.number and enc.compatible(last[b], enc.number[unit[b:end]])]
            assert fits == [last[end]]


def test_piece_bpe_columns_and_empty(no_docs, docs):
    out = pb.encode(no_docs, pb.model_path())  # has a column ids
    assert out.count() == 0 and dict(out.dtypes)["ids"] == "array<int>" and "text" not in out.columns
    assert pb.digests(no_docs).count() == 0
    first = pb.encode(docs, pb.model_path(), ids="kept").filter("doc_id = 3").first()
    assert first["ids"] == "i" and first["label"] == "l" and first["kept"][0] == 1
