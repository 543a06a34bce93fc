"""The operators against brute force on a small table with odd rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from docmill.llm import byte_bpe, decontamination, line_dedup, ngram_join, quality_rules, suffix_dedup, token_store, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# ------------------------------------------------------------- token store
def test_token_store(spark, docs, texts):
    from tokenizers import Tokenizer

    lib, at, want = Tokenizer.from_file(token_store.word_tokenizer_path()), 0, {}
    for i, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert by_id(token_store.digests(spark, docs), "start", "n_tokens", "ids_crc32") == want


def test_token_store_keys(spark):
    rows = [(5, "a b"), (5, "a b"), (5, "c"), (None, "d"), (1, None)]
    store = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"))
    keys = spark.createDataFrame([(5, 0), (5, 1), (5, 2), (5, 3), (None, 0), (1, 0), (77, 0)], "key long, dup int")
    got = {(r["key"], r["dup"]): r["n_tokens"] for r in token_store.fetch(store, keys).collect()}
    assert set(got) == {(5, 0), (5, 1), (5, 2), (None, 0), (1, 0)} and got[1, 0] == 1


def test_token_store_empty(spark, no_docs):
    assert token_store.digests(spark, no_docs).collect() == []


def test_perfect_hash_is_minimal():
    h = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    sizes, bits = token_store.build_mph(h)
    assert sorted(token_store.mph_slots(h, sizes, bits)) == list(range(5000))


@pytest.mark.parametrize("text", ["it's 'twas I'll", "***the*** 12ab, a1.", "\x1c a\x1cb", "ΣΑΣ. İstanbul", "<|endoftext|> x", "a<|startoftext|>b c", "<|EndOfText|>",
                                  "<|endoftext|", "é É. ́a", "日本語。 ok"])
def test_word_encoder_is_the_library(text):
    from tokenizers import Tokenizer

    enc = token_store._encoder(token_store.word_tokenizer_path())
    fresh = Tokenizer.from_file(token_store.word_tokenizer_path())
    assert enc(["x y", text])[1] == np.array(fresh.encode(text, add_special_tokens=False).ids, enc.kind).tobytes()


# ------------------------------------------------------------ quality rules
def base_rules(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered.update((i, i + 1, i + 2))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_base(docs, texts):
    got = by_id(quality_rules.base_features(docs), *quality_rules.FEATURES)
    assert got == {i: base_rules(t) for i, t in texts}


def test_quality_rules_ratio(spark):
    """Score by hand from the same hashes; junk goes, clean rows stay."""
    from pyspark.sql import functions as F

    clean = [(i, " ".join(f"w{(i * 7 + j * j) % 97}ing" for j in range(60))) for i in range(30)]
    junk = [(100 + i, " ".join(f"X{(i + j) % 59}##{j % 7}" for j in range(60))) for i in range(5)]
    rows = [*clean, *junk, (200, ""), (201, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(100, 0), (None, 1)], "doc_id long, quality int")
    got = by_id(quality_rules.judge(docs, quality_rules.trusted_ids(labels)), "base_failed", "kept", "log_ratio")
    tails = sorted({w[-3:] for _, x in rows for w in (x or "").split()})
    ends = dict(spark.createDataFrame([(t,) for t in tails], "t string").select("t", F.xxhash64("t")).collect())
    chosen = [clean[0], clean[9], junk[0]]
    hashes = {i: [ends[w[-3:]] for w in x.split()] for i, x in chosen}
    both = sorted({(a, b) for e in hashes.values() for a, b in zip(e, e[1:])}) + [(e[-1], None) for e in hashes.values()]
    pairs = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(both, "a long, b long").withColumn("h", F.xxhash64("a", "b")).collect()}
    some = {i: [h % quality_rules.BUCKETS for h in [*e, *(pairs[p] for p in zip(e, [*e[1:], None]))]] for i, e in hashes.items()}
    value = quality_rules.ratios(docs, quality_rules.trusted_ids(labels))
    for i, b in some.items():
        assert got[i][2] == pytest.approx(np.mean([value[k] for k in b]), abs=1e-6)
    assert all(got[i][1] or got[i][0] for i, _ in clean) and not any(got[i][1] for i, _ in junk)
    assert got[200] == (True, False, None) and got[201] == (True, False, None)


def test_quality_rules_without_target(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality_rules.judge(docs, quality_rules.trusted_ids(none)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)
    assert quality_rules.judge(no_docs, quality_rules.trusted_ids(none)).collect() == []


# -------------------------------------------------------------- suffix dedup
def repeats(texts, k=suffix_dedup.K):
    seen, want = set(), {}
    for i, t in texts:
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            w = b[p:p + k]
            cover[p:p + k] |= w in seen
            seen.add(w)
        runs = int((cover & ~np.r_[False, cover[:-1]]).sum()) if len(b) else 0
        want[i] = (len(b), int(cover.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~cover])))
    return want


def test_suffix_dedup(docs, texts):
    got = by_id(suffix_dedup.digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == repeats(texts)


def test_suffix_dedup_across_pieces(docs, texts, monkeypatch):
    """One batch, and texts cut into small pieces."""
    part = [x for x in texts if x[1] and len(x[1]) < 3000]
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    for _, t in part:
        whole = suffix_dedup.anchors([t.encode()])
        covered = [p for lo, hi in zip(whole[2], whole[3]) for p in range(lo, hi + 1)]
        assert covered == list(range(max(0, len(t.encode()) - suffix_dedup.K + 1)))
        cut = [s + p for g in suffix_dedup._pieces([(0, t)]) for part_, a, lo, hi, h in zip(*suffix_dedup.anchors([x[2] for x in g]))
               for s in [g[part_][1]] for p in range(lo, hi + 1)]
        assert sorted(cut) == covered


def test_suffix_dedup_compares_a_group():
    """Windows of 100 bytes around 76 common ones, against a plain list."""
    rng, g = np.random.default_rng(5), suffix_dedup.GROUP
    sides = [(bytes(rng.integers(97, 99, g - 1).astype(np.uint8)), bytes(rng.integers(97, 99, g - 1).astype(np.uint8))) for _ in range(6)]
    members, windows = [], []
    for i in range(40):
        (left, right), t0, t1 = sides[rng.integers(6)], int(rng.integers(0, 12)), int(rng.integers(12, 25))
        cut = int(rng.integers(0, 10))
        left = bytes(rng.integers(97, 99, cut).astype(np.uint8)) + left[cut:]
        members.append((i // 2, 500 * (i % 2) + 50, t0, t1, left[g - 1 - t1:], right[:g - 1 - t0]))
        windows += [((left[g - 1 - t:] if t else b"") + b"|" + right[:g - 1 - t], i // 2, 500 * (i % 2) + 50 - t) for t in range(t0, t1 + 1)]
    first = {}
    for w, d, p in sorted(windows, key=lambda x: x[1:]):
        first.setdefault(w, (d, p))
    want = {(d, p) for w, d, p in windows if first[w] != (d, p)}
    got = {(d, p) for d, lo, hi in suffix_dedup._compare(members) for p in range(lo, hi - suffix_dedup.K + 1)}
    assert got == want and want


def test_suffix_dedup_empty_null(spark, no_docs):
    assert suffix_dedup.digests(no_docs).collect() == []
    t = "abcdefghij" * 12
    rows = spark.createDataFrame([(None, t), (4, t), (5, t[:99]), (5, t[:99]), (6, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in suffix_dedup.digests(rows).collect())
    assert got == [(0, 120, 110), (4, 120, 120), (5, 99, 0), (5, 99, 0), (6, 0, 0)]


def test_suffix_dedup_shared_and_missing_ids(spark):
    """Rows that share an id, or have none, are documents of their own."""
    rnd = np.random.default_rng(8)
    a, b, c = ("".join(map(chr, rnd.integers(97, 123, 300))) for _ in range(3))
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    for rows in ([(1, a), (5, a), (5, b)], [(None, a), (None, b), (3, a)], [(None, a + c), (2, b), (2, c + b), (2, c + b), (7, None), (7, a[:200])]):
        distinct = sorted({(i, t) for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, md5(x[1] or "")))
        want = repeats([(x, x[1]) for x in distinct])
        got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(((x[0], *want[x]) for x in rows), key=repr)


# ------------------------------------------------------------------ line dedup
def line_rules(texts):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = collections.defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where[key(x)].add(i)
    want = {}
    for i, t in texts:
        lines = (t or "").split("\n")
        left = [x for x in lines if len(where.get(key(x), ())) < 3 or max(where[key(x)]) == i]
        want[i] = (len(lines), len(lines) - len(left), sha("\n".join(left)))
    return want


@pytest.mark.parametrize("bits", [None, 1 << 16, 512])
def test_line_dedup(docs, texts, bits):
    from pyspark.sql import functions as F

    got = line_dedup.dedup_lines(docs, bits=bits).withColumn("sha", F.sha2("text", 256))
    assert by_id(got, "n_lines", "n_dropped", "sha") == line_rules(texts)


def test_line_dedup_null_ids_and_empty(spark, no_docs):
    line = "this line is in many documents"
    rows = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.dedup_lines(rows).collect())
    assert got == [(0, ""), (1, ""), (2, line), (2, line)]
    assert line_dedup.dedup_lines(no_docs).collect() == []


# ------------------------------------------------------------ n-gram join
def shingles(t, n):
    w = [x.lower() for x in WORD.findall(t or "")]  # the sample has no other capitals than A-Z
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def linked(texts, n, percent):
    sets = {i: shingles(t, n) for i, t in texts}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and sets[a] & sets[b]]
    near = [(a, b) for a, b in near if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("n,percent,boundary", [(3, 90, None), (5, 80, None), (3, 90, 0), (3, 90, 25)])
def test_ngram_join(docs, texts, n, percent, boundary, monkeypatch):
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "pick_boundary", lambda *a: boundary)
    texts = [(i, t.replace("É", "é") if t else t) for i, t in texts]
    from pyspark.sql import functions as F

    rows = docs.withColumn("text", F.replace("text", F.lit("É"), F.lit("é")))
    assert by_id(ngram_join.link_documents(rows, n, percent), "n_shingles", "component_id") == linked(texts, n, percent)


@pytest.mark.parametrize("boundary", [None, 13])
def test_ngram_join_shared_ids(spark, boundary, monkeypatch):
    """Each row is linked by its own set; a long text that shares its id with a
    short one isn't taken for it."""
    if boundary is not None:
        monkeypatch.setattr(ngram_join, "pick_boundary", lambda *a: boundary)
    words = lambda c, n: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("b", 60)), (1, words("a", 14)), (2, words("a", 14) + " x"), (2, words("c", 400)), (3, words("c", 395)), (3, ""), (4, words("b", 62)),
            (1, words("b", 60)), (None, words("b", 60)), (5, words("d", 14)), (5, words("d", 14))]
    sets = [shingles(t, 3) for _, t in rows]
    label = [i for i, _ in rows]
    for _ in rows:
        for x, p in enumerate(sets):
            for y, q in enumerate(sets):
                if p and None not in (label[x], label[y]) and 100 * len(p & q) >= 90 * len(p | q):
                    label[x] = label[y] = min(label[x], label[y])
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, len(s), c) for (i, _), s, c in zip(rows, sets, label)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert (2, 13, 1) in want and (4, 60, 1) in want


def test_ngram_join_chain_of_near_copies(spark):
    """Members that aren't like their list's pivot, only like each other."""
    words = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(25):
        w = list(words)
        for j in range(k):
            w[(4 * j) % 120] = f"v{j}"
        rows.append((k + 1, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(ngram_join.link_documents(df), "n_shingles", "component_id") == linked(rows, 3, 90)


def grown_pairs(n, sizes):
    """Pairs of a text and the text with words appended, of so many shingles
    each: once any words, once words that put the appended shingles first."""
    rng, rows = np.random.default_rng(n), []
    for small, large in sizes:
        for first in (False, True):
            w = [f"p{len(rows)}x{j}" for j in range(small + n - 1)]
            rows.append((len(rows) + 1, " ".join(w)))
            for _ in range(large - small):
                tries = [f"q{len(rows)}x{k}" for k in rng.integers(0, 1 << 40, 150 if first else 1)]
                w.append(min(tries, key=lambda x: ngram_join.shingle_set(" ".join([*w[1 - n:], x]), n)[0]))
            rows.append((len(rows) + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("partitions", [1, 24])
@pytest.mark.parametrize("n,percent,sizes", [
    (3, 90, [(95, 100), (90, 100), (89, 100), (190, 200), (900, 950), (40, 42)]),
    (5, 80, [(95, 100), (90, 100), (80, 100), (79, 100), (400, 500), (30, 34)])])
def test_ngram_join_appended_words(spark, n, percent, sizes, partitions):
    rows = grown_pairs(n, sizes)
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string")
    want = linked(rows, n, percent)
    assert by_id(ngram_join.link_documents(df, n, percent), "n_shingles", "component_id") == want
    assert sum(i != c for i, (_, c) in want.items()) == 2 * (len(sizes) - 1)


def test_ngram_join_null_and_empty(spark, no_docs):
    assert ngram_join.link_documents(no_docs).collect() == []
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (2, "a b c"), (3, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0), r["component_id"]) for r in ngram_join.link_documents(df).collect())
    assert got == [(0, None), (2, 2), (2, 2), (3, 3)]


# --------------------------------------------------------- decontamination
def test_decontamination(spark, docs, texts):
    def grams(t):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}

    long = [t for _, t in texts if t and len(t.split()) > 100]
    items = [(k, " ".join(t.split()[j:j + 20])) for k, (t, j) in enumerate((t, j) for t in long for j in (3, 40))]
    items += [(900, " ".join(long[0].split()[5:25]).replace(long[0].split()[9], "other")), (901, "too few words"), (902, None), (903, ""),
              (None, "an item without any id at all")]
    want, held = {}, [(i, grams(t)) for i, t in texts]
    for k, x in items:
        q = grams(x)
        for i, g in held:
            n = len(q & g)
            if k is not None and q and 100 * n >= 80 * len(q):
                want[i, k] = (len(q), n)
    got = {(r["doc_id"], r["item_id"]): (r["item_shingles"], r["shared"])
           for r in decontamination.digests(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(want) > 10


def test_decontamination_empty(spark, docs, no_docs):
    none, one = (spark.createDataFrame(x, "item_id long, text string") for x in ([], [(1, "a b c d e f g")]))
    assert decontamination.digests(docs, none).collect() == []
    assert decontamination.digests(no_docs, one).collect() == []


# ---------------------------------------------------------------- byte BPE
@pytest.mark.parametrize("chunk,overlap", [(32_768, 1_024), (64, 24), (16, 16)])
def test_byte_bpe(docs, texts, chunk, overlap):
    path, pattern = byte_bpe.vocabulary()
    enc = byte_bpe._encoding(path, pattern)[0]
    coded = byte_bpe.decode(byte_bpe.encode(docs, path, pattern, chunk=chunk, overlap=overlap), path, pattern)
    assert coded.columns[:2] == ["doc_id", "kept"]
    got = {r["doc_id"]: (list(r["ids"]), bytes(r["decoded"])) for r in coded.collect()}
    assert got == {i: (enc.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts}


def test_byte_bpe_repeated_and_empty(spark, no_docs):
    path, pattern = byte_bpe.vocabulary()
    t = "some words of a text " * 20
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (1, t + "x")], "doc_id long, text string")
    rows = byte_bpe.decode(byte_bpe.encode(df, path, pattern, chunk=64, overlap=32), path, pattern).collect()
    assert sorted(((r["doc_id"] or 0), bytes(r["decoded"]).decode()) for r in rows) == [(0, t), (1, t), (1, t), (1, t + "x")]
    assert byte_bpe.encode(no_docs, path, pattern).collect() == []


def test_helper_names_in_the_table(docs, no_docs):
    """A table with columns that the operators use between their steps."""
    rows = docs.select("doc_id", "text").withColumns({n: F.lit(n) for n in ("QR_words", "qr_grams", "qr_lines", "qr_places", "qr_ends", "qr_buckets",
                                                                            "_bpe_id", "_bpe_h", "_bpe_i", "_bpe_g")})
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    plain = {tuple(r) for r in quality_rules.judge(docs.select("doc_id", "text"), quality_rules.trusted_ids(labels)).select("doc_id", "kept", "log_ratio").collect()}
    judged = quality_rules.judge(rows, quality_rules.trusted_ids(labels))
    assert set(rows.columns) <= set(judged.columns) and {tuple(r) for r in judged.select("doc_id", "kept", "log_ratio").collect()} == plain
    path, pattern = byte_bpe.vocabulary()
    coded = byte_bpe.encode(rows, path, pattern, chunk=64, overlap=24)
    enc = byte_bpe._encoding(path, pattern)[0]
    assert {(r["doc_id"], r["_bpe_h"], r["QR_words"], tuple(r["ids"])) for r in coded.collect()} == {
        (r["doc_id"], "_bpe_h", "QR_words", tuple(enc.encode_ordinary(r["text"] or ""))) for r in docs.collect()}


# -------------------------------------------------------------------- WARC
PAGES = [(7, "http://a.org/x?y", "<p>same</p>"), (3, "http://a.org", "<p>same</p>"), (9, "https://b.org/", "other\r\n\r\nWARC/1.1\r\n\r\n"),
         (4, None, None), (2, "odd\r\nurl", ""), (11, "http://c.org", "é" * 3000), (12, "http://c.org", "<p>same</p>")]


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = {r["main"]["record_id"]: r for r in warc.captures(spark, warc.write_archives(pages, min_revisit=least)).collect()}
    assert len(rows) == len(PAGES)
    first = {}
    for i, _, h in sorted(PAGES):
        first.setdefault(h or "", i)
    by = {int(bytes(r["metadata"]["body"]).split(b": ")[1]): r for r in rows.values()}
    for i, url, h in PAGES:
        b = (h or "").encode()
        m = by[i]["main"]
        assert m["digest"] == base64.b32encode(hashlib.sha1(b).digest()).decode()
        revisit = len(b) >= least and first[h or ""] != i
        assert m["type"] == ("revisit" if revisit else "response")
        assert bytes(m["body"]) == (b"" if revisit else b)
        assert by[i]["request"]["body"].startswith(b"GET ")
        if revisit:
            assert rows[m["refers_to"]] is by[first[h or ""]]


def test_warc_digests(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, main string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digests(spark, pages).collect()}
    assert got[7] == (11, "revisit", 3) and got[3] == (11, "response", None) and got[4] == (0, "revisit", 2) and got[11][0] == 6000
    assert warc.digests(spark, pages.limit(0)).collect() == []


def test_warc_null_and_equal_rows(spark):
    pages = spark.createDataFrame([(None, "u", "h"), (1, "u", "h"), (1, "u", "h")], "page_id long, url string, html string")
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in warc.digests(spark, pages).collect())
    assert [(i, k) for i, k, _ in got] == [(0, "response"), (1, "revisit")]
