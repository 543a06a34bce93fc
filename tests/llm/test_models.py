"""The two classifiers on held-out rows, and the pipeline against brute force."""

import re

import numpy as np
import pytest

from docmill.llm import quality_model, quality_rules, toxicity

SF = "/root/testdata/sf0.01"


def test_subsequence_kernel_is_exact():
    from itertools import combinations

    def brute(s, t):
        at = {}
        for c in combinations(range(len(s)), toxicity.ORDER):
            at.setdefault(tuple(s[i] for i in c), []).append(c[-1] - c[0] + 1)
        return sum(toxicity.DECAY ** (n + c[-1] - c[0] + 1) for c in combinations(range(len(t)), toxicity.ORDER) for n in at.get(tuple(t[i] for i in c), ()))

    pairs = [("idiot", "i-d-iot"), ("stupid", "stuuupid"), ("abcabc", "bcabca"), ("clown", "crown"), ("aaaaa", "aaaa"), ("ab", "ab")]
    got = toxicity.kernel_pairs(*(toxicity.codes([p[i] for p in pairs])[0] for i in (0, 1)))
    assert got == pytest.approx([brute(*p) for p in pairs], rel=1e-5)


@pytest.fixture(scope="module")
def insults(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abehilnorstu"), rng.integers(2, 9))) for _ in range(600)]
    bad = ["grumbold", "fizzwick", "snorkle"]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(words, 40))
        toxic = i % 4 == 0
        if toxic:
            w[5], w[20] = bad[i // 4 % 3], bad[(i // 4 + 1) % 3]
        rows.append((i, " ".join(w) + "."))
        labels.append((i, int(toxic)))
    rows += [(1000, "the g-r-u-m-b-o-l-d here."), (1001, "s n o r k l e it is, f i z z w i c k."), (1002, ""), (1003, None), (None, "some words."), (1004, "x" * 3000)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame([*labels, (1003, None), (None, 1), (5000, 1)], "doc_id long, toxic int"))


def test_toxicity_held_out(insults):
    rows = {r["doc_id"]: r for r in toxicity.digests(*insults).collect()}
    assert len(rows) == 406
    held = [r for i, r in rows.items() if i is not None and i < 400 and r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert rows[1000]["predicted"] == 1 and rows[1001]["predicted"] == 1
    assert not any(rows[i]["predicted"] for i in (1002, 1003, None, 1004))


def test_toxicity_short_words(spark):
    """Insults shorter than the kernel's subsequences."""
    for bad in ("ass", "zz", "q"):
        docs = spark.createDataFrame([(i, f"you {bad}" if i % 2 else "a kind day for you") for i in range(200)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
        assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.digests(docs, labels).collect())


@pytest.mark.parametrize("bound", ["KEEP", "KEEP_CHARS"])
def test_toxicity_words_beyond_what_is_kept(monkeypatch, bound):
    """A worker that forgets its words still knows those of the texts at hand."""
    monkeypatch.setattr(toxicity, bound, 5, raising=False)
    marks = toxicity.Landmarks([w for x in ("grumbold", "fizzwick") for w in toxicity.windows(x)])
    texts = ["grumbold the a of and here there", "fizzwick the", "new the grumbolt", "", "the g-r-u-m-b-o-l-d " + "x" * 300]
    lists = [toxicity.units_of(t) for t in texts]
    each = [toxicity.Model(marks, np.ones(2), -0.5).raw([ws])[0] for ws in lists]
    model = toxicity.Model(marks, np.ones(2), -0.5)
    got = [model.raw([ws])[0] for ws in lists]
    assert got == pytest.approx(each) and got[0] > 0 and len(model.seen) < 8
    assert toxicity.Model(marks, np.ones(2), -0.5).raw(lists) == pytest.approx(each)


def test_toxicity_without_labels(spark, insults, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.digests(insults[0], none).collect()} == {0.5}
    assert toxicity.digests(no_docs, insults[1]).collect() == []


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_model.digests(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_quality_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (None, 0)], "doc_id long, quality int")
    rows = quality_model.digests(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality_model.digests(no_docs, labels).collect() == []


def spark_hash(value, seed=42):
    """What Spark's xxhash64 makes of a string or a long, signed."""
    import struct

    import xxhash

    h = xxhash.xxh64(value.encode() if isinstance(value, str) else struct.pack("<q", value), seed=seed & (2**64 - 1)).intdigest()
    return h - (1 << 64) if h >> 63 else h


def buckets(text):
    """Buckets of the ends of words and of the pairs they make."""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    ends = [spark_hash(x[-3:]) for x in w]
    pairs = [spark_hash(b, spark_hash(a)) for a, b in zip(ends, ends[1:])] + ([spark_hash(ends[-1])] if ends else [])
    return [x % quality_rules.BUCKETS for x in ends + pairs]


def ratio_table(texts, good):
    raw, target = np.zeros(quality_rules.BUCKETS), np.zeros(quality_rules.BUCKETS)
    for i, t in texts:
        b = buckets(t)
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(target, b, 1)
    s = quality_rules.SMOOTH
    return np.where(raw > 0, np.log((target + s) / (raw * target.sum() / raw.sum() + s)), 0)


def log_ratio(text, value):
    b = buckets(text)
    return value[b].mean() if b else -np.inf


def test_quality_ratio_recomputed(spark, docs, texts):
    """Counts and logarithms anew, by a plain loop."""
    good = {i for i, _ in texts if i % 3 == 0}
    labels = spark.createDataFrame([(i, int(i in good)) for i, _ in texts], "doc_id long, quality int")
    value = ratio_table(texts, good)
    got = {r["doc_id"]: r["log_ratio"] for r in quality_rules.judge(docs, quality_rules.trusted_ids(labels)).select("doc_id", "log_ratio").collect()}
    for i, t in texts:
        want = log_ratio(t, value)
        assert got[i] is None if want == -np.inf else got[i] == pytest.approx(want, abs=1e-6)


def five_grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_pipeline_shared_and_missing_ids(spark):
    """Stages judge rows: a copy goes though it has no id, a unique text stays
    though its id is shared."""
    import corpus_pipeline as C

    words = lambda c, n=60: " ".join(f"{c}{k}" for k in range(n))
    rows = [(1, words("a")), (1, words("b")), (2, words("a")), (None, words("c")), (None, words("c") + " more"), (3, words("c")), (4, words("d")), (4, words("d"))]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _own string")
    kept = dict(C.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert kept.columns == docs.columns and {r["_own"] for r in kept.collect()} == {"x"}
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"][0]) for r in kept.collect())
    assert got == [(False, 0, "c"), (True, 1, "a"), (True, 1, "b"), (True, 4, "d")]
    found = spark.createDataFrame([(1, words("b", 12)), (2, words("c", 12))], "item_id long, text string")
    spark_read, C.read = C.read, lambda *_: found
    try:
        clean = dict(C.STAGES)["benchmark decontamination"](spark, docs, "")
        assert sorted((r["doc_id"], r["text"][0]) for r in clean.collect()) == [(1, "a"), (2, "a"), (4, "d"), (4, "d")]
    finally:
        C.read = spark_read


def test_pipeline_stages(spark):
    """Each stage against brute force on what the stage before kept."""
    import corpus_pipeline as C

    from .test_exact_ops import base_rules, line_rules, linked, sha

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    (_, rules), (_, lines), (_, near), (_, bench), (_, tokens) = C.STAGES
    one = rules(spark, docs, sf).cache()
    assert one.columns == docs.columns
    failed = {i for i, t in texts(docs) if base_rules(t)[-1]}
    kept = {i for i, _ in texts(one)}
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    value = ratio_table(texts(docs), good)
    assert kept == {i for i, t in texts(docs) if i not in failed and log_ratio(t, value) >= quality_rules.MIN_RATIO}
    two = lines(spark, one, sf).cache()
    want = line_rules(texts(one))
    assert {i: sha(t) for i, t in texts(two)} == {i: w[2] for i, w in want.items() if w[2] != sha("")}
    three = near(spark, two, sf).cache()
    lower = [(i, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in texts(two)]
    assert {i for i, _ in texts(three)} == {i for i, (_, c) in linked(lower, 5, 80).items() if i == c}
    four = bench(spark, three, sf).cache()
    items = [five_grams(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = {i: five_grams(t) for i, t in texts(three)}
    clean = {i for i, g in own.items() if not any(q and 100 * len(q & g) >= 80 * len(q) for q in items)}
    assert {i for i, _ in texts(four)} == clean
    five = tokens(spark, four, sf).collect()
    assert len(five) == four.count() and all(r["exact"] for r in five)


def test_pipeline_near_copies_of_unequal_length(spark):
    """Texts with 5 to 20 % of their words appended or cut, met only by each other."""
    import corpus_pipeline as C

    from .test_exact_ops import grown_pairs, linked

    rows = grown_pairs(5, [(95, 100), (90, 100), (85, 100), (80, 100), (79, 100), (180, 200)])
    rows += [(100 + i, " ".join(reversed(t.split(" ")))) for i, t in rows]
    near = dict(C.STAGES)["n-gram Jaccard join"]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), "doc_id long, text string")
    want = {i for i, (_, c) in linked(rows, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in near(spark, docs, "").collect()} == want and len(want) == len(rows) - 20
