"""Toxicity by a string-kernel support vector machine with Nyström landmarks.

Kernel: gap-weighted common subsequences of ``ORDER`` characters (each gap
character costs a factor ``DECAY``), normalised, so ``i-d-i-o-t`` and
``idiiot`` stay near ``idiot``. A unit (a word, a run of single letters
written apart, or a window of a very long word) is mapped by its kernel with m
landmark units; the landmarks' own kernel matrix whitens the map (Nyström), and a
linear SVM (squared hinge) works on it. Kernel values are only computed for units
that share with the landmark a subsequence of at least ``SCREEN`` of its
length (a bit-parallel longest-common-subsequence test); others count as 0, in
training as in scoring.

Words of fewer letters than ``ORDER`` have marks put before them and are like
equal words only.

Training: sentences inherit the label of their document, so most sentences of
a toxic document are harmless. A unit is counted once for a document, in
whichever of its sentences it stands; no value of a sentence is computed. Which of its units are the reason is learned in
rounds: the units that explain the toxic documents (a greedy cover) start as
positive, all others as negative; after each fit the units that the SVM finds
positive, and that are rare in clean documents, become positive. A document's
value is the mean of its two worst units (the worst alone where it has one) mixed
with its worst, and a logistic fit on training documents turns that into a score.

After a fit, the harmless units of the training documents that come nearest
to the toxic ones are added and the fit is repeated (``MINING`` times).

Bounds: at most ``MAX_DOCS`` labelled documents of each label (those with the
smallest hash of the id) are used, and at most ``MAX_UNITS`` of their units and a
quarter as many in each mining round are collected. A worker scores distinct
words once and keeps them; beyond ``KEEP`` or ``KEEP_CHARS`` it forgets all and
begins again with the words of the texts at hand.

Edge cases: null and empty texts have no unit and get the score of a text
without any toxic unit; without toxic or clean training rows every score is
0.5 and 0 respectively; null ids are scored and never used for training.
"""

from __future__ import annotations

import re
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches

ORDER = 4
DECAY = 0.8
#: Stands before a unit: what a word begins with tells more than its endings.
START = "^"
SCREEN = 0.7
LENGTH = 20
LANDMARKS = 96
MAX_DOCS = 2_500
MAX_UNITS = 6_000
MINING = 2
#: Cost of a unit on the wrong side of its margin.
COST = 0.05
#: Least eigenvalue of the landmarks' kernel matrix that is undone.
FLOOR = 0.3
#: Words, and characters of words, whose values a worker keeps.
KEEP, KEEP_CHARS = 1_000_000, 32_000_000
THRESHOLD = 0.7

_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n+")
_EDGES = re.compile(r"^\W+|\W+$")
_APART = re.compile(r"(?<!\S)(?:\w[^\w\s]*\s+){2,}\w(?!\w)")


def units_of(text: str) -> list[str]:
    """The distinct raw words of a text, and its runs of single letters."""
    low = text.lower()
    got = set(low.split())
    got.update("".join(m.group().split()) for m in _APART.finditer(low))
    return list(got)


def windows(word: str) -> list[str]:
    """The word without other characters at its ends, and, where it has some
    inside, its letters alone; START before it, whole or in windows of LENGTH
    that overlap by half."""
    w = _EDGES.sub("", word)
    forms = [w] if w.isalpha() else [w, "".join(filter(str.isalpha, w))]
    got = []
    for w in forms:
        if not w:
            continue
        # a word shorter than a subsequence begins with several marks: it equals itself only
        w = START * max(1, ORDER - len(w)) + w
        got += [w] if len(w) <= LENGTH else [w[i:i + LENGTH] for i in range(0, len(w) - LENGTH // 2, LENGTH // 2)]
    return got


def codes(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, LENGTH) code points, 0 behind the end, and lengths."""
    raw = "".join(u.ljust(LENGTH, "\0") for u in units).encode("utf-32-le")
    return np.frombuffer(raw, "<u4").reshape(len(units), LENGTH), np.fromiter(map(len, units), np.int64, len(units))


def kernel_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gap-weighted subsequence kernel of rows a[i], b[i] of code points."""
    if not len(a):
        return np.zeros(0)
    wide, high = (max(1, int((x > 0).sum(axis=1).max())) for x in (a, b))
    a, b = np.ascontiguousarray(a.T[:wide]), np.ascontiguousarray(b.T[:high])
    # match[i, j]: character i of a is character j of b; pairs come last
    match = ((a[:, None] == b[None]) & (a[:, None] > 0)).astype(np.float32) * np.float32(DECAY * DECAY)
    below = np.ones((wide, high, a.shape[1]), np.float32)  # K'_{k-1} of the prefixes before i and j
    for _ in range(1, ORDER):
        step = match * below
        below = np.zeros_like(step)
        for j in range(1, high):
            below[:, j] = np.float32(DECAY) * below[:, j - 1] + step[:, j - 1]
        total = np.zeros_like(below[0])
        for i in range(wide):
            below[i], total = total, np.float32(DECAY) * total + below[i]
    return (match * below).sum(axis=(0, 1), dtype=np.float64)


def self_kernel(c: np.ndarray) -> np.ndarray:
    return np.concatenate([kernel_pairs(c[i:i + 2_000], c[i:i + 2_000]) for i in range(0, len(c), 2_000)] or [np.zeros(0)])


class Landmarks:
    def __init__(self, units: list[str]):
        self.units = units
        self.codes, self.lengths = codes(units)
        self.self_k = self_kernel(self.codes)
        alphabet = np.unique(self.codes[self.codes > 0])
        self.alphabet = alphabet
        # bit j of mask[x, t]: character j of landmark t is x; the last row is for any other one
        self.mask = np.zeros((len(alphabet) + 1, len(units)), np.uint32)
        for j in range(LENGTH):
            for t in range(len(units)):
                if self.codes[t, j]:
                    self.mask[np.searchsorted(alphabet, self.codes[t, j]), t] |= np.uint32(1 << j)
        self.need = np.ceil(SCREEN * self.lengths).astype(np.int64).clip(ORDER)

    def screened(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (unit, landmark) with a long enough common subsequence."""
        at = np.searchsorted(self.alphabet, c).clip(0, len(self.alphabet) - 1)
        at[self.alphabet[at] != c] = len(self.alphabet)
        v = np.full((len(c), len(self.units)), 0xFFFFFFFF, np.uint32)
        for j in range(LENGTH):
            m = self.mask[at[:, j]]
            u = v & m
            v = (v + u) | (v - u)
        lcs = np.bitwise_count(~v & ((np.uint32(1) << self.lengths.astype(np.uint32)) - np.uint32(1)))
        return np.nonzero(lcs >= self.need)

    def features(self, c: np.ndarray) -> np.ndarray:
        """(n, m) normalised kernel values."""
        out = np.zeros((len(c), len(self.units)), np.float32)
        for s in range(0, len(c), 8_000):
            part = c[s:s + 8_000]
            u, t = self.screened(part)
            if not len(u):
                continue
            own, back = np.unique(u, return_inverse=True)
            norm = self_kernel(part[own])
            for i in range(0, len(u), 4_000):
                k = kernel_pairs(part[u[i:i + 4_000]], self.codes[t[i:i + 4_000]])
                out[s + u[i:i + 4_000], t[i:i + 4_000]] = k / np.sqrt(norm[back[i:i + 4_000]] * self.self_k[t[i:i + 4_000]] + 1e-30)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton's method in the primal:
    each step solves for the rows within the margin."""
    z = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    reg = np.diag(np.r_[np.ones(x.shape[1]), 1e-3])

    def loss(w):
        return w @ reg @ w / 2 + (weight * np.maximum(0, 1 - y * (z @ w)) ** 2).sum()

    w = np.zeros(z.shape[1])
    for _ in range(steps):
        on = y * (z @ w) < 1
        a = z[on] * weight[on, None]
        step = np.linalg.solve(reg + 2 * a.T @ z[on], 2 * a.T @ y[on]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if size <= 1e-4 or np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


class Model:
    """Values of units and scores of texts."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.slope, self.shift = 4.0, 0.0
        self.seen: dict[str, float] = {}
        self.held = 0  # characters of the words in seen

    def __getstate__(self):
        return self.__dict__ | {"seen": {}, "held": 0}

    def values(self, units: list[str]) -> np.ndarray:
        return self.landmarks.features(codes(units)[0]) @ self.weights + self.bias

    def learn(self, words: set[str]) -> None:
        """All of ``words`` are in ``seen`` afterwards."""
        if len(self.seen) > KEEP or self.held > KEEP_CHARS:
            self.seen.clear()
            self.held = 0
        new = [w for w in words if w not in self.seen]
        self.held += sum(map(len, new))
        self.seen.update((w, self.bias) for w in new)
        for parts in batched(((w, p) for w in new for p in windows(w)), 50_000):
            for (w, _), v in zip(parts, self.values([p for _, p in parts])):
                if v > self.seen[w]:
                    self.seen[w] = float(v)

    def raw(self, word_lists: list[list[str]]) -> np.ndarray:
        """Value of each text, given as its distinct words."""
        self.learn({w for ws in word_lists for w in ws})
        get, out = self.seen.__getitem__, np.full(len(word_lists), self.bias)
        for i, ws in enumerate(word_lists):
            if ws:
                v = sorted(map(get, ws))[-2:]
                out[i] = 0.5 * v[-1] + 0.5 * sum(v) / len(v)
        return out

    def scores(self, word_lists: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(word_lists) + self.shift, -30, 30)))


def reasons(toxic_docs: list[np.ndarray], clean: np.ndarray, n_clean: int) -> np.ndarray:
    """Greedy cover: the units that explain the toxic documents (each given as
    the numbers of its units), most first. A unit counts only in documents
    that none before it explains, so those that come along with an insult, as
    in copies of one document, are not taken."""
    chosen = np.zeros(len(clean), bool)
    left = np.ones(len(toxic_docs), bool)
    pairs_d = np.repeat(np.arange(len(toxic_docs)), [len(d) for d in toxic_docs])
    pairs_u = np.concatenate([*toxic_docs, np.zeros(0, np.int64)]).astype(np.int64)
    expected = clean * len(toxic_docs) / max(1, n_clean)
    while left.any():
        gain = np.bincount(pairs_u[left[pairs_d]], minlength=len(clean))
        lead = np.where(chosen, -1.0, (gain - expected) / np.sqrt(gain + expected + 1))
        lead[gain < 6 * expected] = -1.0
        best = int(lead.argmax())
        if lead[best] < 1.15:  # two documents, none expected
            break
        chosen[best] = True
        left[pairs_d[pairs_u == best]] = False
    # further units that come along with many different sets of those: no copies
    kinds = [hash(tuple(np.sort(d[chosen[d]]))) for d in toxic_docs]
    kind = np.unique(np.array(kinds, np.int64), return_inverse=True)[1] if kinds else np.zeros(0, np.int64)
    width = int(kind.max(initial=0)) + 1
    seen = np.unique(pairs_u * width + kind[pairs_d]) // width
    spread = np.bincount(seen, minlength=len(clean))
    return chosen | (spread >= 6 * expected) & ((spread - expected) / np.sqrt(spread + expected + 1) >= 2.6)


def learn(units: list[str], toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, toxic_docs: list[np.ndarray],
          rounds: int = 3) -> Model:
    """A model from units, the numbers of toxic and clean documents that have
    them in a sentence, and the units of each toxic document. A third of the
    landmarks are frequent harmless units."""
    expected = clean * n_toxic / max(1, n_clean)
    positive = reasons(toxic_docs, clean, n_clean)
    order = np.argsort(-toxic * positive, kind="stable")
    marks = [units[i] for i in order if positive[i]][:LANDMARKS * 2 // 3]
    common = [units[i] for i in np.argsort(-clean, kind="stable") if not positive[i] and len(units[i]) >= 5]
    landmarks = Landmarks([*marks, *common[:LANDMARKS - len(marks)]])
    k = landmarks.features(codes(units)[0]).astype(np.float64)
    own = landmarks.features(landmarks.codes).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    white = vectors / np.sqrt(np.maximum(values, FLOOR)) @ vectors.T
    x = k @ white
    for _ in range(rounds):
        y = np.where(positive, 1.0, -1.0)
        support = 1 + np.log1p(np.where(positive, toxic, clean))
        weight = COST * support * np.where(positive, min(20.0, support[~positive].sum() / max(1.0, support[positive].sum())), 1.0)
        w, b = fit_svm(x, y, weight)
        positive = positive | (x @ w + b > 0) & (toxic >= 2) & (toxic >= 6 * expected)
    return Model(landmarks, (white @ w).astype(np.float64), b)


def calibrate(model: Model, raw: np.ndarray, toxic: np.ndarray) -> None:
    """Logistic fit of the documents' values, each label with equal weight."""
    weight = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic != 1).sum()))
    a, b = 1.0, 0.0
    goal = np.where(toxic == 1, 0.995, 0.005)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, h = weight * (p - goal), weight * p * (1 - p)
        z = np.stack([raw, np.ones_like(raw)])
        step = np.linalg.solve((z * h) @ z.T + 1e-4 * np.eye(2), z @ g + 1e-4 * np.array([a - 1, b]))
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    model.slope, model.shift = float(max(a, 1e-3)), float(b)


# ------------------------------------------------------------------- Spark
def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def training_ids(labels: DataFrame, label: str, usable: Column, per_label: int) -> DataFrame:
    """(doc_id, y): at most ``per_label`` usable ids of each label."""
    rows = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).alias("y"))
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = [rows.filter(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    return pick[0].unionByName(pick[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic") -> Model | None:
    """Fit on labelled documents; None without toxic or without clean ones."""
    # at most 2 * MAX_DOCS rows of 12 bytes
    ids = F.broadcast(training_ids(labels, label, usable, MAX_DOCS))
    rows = docs.select("doc_id", "text").join(ids, "doc_id").select("y", "text")

    def take(it):
        """(y, words of the sentences) of each document."""
        def got(b):
            for y, t in zip(b.column(0).to_pylist(), b.column(1)):
                words = {w for s in _SENTENCE.split(t.as_py() or "") for w in units_of(s)}
                yield y, sorted(p for w in words for p in windows(w))

        out = pa.schema([("y", pa.int32()), ("units", pa.list_(pa.string()))])
        for b in it:
            yield from batches(got(b), out, 256)

    found = rows.withColumn("y", F.col("y").cast("int")).mapInArrow(take, "y int, units array<string>").persist()
    n = {r["y"]: r["n"] for r in found.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        found.unpersist()
        return None
    each = found.select("y", F.explode(F.array_distinct("units")).alias("unit"))
    counts = each.groupBy("unit").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    # the units that lead most among toxic documents, and any others by hash
    lead = (F.col("toxic") - F.col("clean") * (n[1] / n[0])) / F.sqrt(F.col("toxic") + F.col("clean") * (n[1] / n[0]) + 1)
    top = counts.orderBy(lead.desc(), "unit").limit(MAX_UNITS // 2)
    often = counts.orderBy(F.col("clean").desc(), "unit").limit(MAX_UNITS // 4)
    others = counts.orderBy(F.xxhash64("unit"), "unit").limit(MAX_UNITS // 4)
    picked = {r["unit"]: (r["toxic"], r["clean"]) for df in (top, often, others) for r in df.collect()}

    # which of these units the toxic documents have: at most MAX_DOCS rows
    asked = docs.sparkSession.sparkContext.broadcast(frozenset(picked))

    def among(it):
        for b in it:
            got = [[u for u in set(us) if u in asked.value] for us in b.column(1).to_pylist()]
            yield pa.record_batch([pa.array(got, pa.list_(pa.string()))], names=["units"])

    toxic_docs = [r["units"] for r in found.filter("y = 1").mapInArrow(among, "units array<string>").collect()]

    def fit() -> Model:
        units = sorted(picked)
        at, c = {u: i for i, u in enumerate(units)}, np.array([picked[u] for u in units], float)
        return learn(units, c[:, 0], c[:, 1], n[1], n[0], [np.array([at[u] for u in us], np.int64) for us in toxic_docs])

    model = fit()
    for _ in range(MINING):
        # the harmless units that come nearest to the toxic ones join the training
        near = _unit_values(counts.filter(lead < 1.5), model).filter(F.col("value") > -0.7)
        mined = near.orderBy(F.col("value").desc(), "unit").limit(MAX_UNITS // 4).collect()
        picked.update((r["unit"], (r["toxic"], r["clean"])) for r in mined)
        model = fit()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def values(it):
        for b in it:
            raw = shared.value.raw(b.column(1).to_pylist())
            yield pa.record_batch([b.column(0), pa.array(raw, pa.float64())], names=["y", "raw"])

    # two numbers for each of at most 2 * MAX_DOCS documents
    scored = found.mapInArrow(values, "y int, raw double").collect()
    found.unpersist()
    calibrate(model, np.array([r["raw"] for r in scored]), np.array([r["y"] for r in scored]))
    return model


def _unit_values(counts: DataFrame, model: Model) -> DataFrame:
    """``counts`` (unit, toxic, clean) with each unit's value."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            v = shared.value.values(b.column(0).to_pylist()) if b.num_rows else np.zeros(0)
            yield pa.record_batch([*b.columns, pa.array(v, pa.float64())], names=["unit", "toxic", "clean", "value"])

    return counts.select("unit", "toxic", "clean").mapInArrow(run, "unit string, toxic long, clean long, value double")


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without its text, with ``out`` from 0 to 1."""
    docs = docs.drop(out)
    keep = [f for f in docs.schema if f.name != text]
    if model is None:
        return docs.drop(text).withColumn(out, F.lit(0.5))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*keep, T.StructField(out, T.DoubleType())])

    def run(it):
        model = _worker_model(shared)
        for b in it:
            texts = b.column(b.schema.names.index(text))
            got, group, held = [], [], 0
            for i in range(b.num_rows):
                t = texts[i].as_py() or ""
                group.append(units_of(t))
                held += len(t)
                if held >= 4 << 20:
                    got.append(model.scores(group))
                    group, held = [], 0
            if group:
                got.append(model.scores(group))
            others = [(f.name, b.column(i)) for i, f in enumerate(b.schema) if f.name != text]
            yield pa.record_batch([*(c for _, c in others), pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())],
                                  names=[*(n for n, _ in others), out])

    return docs.mapInArrow(run, schema)


_MODELS: dict = {}


def _worker_model(shared):
    """One model for all tasks of a Python worker, with the units it knows."""
    key = shared._path if hasattr(shared, "_path") else id(shared)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = shared.value
    return _MODELS[key]


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels, fold("doc_id", 3) != 1)
    got = score(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
