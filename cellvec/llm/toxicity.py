"""Toxic texts by compression distance.

Two zstandard dictionaries are trained on whole texts, one of each label: the ordinary one by
zstandard's own trainer on windows of ordinary texts; the toxic one by the same kind of greedy cover,
over runs of RUN bytes weighted by how much larger a share of toxic texts than of ordinary ones holds
them, or than texts of their length would hold (runs whose shares differ by fewer than SURE standard
errors weigh nothing). A cover by plain
frequency fills both dictionaries with the language's common words, and their distance tells little
(AUC of 0.62 in cross-validation on the training labels of sf0.1, where this one has 0.94). Many of its
runs are weak, save a little in any text and so hide what a single strong word saves; its strong
segments are a third dictionary, of their own.

Every window of a text is compressed without a dictionary and with each. What each dictionary saves
gives a text's features: the most, the three most and the mean that either toxic one saves in a window,
and the mean of the ordinary one. A logistic curve over these, which toxic savings
raise and ordinary ones lower, fitted to labelled texts that the dictionaries did not see, calibrates
the score. All settings were chosen by cross-validation on
training labels.

The model is fitted on a bounded sample: at most ``per_class`` texts of either label, least hash
of doc_id first, whole; of very long texts fewer, as a label's texts end with the one that passes
``per_class`` times SAMPLE_CHARS characters. Scores read whole texts. Null text counts as empty; an
empty text saves nothing. Labels of null, and doc_ids without label, are not used; of several labels
of a doc_id the largest counts. One text of either label is enough: a label's only text serves the
dictionaries and the weights. With no labelled text of one kind the score is 0 or 1, as most labels
are, or 0 without labels. Repeated rows each get a score. A long text needs twice its size in memory.
Extra columns are ignored, or kept where the pipeline filters; empty table: no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .memory import release

WINDOW = 256
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 1_024
RUN, SEGMENT, SURE = 6, 12, 4.0
#: Segments that weigh at least this part of the best one's weight are strong.
STRONG = 0.25
#: Places of toxic texts that may enter the dictionary.
CANDIDATES = 200_000
PER_CLASS = 3_000
SAMPLE_CHARS = 8_192
THRESHOLD = 0.7
FEATURES = 9
SETTINGS = {"window_log": 12, "chain_log": 12, "hash_log": 12, "search_log": 4, "min_match": 5, "target_length": 32}
STRATEGIES = (zstandard.STRATEGY_DFAST, zstandard.STRATEGY_BTOPT)


def windows(text: str | None) -> list[bytes]:
    b = (text or "").encode("utf-8")
    return [b[i : i + WINDOW] for i in range(0, len(b), WINDOW)]


class Coder:
    """Lengths of windows under a dictionary (none for b""): the shorter of a quick and a thorough parse."""

    def __init__(self, content: bytes):
        self.coders = []
        for strategy in STRATEGIES:
            p = zstandard.ZstdCompressionParameters(**SETTINGS, strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = {}
            if content:
                held["dict_data"] = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held["dict_data"].precompute_compress(compression_params=p)
            self.coders.append(zstandard.ZstdCompressor(compression_params=p, **held))

    def length(self, window: bytes) -> int:
        return min(len(c.compress(window)) for c in self.coders)


def frequent_content(texts: list[str]) -> bytes:
    """Content of zstandard's own dictionary; plain joined windows where there are too few to train on."""
    samples = [w for t in texts for w in windows(t)]
    try:
        return zstandard.train_dictionary(ORDINARY_BYTES, samples, k=64, d=8).as_bytes() if samples else b""
    except zstandard.ZstdError:
        step = -(-sum(map(len, samples)) // ORDINARY_BYTES)  # windows of all the sample
        return b" ".join(samples[:: max(1, step)])


def byte_runs(text: str) -> np.ndarray:
    """The RUN bytes from each byte on, as numbers."""
    b = np.frombuffer(text.encode("utf-8"), np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(b) - RUN + 1), np.uint64)
    for k in range(RUN):
        h = (h << np.uint64(8)) + b[k : k + len(h)]
    return h


def contrasting_content(own: list[str], other: list[str]) -> tuple[bytes, bytes]:
    """Segments of ``own`` that hold the runs whose share of texts most exceeds that of ``other``, each run counted
    once: greedy cover, best segments last, where matches are cheapest. All of them, and the strong ones alone."""
    runs, held = np.unique(np.concatenate([np.unique(byte_runs(t)) for t in own]), return_counts=True)
    if not len(runs):
        return b"", b""
    there = np.zeros(len(runs), np.int64)
    for t in other:
        r = np.unique(byte_runs(t))
        at = np.searchsorted(runs, r)
        at[at == len(runs)] = 0
        there[at[runs[at] == r]] += 1
    p, q = held / len(own), there / max(1, len(other))
    rate = there / max(1, sum(len(t) for t in other))  # longer texts hold more
    q = np.maximum(q, 1 - np.exp(-rate * np.mean([len(t) for t in own])))
    mean = (held + there) / (len(own) + len(other))
    sure = p - q > SURE * np.sqrt(mean * (1 - mean) * (1 / len(own) + 1 / max(1, len(other))))
    runs, weight = runs[sure], (p - q)[sure]
    segments: list[tuple[float, bytes, np.ndarray]] = []
    for t in own:
        r, raw = byte_runs(t), t.encode("utf-8")
        at = np.searchsorted(runs, r)
        at[at == len(runs)] = 0
        hit = runs[at] == r if len(runs) else np.zeros(len(r), bool)
        for s in np.flatnonzero(hit).tolist():
            inside = slice(s, s + SEGMENT - RUN + 1)
            covers = np.unique(at[inside][hit[inside]])
            segments.append((-float(weight[covers].sum()), raw[s : s + SEGMENT], covers))
            if len(segments) > 2 * CANDIDATES:  # the best of all texts so far, whole
                segments = heapq.nsmallest(CANDIDATES, segments, key=lambda x: x[0])
    heap = [(gain, n) for n, (gain, _, _) in enumerate(segments)]
    heapq.heapify(heap)
    out, gains, size = [], [], 0
    while heap and size < TOXIC_BYTES:
        _, n = heapq.heappop(heap)
        gain = -float(weight[segments[n][2]].sum())
        if gain > -1e-9:
            continue
        if heap and gain > heap[0][0]:
            heapq.heappush(heap, (gain, n))
            continue
        out.append(segments[n][1])
        gains.append(gain)
        size += len(out[-1])
        weight[segments[n][2]] = 0
    strong = [x for x, gain in zip(out, gains, strict=True) if gain <= STRONG * gains[0]]
    return b"".join(reversed(out)), b"".join(reversed(strong))


class Scorer:
    """What the dictionaries save in a text's windows, and the score from that."""

    def __init__(self, ordinary: bytes, toxic: bytes, strong: bytes, weights: np.ndarray):
        self.bare, self.ordinary, self.toxic, self.weights = Coder(b""), Coder(ordinary), (Coder(toxic), Coder(strong)), weights

    def saved(self, text: str | None) -> list[float]:
        cut = windows(text)
        if not cut:
            return [0.0] * FEATURES
        bare = [self.bare.length(w) for w in cut]
        per = 1000 / (sum(map(len, cut)) + WINDOW)
        out = []
        for coder in self.toxic:
            toxic = sorted((n - coder.length(w) for n, w in zip(bare, cut, strict=True)), reverse=True)
            out += [toxic[0], sum(toxic[:3]), per * sum(toxic), per * sum(max(0, x - 1) for x in toxic)]
        return [*out, per * (sum(bare) - sum(self.ordinary.length(w) for w in cut))]

    def scores(self, saved: np.ndarray) -> np.ndarray:
        z = self.weights[0] + saved @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (first the constant) by Newton's method on standardised columns."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-9 * np.eye(len(w)), a.T @ (p - y) + keep @ w)
    return np.concatenate(([w[0] - (w[1:] * mean / spread).sum()], w[1:] / spread))


#: What a feature may do to the score: savings of the toxic dictionary raise it, those of the ordinary one lower it.
SIGNS = np.array([1] * 8 + [-1])


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of the right signs: the feature that is wrong by most goes, until none is."""
    used = np.arange(x.shape[1])
    spread = x.std(0) + 1e-9
    while len(used):
        w = logistic(x[:, used], y)
        wrong = w[1:] * SIGNS[used] * spread[used]
        if wrong.min() >= 0:
            break
        used = np.delete(used, wrong.argmin())
    out = np.zeros(1 + x.shape[1])
    if len(used):
        out[0], out[1 + used] = w[0], w[1:]
    else:
        out[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    return out


def fit(toxic: list[str], ordinary: list[str], share: float) -> tuple[bytes, bytes, bytes, np.ndarray]:
    """Dictionaries from two thirds of the sample, weights from the rest at the share of toxic labels."""
    cut = [t for i, t in enumerate(toxic) if i % 3] or toxic, [t for i, t in enumerate(ordinary) if i % 3] or ordinary
    rest = toxic[::3], ordinary[::3]
    held = frequent_content(cut[1]), *contrasting_content(*cut)
    model = Scorer(*held, np.zeros(1 + FEATURES))
    x = np.array([model.saved(t) for part in rest for t in part])
    y = np.repeat([1.0, 0.0], [len(rest[0]), len(rest[1])])
    w = calibrate(x, y)
    even = len(rest[0]) / len(y)
    w[0] += np.log(share / (1 - share)) - np.log(even / (1 - even))
    return *held, w


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS):
    """The model, from rows of ``labels`` (doc_id, toxic); None where a kind has no text, and the share of toxic labels."""
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = shares.get(1, 0) / max(1, sum(shares.values()))
    chosen = [known.filter(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 2 * per_class rows
    rows = docs.select("doc_id", "text").join(ids, "doc_id").filter("text is not null").dropDuplicates(["doc_id", "text"])
    order = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text")
    before = F.coalesce(F.sum(F.char_length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= per_class).withColumn("before", before)  # of each label alike
    rows = rows.filter(F.col("before") < per_class * SAMPLE_CHARS).orderBy("toxic", "place").collect()  # at most 2 * per_class rows
    texts = [[r.text for r in rows if r.toxic == y] for y in (0, 1)]
    del rows
    if not all(texts):
        return None, share
    model = fit(texts[1], texts[0], share)
    del texts
    release()  # of the driver, which has more to do and not much memory
    return model, share


def toxicity_column(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Column:
    """The score of the column ``text`` (0 to 1, higher: more likely toxic), by a model of ``docs`` and ``labels``."""
    model, share = fit_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), per_class)
    if model is None:
        return F.lit(float(share > 0.5))
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*held.value)
        for part in texts:
            yield pd.Series(scorer.scores(np.array([scorer.saved(t) for t in part]).reshape(-1, FEATURES)))
        release()

    return score(F.col("text").cast("string"))


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, score) of every document."""
    return docs.select("doc_id", toxicity_column(spark, docs, labels, per_class).alias("score"))
