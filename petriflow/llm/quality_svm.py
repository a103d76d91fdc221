"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of hashed n-grams (bytes and words). They are scaled by the class log-count ratio of naive
Bayes, a linear support-vector machine with squared hinge loss is fitted to them by dual coordinate descent, and its
margins are turned into probabilities by a logistic fit on rows that it did not see.

The fit takes a bounded sample of the labelled rows (``PER_CLASS`` of each class, about, at a rate that the counts of all
labelled rows give); every document is scored over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv
from petriflow.llm.language_id import held_out

#: Sizes of byte and word n-grams, hash buckets, sampled rows of each class (about), and one in how many of them calibrates.
BYTE_SIZES, WORD_SIZES, BUCKETS, PER_CLASS, CALIBRATES = (2, 3, 4), (1, 2), 1 << 16, 3_000, 4
#: The score from which a document counts as good.
GOOD = 0.7


@dataclass
class Model:
    weight: np.ndarray  # by bucket, n-gram ratio included
    bias: float
    slope: float
    offset: float


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """For each text in turn the sorted distinct buckets of its n-grams."""
    n = len(offsets) - 1
    fold = np.arange(256, dtype=np.uint8)
    fold[0x30:0x3A] = 0x30
    x = fold[data].astype(np.uint32)
    grams, starts_of = [], []
    gram = np.zeros(len(x), np.uint32)
    for size in range(1, max(BYTE_SIZES) + 1):
        if len(x) < size:
            break
        gram = gram[: len(x) - size + 1] * np.uint32(0x01000193) + x[size - 1 :] + np.uint32(1)
        if size in BYTE_SIZES:
            h = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            grams.append(((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int32))
            starts_of.append((offsets, size))
    a, b, text = tv.words(data, offsets, tv.SPACED)
    first = np.concatenate([[0], np.cumsum(tv.per_text(text, n))])
    h = tv.word_hashes(data, a, b)
    word_grams, word_cuts = [], []
    for size in WORD_SIZES:
        at, w = tv.windows(h, text, size)
        word_grams.append((tv.mix(w + np.uint64(size)) & np.uint64(BUCKETS - 1)).astype(np.int32))
        word_cuts.append(np.searchsorted(at, first))
    seen = np.zeros(BUCKETS, bool)
    for i in range(n):
        for g, (o, size) in zip(grams, starts_of, strict=True):
            seen[g[o[i] : max(o[i], o[i + 1] - size + 1)]] = True
        for g, c in zip(word_grams, word_cuts, strict=True):
            seen[g[c[i] : c[i + 1]]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found.astype(np.int32)


def log_count_ratio(rows: list[np.ndarray], good: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    """log((p/|p|) / (q/|q|)) for the indicator counts p of good and q of bad rows."""
    counts = np.zeros((2, BUCKETS))
    for x, y in zip(rows, good.tolist(), strict=True):
        counts[int(y), x] += 1
    counts += smoothing
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = 15, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine with squared hinge loss; the bias is a feature of value 1."""
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    soft = 1 / (2 * cost)
    length = np.array([float(v @ v) for v in values]) + 1 + soft
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        largest = 0.0
        for i in draw.permutation(len(rows)).tolist():
            x, v, y = rows[i], values[i], sign[i]
            gradient = y * (float(w[x] @ v) + bias) - 1 + soft[i] * alpha[i]
            if alpha[i] == 0 and gradient >= 0:
                continue
            new = max(alpha[i] - gradient / length[i], 0.0)
            step = (new - alpha[i]) * y
            largest = max(largest, abs(step))
            alpha[i] = new
            w[x] += step * v
            bias += step
        if largest < 1e-3:
            break
    return w, bias


def _logistic(margin: np.ndarray, good: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by Newton steps with a small pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = weight * (p - good), weight * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * margin).sum() + 1e-2 * (a - 1), d.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-2, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        step = np.clip(step, -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [f.astype("<u2").tobytes() for _, data, offsets in tv.blocks(batch.column("text")) for f in features(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("part"), pa.array(packed, pa.binary())], ["good", "part", "grams"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), which the caller has restricted to rows it may learn from.

    Labels other than 0 and 1, null labels and ids, and ids without a document are passed over. With rows of one class only
    (or none) every score is that class's share (or 0.5).
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("good"))
    have = {r["good"]: r["count"] for r in labels.groupBy("good").count().collect()}
    alone = lambda kinds: Model(np.zeros(BUCKETS), 0.0, 1.0, 0.0 if not kinds else (30.0 if 1 in kinds else -30.0))
    if len(have) < 2:
        return alone(have)
    rate = {g: min(1.0, per_class / n) for g, n in have.items()}
    place = F.pmod(F.xxhash64("_id", F.lit(23)), F.lit(1_000_000))
    chosen = labels.where(place < F.when(F.col("good") == 1, rate[1]).otherwise(rate[0]) * 1_000_000)
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(29)), F.lit(CALIBRATES)).cast("int"))
    # About 2 * per_class ids: the sample's bound is this broadcast's.
    sample = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["_id"]).select("doc_id", "good", "part", "text")
    got = sample.select("good", "part", "text").mapInArrow(_featurise, "good int, part int, grams binary").collect()
    got = sorted(((r.good, r.part, bytes(r.grams)) for r in got), key=lambda r: (r[2], r[0]))
    if len(found := {g for g, _, _ in got}) < 2:
        return alone(found)
    rows = [np.frombuffer(g, "<u2").astype(np.int32) for _, _, g in got]
    good, part = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    fit = part != 0
    if len({*good[fit].tolist()}) < 2:
        fit[:] = True
    ratio = log_count_ratio([x for x, f in zip(rows, fit, strict=True) if f], good[fit])
    values = [ratio[x] / max(np.sqrt(len(x)), 1.0) for x in rows]
    index = np.flatnonzero(fit).tolist()
    cost = np.where(good[fit] == 1, 0.5 / max((good[fit] == 1).mean(), 1e-9), 0.5 / max((good[fit] == 0).mean(), 1e-9))
    w, bias = dual_descent([rows[i] for i in index], [values[i] for i in index], np.where(good[fit] == 1, 1.0, -1.0), cost)
    margin = np.array([float(w[x] @ v) + bias for x, v in zip(rows, values, strict=True)])
    held = ~fit if len({*good[~fit].tolist()}) == 2 else fit
    weight = np.where(good == 1, 1 / rate[1], 1 / rate[0])[held]
    slope, offset = _logistic(margin[held], good[held], weight / weight.mean())
    return Model(w * ratio, bias, slope, offset)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score: the probability of a good text, from the text alone. Null counts as the empty text, which has a score too; equal texts have
    equal scores. Columns named like it are replaced, all others kept. A text of n bytes costs about 60 n bytes of memory."""
    kept = [c for c in docs.columns if c == text or c.lower() != "score"]

    def run(names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, data, offsets in tv.blocks(batch.column(len(kept))):
                out += [float(model.weight[x].sum()) / max(np.sqrt(len(x)), 1.0) for x in features(data, offsets)]
            z = np.clip(model.slope * (np.array(out) + model.bias) + model.offset, -30, 30)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], pa.array(1 / (1 + np.exp(-z)), pa.float64())], [*names, "score"])

    return tv.beside(docs, kept, [F.col(tv.quoted(text))], lambda names: partial(run, names), {"score": "double"})


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query: every document's score, learnt from labels of documents that are not held out."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out()))
    out = score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
