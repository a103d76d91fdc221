"""Language identification with error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit predicts whether a text's language has that bit set. The
classifiers are naive Bayes log-odds of hashed byte n-grams, averaged over the text, so they are learnt from counts alone:
a sum per (n-gram bucket, language) in Spark, of fixed size however large the corpus. A text gets the language whose
codeword has the least loss over the bits, each bit weighted by how far its two classes lie apart on the training rows, in deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.llm import textvec as tv

#: N-gram sizes in bytes, hash buckets, the training rows of each language (about), and the lead below which a call is ambiguous.
SIZES, BUCKETS, PER_LANGUAGE, AMBIGUOUS = (1, 2, 3, 4), 1 << 15, 3_000, 0.6
_LETTER = r"\p{L}"
#: N-grams whose log-odds are held at a time.
AT_ONCE = 1 << 16


def codewords(n: int, seed: int = 3, tries: int = 200) -> np.ndarray:
    """An n x bits matrix of -1 and 1. Up to seven languages: all 2^(n-1)-1 splits; more: the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 7:
        rows = [x for x in product((1, -1), repeat=n - 1) if -1 in x]
        return np.array([[1, *x] for x in rows], np.int8).T
    bits, draw, best, most = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed), None, -1
    for _ in range(tries):
        code = draw.choice(np.array([-1, 1], np.int8), (n, bits))
        apart = ((bits - code.astype(int) @ code.T) // 2)[~np.eye(n, dtype=bool)].min()
        if apart > most and (np.abs(code.sum(0)) < n).all():
            best, most = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    odds: np.ndarray  # n-gram buckets x bits
    bias: np.ndarray  # bits
    weight: np.ndarray  # bits; sums to 1
    scale: np.ndarray  # bits: what margin counts as one


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, bucket) of every n-gram of bytes within one text, a size at a time. ASCII is lower-cased, digits are one, white space is one."""
    fold = tv.LOWER.copy()
    fold[0x30:0x3A] = 0x30
    fold[~tv.SPACED] = 0x20
    x = fold[data].astype(np.uint32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    gram = np.zeros(len(x), np.uint32)
    for size in range(1, max(SIZES) + 1):
        n = len(x) - size + 1
        if n <= 0:
            return
        gram = gram[:n] * np.uint32(0x01000193) + x[size - 1 :] + np.uint32(1)
        if size in SIZES:
            h = gram ^ (gram >> np.uint32(15))
            h = h * np.uint32(0x2C1B3C6D)
            place = np.flatnonzero(text[:n] == text[size - 1 :]) if size > 1 else np.arange(n)
            yield place, ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1))[place]


def _counting(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            lang = batch.column("lang").to_numpy(zero_copy_only=False)
            for row, data, offsets in tv.blocks(batch.column("text")):
                of = np.repeat(lang[row : row + len(offsets) - 1], np.diff(offsets)).astype(np.int64)
                for place, bucket in ngrams(data, offsets):
                    counts += np.bincount(of[place] * BUCKETS + bucket, minlength=counts.size).reshape(counts.shape)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array((at // BUCKETS).astype(np.int32)), pa.array((at % BUCKETS).astype(np.int32)), pa.array(counts.ravel()[at])], ["lang", "bucket", "n"])

    return run


def margins(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """Each text's mean log-odds by bit, in units of ``scale``; 0 for an empty text. N-grams are summed ``AT_ONCE`` at a time, so a text of n bytes
    costs about 40 n bytes whatever the number of bits."""
    n, bits = len(offsets) - 1, model.odds.shape[1]
    total, seen = np.zeros((n, bits)), np.zeros(n)
    size = np.diff(offsets)
    for gram, (place, bucket) in zip(SIZES, ngrams(data, offsets), strict=False):
        for low in range(0, len(place), AT_ONCE):
            text = np.searchsorted(offsets, place[low : low + AT_ONCE], "right") - 1
            cuts = np.flatnonzero(np.diff(text, prepend=-1))
            total[text[cuts]] += np.add.reduceat(model.odds[bucket[low : low + AT_ONCE]], cuts, axis=0, dtype=np.float64)
        seen += np.maximum(size - gram + 1, 0)
    return (total / np.maximum(seen, 1)[:, None] + model.bias * (seen > 0)[:, None]) / model.scale


def decode(margin: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language, its probability, whether it is ambiguous) by weighted logistic loss against each codeword; of equal losses the first in order of name."""
    loss = np.stack([(model.weight * np.log1p(np.exp(-np.clip(4 * margin * word, -30, 30)))).sum(1) for word in model.code], axis=1)
    likely = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    likely /= likely.sum(1, keepdims=True)
    best = loss.argmin(1)
    score = likely[np.arange(len(best)), best]
    return best, score, score < AMBIGUOUS


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE) -> Model | None:
    """The model of the labelled rows (null labels aside), or None if there are none.

    About ``per_language`` rows of each language are taken, by a hash of key and text, at a rate that the counts of all rows give, so copies of one
    text are not taken all together; the weights of the bits come from the same rows. The key serves for nothing else. Languages are in sorted order, so equal input gives an equal model.
    """
    rows = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(key, text, F.lit(11)).alias("place"), F.col(text).alias("text"), F.col(lang).cast("string").alias("name"))
    have = {r["name"]: r["count"] for r in rows.groupBy("name").count().collect()}
    if not have:
        return None
    languages = sorted(have)
    spark = rows.sparkSession
    table = spark.createDataFrame([(x, i, min(1.0, per_language / have[x])) for i, x in enumerate(languages)], "name string, lang int, rate double")
    chosen = rows.join(F.broadcast(table), "name").where(F.pmod("place", F.lit(1_000_000)) < F.col("rate") * 1_000_000).select("text", "lang")
    counted = chosen.mapInArrow(_counting(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((len(languages), BUCKETS))
    found = counted.toPandas()  # languages x BUCKETS numbers at most
    counts[found.lang, found.bucket] = found.n
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)
    code = codewords(len(languages))
    bits = code.shape[1]
    odds = np.zeros((BUCKETS, bits), np.float32)
    for b in range(bits):
        one, two = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(one) and len(two):
            odds[:, b] = np.log(one.mean(0)) - np.log(two.mean(0))
    model = Model(languages, code, odds, np.zeros(bits), np.full(bits, 1 / bits), np.ones(bits))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sums over the training rows by language: of margins, of their squares, and of rows.
        out = np.zeros((len(languages), 2 * bits + 1))
        for batch in batches:
            of = batch.column("lang").to_numpy(zero_copy_only=False)
            for row, data, offsets in tv.blocks(batch.column("text")):
                m = margins(data, offsets, model)
                part = np.concatenate([m, m * m, np.ones((len(m), 1))], axis=1)
                np.add.at(out, of[row : row + len(m)], part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(languages), dtype=np.int32)), pa.array(list(out), pa.list_(pa.float64()))], ["lang", "sums"])

    sums = chosen.mapInArrow(measure, "lang int, sums array<double>").select("lang", F.posexplode("sums")).groupBy("lang", "pos").agg(F.sum("col").alias("s")).toPandas()
    out = np.zeros((len(languages), 2 * bits + 1))
    out[sums.lang, sums.pos] = sums.s
    n = np.maximum(out[:, -1:], 1)
    mean, var = out[:, :bits] / n, np.maximum(out[:, bits : 2 * bits] / n - (out[:, :bits] / n) ** 2, 0)
    for b in range(bits):
        up, down = code[:, b] > 0, code[:, b] < 0
        if up.any() and down.any():
            low, high = mean[up, b].min(), mean[down, b].max()
            model.bias[b] = -(low + high) / 2
            model.scale[b] = max(abs(low - high) / 2, 1e-3)
    # A bit's weight: how far its classes lie apart, in deviations.
    model.weight = np.array([model.scale[b] / (np.sqrt(var[:, b].mean()) + 1e-6) for b in range(bits)])
    model.weight /= model.weight.sum()
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous. Null texts, texts without a letter, and any text if there is no model: ``und``, 0, true.

    Only the text is read. The model is shipped with the task; its size does not grow with the data. Columns named like the results are replaced,
    all others kept, whatever their names.
    """
    kept = [c for c in docs.columns if c == text or c.lower() not in ("lang_pred", "score", "ambiguous")]
    n = len(kept)

    def run(names_kept: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letter = batch.column(n + 1).to_numpy(zero_copy_only=False)
            names, scores, doubts = [], [], []
            for row, data, offsets in tv.blocks(batch.column(n), tv.BLOCK // 2):
                many = len(offsets) - 1
                best, score, doubt = decode(margins(data, offsets, model), model) if model else (np.zeros(many, int), np.zeros(many), np.ones(many, bool))
                known = letter[row : row + many] & (model is not None)
                names += [model.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                scores.append(np.where(known, score, 0.0))
                doubts.append(np.where(known, doubt, True))
            made = [pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(doubts) if doubts else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(n)], *made], [*names_kept, "lang_pred", "score", "ambiguous"])

    whole = F.col(tv.quoted(text))
    made = {"lang_pred": "string", "score": "double", "ambiguous": "boolean"}
    return tv.beside(docs, kept, [whole, F.coalesce(whole.rlike(_LETTER), F.lit(False))], lambda names: partial(run, names), made)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text leaves 2 when divided by 4. A null id trains."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_digest(docs: DataFrame) -> DataFrame:
    """The registered query: each document's language, learnt from the rows that are not held out."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
