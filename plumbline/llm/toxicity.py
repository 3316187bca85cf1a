"""Toxicity from bags of subwords: hashed character n-grams, averaged and put through a linear softmax, trained jointly.

Words share the vectors of the n-grams they share, so a misspelling that was never seen still lands near its word. The
softmax is linear in the average, so after training each n-gram has one number, and any span is scored by its mean.
A document takes the largest mean of its short and of its long windows, turned into a probability by a logistic curve fitted on
documents the vectors have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.calibration import fit_logistic, sigmoid
from plumbline.llm.common import columns, crc_mod, freed
from plumbline.llm.sampling import labelled_sample
from plumbline.llm.shingles import mix, slices

GRAMS = (3, 4, 5)  # bytes of an n-gram; it may hold the blank before or behind its word
BITS = 17
DIM = 8
WINDOWS = (2, 128)  # words; the short one finds a single insult, the long one a tone
LEAST_TEXTS = 8  # n-grams of fewer training texts keep the zero vector
EPOCHS = 8
SAMPLE = 1500  # labelled texts of each class the vectors learn from
CALIBRATION = 700  # further texts of each class for the logistic curve
LONGEST = 32_768  # bytes of the longest text in either sample

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def gram_buckets(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket, word, start of each text's words, number of words)`` of all n-grams of a slice of texts.

    A-Z are lower-cased and blanks made equal. Every word is seen with one blank on either side.
    """
    low = _LOWER[data]
    texts = len(bounds) - 1
    # one blank between texts and at both ends, so that every word is enclosed
    padded = np.full(len(low) + texts + 1, 32, dtype=np.uint8)
    at = np.arange(len(low)) + 1 + np.repeat(np.arange(texts), np.diff(bounds))
    padded[at] = low
    blank = padded == 32
    begins = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    word = np.cumsum(~blank & np.r_[True, blank[:-1]]) - 1
    text_start = bounds[:-1] + np.arange(texts)
    first_word = np.searchsorted(begins, np.r_[text_start, len(padded)])
    inner = np.cumsum(blank)
    buckets, words = [], []
    value = np.zeros(len(padded), dtype=np.uint64)
    code = padded.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            # the n bytes from each place on, as one number
            if len(padded) < n:
                break
            value = (value[: len(padded) - n + 1] << np.uint64(9)) | code[n - 1 :]
            if n not in GRAMS:
                continue
            last = np.arange(n - 1, len(padded))
            # no blank but the first and the last byte
            whole = inner[last - 1] - inner[last - n + 1] == 0
            own = np.flatnonzero(whole)
            middle = own + 1
            buckets.append((mix(value[own] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64))
            words.append(word[middle])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first_word[:-1], np.diff(first_word)
    return np.concatenate(buckets), np.concatenate(words), first_word[:-1], np.diff(first_word)


@dataclass
class SubwordModel:
    weight: np.ndarray  # one number per bucket: what its vector adds to the log odds
    slopes: np.ndarray
    offset: float


def train_vectors(texts: list[str], labels: np.ndarray, seed: int = 0) -> np.ndarray:
    """Log odds per bucket, from vectors and softmax trained together with Adam on cross entropy."""
    bags = []
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        buckets = gram_buckets(data, np.array([0, len(data)]))[0]
        bags.append(np.unique(buckets, return_counts=True))
    seen = np.bincount(np.concatenate([b for b, _ in bags]), minlength=1 << BITS) if bags else np.zeros(1 << BITS, int)
    used = seen >= LEAST_TEXTS
    compact = np.cumsum(used) - 1
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.3, (int(used.sum()) + 1, DIM))
    soft = np.zeros((DIM, 2))
    bias = np.log(np.maximum(np.bincount(labels, minlength=2), 1) / max(1, len(labels)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (vectors, soft, bias)]
    step = 0
    sparse = []
    for b, c in bags:
        keep = used[b]
        sparse.append((compact[b[keep]], c[keep] / max(1, c.sum())))
    for _ in range(EPOCHS):
        order = rng.permutation(len(sparse))
        for start in range(0, len(order), 64):
            batch = order[start : start + 64]
            rows = np.concatenate([sparse[k][0] for k in batch])
            share = np.concatenate([sparse[k][1] for k in batch])
            own = np.repeat(np.arange(len(batch)), [len(sparse[k][0]) for k in batch])
            mean = np.stack([np.bincount(own, share * vectors[rows, d], minlength=len(batch)) for d in range(DIM)], axis=1)
            logits = mean @ soft + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), labels[batch]] -= 1
            p /= len(batch)
            back = p @ soft.T
            grad = np.stack([np.bincount(rows, share * back[own, d], minlength=len(vectors)) for d in range(DIM)], axis=1)
            step += 1
            for parameter, g, (m, v) in zip((vectors, soft, bias), (grad, mean.T @ p, p.sum(axis=0)), state):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                parameter -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    weight = np.zeros(1 << BITS)
    weight[used] = vectors[:-1] @ (soft[:, 1] - soft[:, 0])
    return weight


def window_scores(weight: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the largest mean of a window of each width; texts without words have 0."""
    buckets, word, first, count = gram_buckets(data, bounds)
    n = int(count.sum())
    total = np.r_[0.0, np.cumsum(np.bincount(word, weight[buckets], minlength=n))]
    size = np.r_[0, np.cumsum(np.bincount(word, minlength=n))]
    out = np.zeros((len(count), len(WINDOWS)))
    some = count > 0
    if not some.any():
        return out
    for k, width in enumerate(WINDOWS):
        stride = width // 2
        per_text = np.where(count > width, -(-(count - width) // stride) + 1, some.astype(count.dtype))
        own = np.repeat(np.arange(len(count)), per_text)
        begin = first[own] + stride * (np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        end = np.minimum(begin + width, (first + count)[own])
        begin = np.maximum(np.minimum(begin, end - width), first[own])
        mean = (total[end] - total[begin]) / np.maximum(1, size[end] - size[begin])
        out[some, k] = np.maximum.reduceat(mean, (np.cumsum(per_text) - per_text)[some])
    return out


def fit_toxicity(train: list[tuple[str, int]], rest: list[tuple[str, int]], priors: tuple[float, float], seed: int = 0) -> SubwordModel:
    """Vectors from ``train``, the logistic curve from ``rest``, with classes weighted to their shares among all labels."""
    weight = train_vectors([t for t, _ in train], np.array([y for _, y in train], dtype=np.int64), seed)
    features = np.zeros((len(rest), len(WINDOWS)))
    for k, (text, _) in enumerate(rest):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        features[k] = window_scores(weight, data, np.array([0, len(data)]))[0]
    return SubwordModel(weight, *fit_logistic(features, np.array([y for _, y in rest], dtype=np.int64), priors))


def toxicity_score(model: SubwordModel):
    """A column function ``text -> score``; null and blank texts get the score of a text without evidence."""
    weight, slopes, offset = model.weight.astype(np.float32), model.slopes, model.offset

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = weight.astype(np.float64)
        for part in parts:
            scores = [window_scores(table, data, bounds) for _, _, data, bounds in slices(part)]
            yield pa.array(sigmoid(np.concatenate(scores) @ slopes + offset) if scores else np.zeros(0))

    return F.arrow_udf(freed(run), "double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 4, held: int = 2, sample: int = SAMPLE, calibration: int = CALIBRATION, longest: int = LONGEST) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs (doc_id, text)``, all texts scored whole.

    Learns from ``labels (doc_id, toxic)`` whose ``crc32(doc_id as text) mod modulus`` is not ``held``: at most ``sample`` plus ``calibration``
    texts of each class, none over ``longest`` bytes, in hash order. With one class only, all scores are its share. Null labels
    are ignored; a null id is not held out.
    """
    rows, priors = labelled_sample(docs, labels, "toxic", modulus, held, sample + calibration, longest)
    train, rest = [], []
    for y in (0, 1):
        own = [(t, y) for t, label in rows if label == y]
        cut = max(len(own) * sample // (sample + calibration), 1)
        train, rest = train + own[:cut], rest + own[cut:]
    model = fit_toxicity(train, rest, priors)
    scored = columns(docs, doc_id="doc_id", text="text").select("doc_id", toxicity_score(model)("text").alias("score"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
