"""Quality by compression: zstandard dictionaries from good and bad labelled texts.

A text is cut into chunks, so that the dictionary matters to its end, and each chunk is compressed with either dictionary. The difference
of the summed sizes, over the larger of them, is the main feature, beside the smaller size per byte; a logistic curve fitted on texts
that went into no dictionary makes them a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.calibration import fit_logistic, sigmoid
from plumbline.llm.common import columns, crc_mod, freed
from plumbline.llm.sampling import labelled_sample

CHUNK = 2048  # bytes
DICTIONARY = 65_536  # bytes of each dictionary
LEVEL = 3
SAMPLE = 1500  # labelled texts of each class for its dictionary
CALIBRATION = 700  # further texts of each class for the logistic curve
LONGEST = 32_768  # bytes of the longest text in either sample


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slopes: np.ndarray
    offset: float


def chunks(text: bytes | memoryview) -> list:
    return [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]


def build_dictionary(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [c for t in texts for c in chunks(t.encode())]
    total = sum(map(len, parts))
    if len(parts) >= 16 and total > 8192:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, total // 2), parts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass  # all parts alike: nothing to choose from
    return b"".join(parts)[-DICTIONARY:]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=data, **plain)


def features(text: bytes | memoryview, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """``(normalised size difference, the same shrunk for short texts, log of the smaller size per byte)``.

    The difference is positive where the good dictionary helps more; the last number is low for texts that repeat themselves, which
    leave either dictionary little to do.
    """
    parts = chunks(text)
    with_good, with_bad = sum(len(good.compress(c)) for c in parts), sum(len(bad.compress(c)) for c in parts)
    if not parts:
        return 0.0, 0.0, 0.0
    larger, smaller = max(with_good, with_bad), min(with_good, with_bad)
    return (with_bad - with_good) / larger, (with_bad - with_good) / (larger + 64), math.log(smaller / len(text))


def fit_compression(train: list[tuple[str, int]], rest: list[tuple[str, int]], priors: tuple[float, float]) -> CompressionModel:
    """Dictionaries from ``train``, the curve from ``rest``; with one class only, scores are its share among the labels."""
    good, bad = (build_dictionary([t for t, y in train if y == label]) for label in (1, 0))
    pair = compressor(good), compressor(bad)
    found = np.array([features(t.encode(), *pair) for t, _ in rest]).reshape(-1, 3)
    slopes, offset = fit_logistic(found, np.array([y for _, y in rest], dtype=np.int64), priors)
    return CompressionModel(good, bad, slopes, offset)


def quality_score(model: CompressionModel):
    """A column function ``text -> score``: from the whole text; null and empty texts get the curve's value at 0."""
    good_bytes, bad_bytes, slopes, offset = model.good, model.bad, model.slopes, model.offset

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pair = compressor(good_bytes), compressor(bad_bytes)
        for part in parts:
            found = np.array([features(memoryview(t.as_buffer()) if t.is_valid else b"", *pair) for t in part.cast(pa.binary())]).reshape(-1, 3)
            yield pa.array(sigmoid(found @ slopes + offset))

    return F.arrow_udf(freed(run), "double")


def learn_quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, held: int = 0, sample: int = SAMPLE, calibration: int = CALIBRATION, longest: int = LONGEST) -> CompressionModel:
    """Learns from ``labels (doc_id, quality)`` whose ``crc32(doc_id as text) mod modulus`` is not ``held``: at most ``sample`` plus
    ``calibration`` texts of each class, none over ``longest`` bytes, in hash order. Null labels are ignored."""
    rows, priors = labelled_sample(docs, labels, "quality", modulus, held, sample + calibration, longest)
    train, rest = [], []
    for y in (0, 1):
        own = [(t, y) for t, label in rows if label == y]
        cut = len(own) * sample // (sample + calibration)
        train, rest = train + own[:cut], rest + own[cut:]
    return fit_compression(train, rest, priors)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, modulus: int = 5, held: int = 0, **bounds: int) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row per row of ``docs (doc_id, text)``; :func:`learn_quality` says what is learnt from.

    A null id is not held out.
    """
    model = learn_quality(docs, labels, modulus, held, **bounds)
    scored = columns(docs, doc_id="doc_id", text="text").select("doc_id", quality_score(model)("text").alias("score"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
