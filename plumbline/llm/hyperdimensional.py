"""Language identification with hyperdimensional profiles (Joshi, Halseth and Kanerva, 2016).

Every letter has a random vector of +1 and -1. The vector of a letter n-gram binds (multiplies) those of its letters, each permuted by
its place; a text bundles (adds) the vectors of its n-grams, a language those of its texts. Cosines with
the language prototypes decide. The score then tells whether the text is as close to its language as the language's own texts of that size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import columns, crc_mod, freed
from plumbline.llm.shingles import mix

DIM = 512
GRAM = 3
SAMPLE = 300  # texts of each language a prototype is bundled from
LONGEST = 32_768  # bytes of the longest text in that sample
LONG_CHARS = 1 << 20  # longer texts are counted in parts, each like a text of its own
NONE = "und"
BLOCK = 128  # texts whose n-gram counts are multiplied at once
WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
FAR = 5  # widths below the median at which a language's own texts end; a width is that from the median to the lowest fifth
LEAST_TEXTS = 20  # fewer texts of a size give no floor: that of the next smaller size stands, or none
SIZES = 16  # classes of size, by powers of two

_SEED = np.uint64(0x6C616E67)


def letter_vectors(letters: np.ndarray, dim: int = DIM) -> np.ndarray:
    """+1 and -1 of each code point, from a hash of code point and place: any alphabet, no table."""
    words = -(-dim // 64)
    with np.errstate(over="ignore"):
        bits = mix(mix(letters.astype(np.uint64)[:, None] + _SEED) + np.arange(words, dtype=np.uint64)[None, :])
    flags = np.unpackbits(bits.view(np.uint8), axis=1)[:, :dim]
    return flags.astype(np.float32) * 2 - 1


def gram_vectors(codes: np.ndarray, dim: int = DIM) -> np.ndarray:
    """Bound vectors of n-grams, each packed as three code points of 21 bits."""
    out = np.ones((len(codes), dim), dtype=np.float32)
    for place in range(GRAM):
        letter = (codes >> np.uint64(21 * (GRAM - 1 - place))) & np.uint64(0x1FFFFF)
        own, at = np.unique(letter, return_inverse=True)
        out *= np.roll(letter_vectors(own, dim), GRAM - 1 - place, axis=1)[at]
    return out


def letter_table() -> np.ndarray:
    """Per code point its lower-case letter or a blank, 0 where :func:`folded` has not met it yet."""
    return np.zeros(0x110000, dtype=np.uint32)


def folded(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    found = table[points]
    if not found.all():
        for point in np.unique(points[found == 0]).tolist():
            c = chr(point)
            low = c.lower() if c.isalpha() else " "
            table[point] = ord(low) if len(low) == 1 else point
        found = table[points]
    return found


def gram_counts(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(packed n-grams, counts)`` of the letters of a text; runs of other characters are one blank. No letters: none."""
    if len(text) > LONG_CHARS:
        parts = [gram_counts(text[k : k + LONG_CHARS], table) for k in range(0, len(text), LONG_CHARS)]
        codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
        return codes, np.bincount(at, np.concatenate([n for _, n in parts]), minlength=len(codes))
    points = folded(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), table)
    if not (points != 32).any():
        return np.zeros(0, np.uint64), np.zeros(0)
    points = np.r_[np.uint32(32), points, np.uint32(32)]
    points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]].astype(np.uint64)
    codes = points[: len(points) - 2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
    codes, counts = np.unique(codes, return_counts=True)
    return codes, counts.astype(np.float64)


def excess_symbols(text: str, bag: tuple[np.ndarray, np.ndarray]) -> float:
    """By how many the characters that are neither blanks nor letters exceed the letters; each letter is the middle of one n-gram."""
    codes, counts = bag
    letters = counts[(codes >> np.uint64(21)) & np.uint64(0x1FFFFF) != 32].sum()
    return max(0.0, len(text) - sum(map(text.count, WHITE)) - 2 * letters)


@dataclass
class Profiles:
    languages: list[str]
    vectors: np.ndarray  # unit length, one row per language
    dim: int = DIM
    own: np.ndarray | None = None  # the same with what all languages share
    floors: np.ndarray | None = None  # per language and class of size the least closeness of its own texts


def bundle(bags: list[tuple[np.ndarray, np.ndarray]], dim: int = DIM) -> np.ndarray:
    """Sum of n-gram vectors per text."""
    sizes = [len(c) for c, _ in bags]
    if not sum(sizes):
        return np.zeros((len(bags), dim), dtype=np.float32)
    codes, at = np.unique(np.concatenate([c for c, _ in bags]), return_inverse=True)
    own = np.repeat(np.arange(len(bags)), sizes)
    out = np.zeros((len(bags), dim), dtype=np.float32)
    counts = np.concatenate([n for _, n in bags])
    order = np.argsort(at, kind="stable")
    for k in range(0, len(codes), 4096):
        low, high = np.searchsorted(at[order], [k, k + 4096])
        some = order[low:high]
        table = np.bincount(own[some] * 4096 + at[some] - k, counts[some], minlength=len(bags) * 4096).astype(np.float32).reshape(len(bags), 4096)
        part = codes[k : k + 4096]
        out += table[:, : len(part)] @ gram_vectors(part, dim)
    return out


def distinct(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each n-gram once: a repeated one is no further evidence of a language."""
    return [(codes, np.ones(len(codes))) for codes, _ in bags]


def closeness(once: np.ndarray, sizes: np.ndarray, symbols: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(cosine, class of size)`` of bundles of different n-grams, ``sizes`` of them, with the rows of ``own``.

    A symbol beyond the number of letters counts as one n-gram that no language has.
    """
    length = np.sqrt((once.astype(np.float64) ** 2).sum(axis=1) + symbols * once.shape[1])
    return (once * own).sum(axis=1) / np.maximum(length, 1e-12), np.minimum(np.log2(np.maximum(sizes + symbols, 1)).astype(int), SIZES - 1)


def fit_floors(texts: list[str], total: np.ndarray, table: np.ndarray, dim: int) -> np.ndarray:
    """Least closeness of a language's own texts per class of size, from their first 2, 4, 8, ... characters and the whole.

    ``total`` is the sum of the unit vectors of the texts; each text is taken out of it before it is measured. The floor comes from the
    median and a width, so some junk among the texts does not lower it. Without enough texts there is no evidence against any: -1.
    """
    kept: list[list[float]] = [[] for _ in range(SIZES)]
    for start in range(0, len(texts), BLOCK):
        some = texts[start : start + BLOCK]
        whole = bundle([gram_counts(t, table) for t in some], dim).astype(np.float64)
        rest = total - whole / np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1e-12)
        rest /= np.maximum(np.linalg.norm(rest, axis=1, keepdims=True), 1e-12)
        for k in range(1, SIZES + 1):
            cut = [(i, t[: 1 << k]) for i, t in enumerate(some) if len(t) > 1 << (k - 1)]
            bags = [gram_counts(t, table) for _, t in cut]
            there = [j for j, (codes, _) in enumerate(bags) if len(codes)]
            if there:
                symbols = np.array([excess_symbols(cut[j][1], bags[j]) for j in there])
                once, sizes = bundle(distinct([bags[j] for j in there]), dim), np.array([len(bags[j][0]) for j in there])
                for close, size in zip(*closeness(once, sizes, symbols, rest[[cut[j][0] for j in there]])):
                    kept[size].append(close)
    floors = np.full(SIZES, -1.0)
    for k, values in enumerate(kept):
        if len(values) >= LEAST_TEXTS:
            low, mid = np.quantile(values, [0.2, 0.5])
            floors[k] = max(-1.0, mid - FAR * (mid - low))
        elif k:
            floors[k] = floors[k - 1]
    return floors


def fit_profiles(rows: list[tuple[str, str]], dim: int = DIM) -> Profiles:
    """One prototype per language from ``(language, text)`` rows: the sum of the unit vectors of its texts, minus the mean of all prototypes.

    What all languages share says nothing about any, so their mean is taken off, unless there is only one. It does tell texts of
    these languages from others: the floors are measured with it.
    """
    languages, table = sorted({lang for lang, _ in rows}), letter_table()
    vectors, floors = np.zeros((len(languages), dim)), np.full((len(languages), SIZES), -1.0)
    for k, lang in enumerate(languages):
        texts = [t for own, t in rows if own == lang]
        bags = [gram_counts(t, table) for t in texts]
        for start in range(0, len(bags), BLOCK):
            part = bundle(bags[start : start + BLOCK], dim).astype(np.float64)
            length = np.linalg.norm(part, axis=1)
            vectors[k] += (part[length > 0] / length[length > 0][:, None]).sum(axis=0)
        floors[k] = fit_floors(texts, vectors[k], table, dim)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors = own = np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0)
    if len(languages) > 1:
        vectors = vectors - vectors.mean(axis=0)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, vectors.astype(np.float32), dim, own.astype(np.float32), floors)


def predict(texts: list[str | None], profiles: Profiles, table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """``(language, score)``: the score is 0 for ``und``; ties go to the first language.

    It is 0.5 at the floor of the language for the size of the text, 1 at cosine 1 and 0 at cosine -1: below 0.5 the text is farther
    from its language than nearly all texts that the language was learnt from.
    """
    names, scores = [], np.zeros(len(texts))
    for start in range(0, len(texts), BLOCK):
        some = [t or "" for t in texts[start : start + BLOCK]]
        bags = [gram_counts(t, table) for t in some]
        found, once = np.split(bundle(bags + distinct(bags), profiles.dim), 2)
        cosine = found @ profiles.vectors.T
        if profiles.languages:
            own = np.argmax(cosine, axis=1)
            symbols = np.array([excess_symbols(t, bag) for t, bag in zip(some, bags)])
            close, size = closeness(once, np.array([len(codes) for codes, _ in bags]), symbols, profiles.own[own])
            floor = profiles.floors[own, size]
            rate = np.where(close >= floor, (1 + (close - floor) / np.maximum(1 - floor, 1e-12)) / 2, (1 + close) / np.maximum(1 + floor, 1e-12) / 2)
        for k, (codes, _) in enumerate(bags):
            if not len(codes) or not profiles.languages:
                names.append(NONE)
                continue
            names.append(profiles.languages[own[k]])
            scores[start + k] = min(1.0, max(0.0, float(rate[k])))
    return names, scores


def learn_languages(docs: DataFrame, modulus: int = 3, held: int = 1, sample: int = SAMPLE, longest: int = LONGEST) -> Profiles:
    """Profiles from texts and non-null ``lang`` of rows whose ``crc32(doc_id as text) mod modulus`` is not ``held``.

    At most ``sample`` texts of each language, none over ``longest`` bytes: ids are drawn first, in hash order and without texts. Rows that share an id and a language count as
    one, with the smallest of their texts.
    """
    known = columns(docs, doc_id="doc_id", lang="lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), modulus) != held))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id"))
    drawn = [r["doc_id"] for r in known.withColumn("rank", rank).where(F.col("rank") <= sample).collect()]
    ids = docs.sparkSession.createDataFrame([(x,) for x in sorted(set(drawn))], "doc_id long")
    texts = columns(docs, doc_id="doc_id", lang="lang", text="text").join(F.broadcast(ids), "doc_id").where(F.col("lang").isNotNull() & (F.octet_length("text") <= longest))
    once = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted((r["lang"], r["text"]) for r in once.select("lang", "text").collect())
    return fit_profiles(rows)


def language_of(profiles: Profiles):
    """A column function ``text -> struct(lang_pred, score)``, from the whole text."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = letter_table()
        for part in parts:
            names, scores = [], [np.zeros(0)]
            for start in range(0, len(part), BLOCK):
                some, score = predict(part.slice(start, BLOCK).to_pylist(), profiles, table)
                names += some
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))], names=["lang_pred", "score"])

    return F.arrow_udf(freed(run), "lang_pred string, score double")


def languages(docs: DataFrame, modulus: int = 3, held: int = 1, **bounds: int) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: one row per row of ``docs (doc_id, text, lang)``; :func:`learn_languages` says what is learnt from.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if no language was learnt. A null id is
    not held out.
    """
    profiles = learn_languages(docs, modulus, held, **bounds)
    scored = columns(docs, doc_id="doc_id", text="text").select("doc_id", language_of(profiles)("text").alias("found")).select("doc_id", "found.*")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == held, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
