"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Words are counted per text in the tasks and summed in Spark. Every word of the vocabulary gets a 64-bit polynomial hash of its code
points, of which the hash of any edit follows in constant time, so edits are never spelt out. Bloom filters of one 64-bit block per key,
one filter per word length, go to the tasks by broadcast; where all filters together pass the bound of a broadcast, they are cut
further and probed in rounds. Only edits whose hash a filter knows are shuffled, as pairs of hashes, to a join with the vocabulary,
and the words met there are compared exactly. An insertion is a deletion seen from the longer word and a replacement is seen from
both words, so deletions and replacements by larger letters find every pair once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import UPPER, Scratch, columns
from plumbline.session import broadcast_bytes

# code points U+00C0 to U+00FF are the bytes C3 80 to C3 BF in UTF-8
LETTER = rb"(?:[a-z]|\xc3[\x80-\xbf])"
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
PIECE = 1 << 20  # bytes of a text that are searched at a time
HELD = 1 << 17  # words a task holds before it hands on their counts

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BITS = 20  # of the filter per word
PROBES = 1 << 19  # edits hashed at a time
SEGMENT = 1 << 16  # blocks of a filter that are packed into one row

VOCABULARY = "word string, n long, size int, key long"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, slip: int = 199) -> DataFrame:
    """``(word, n)``: words of whole texts, lower-cased in A-Z, with at least ``least_length`` code points.

    A run of letters (A-Z, a-z, U+00C0 to U+00FF) loses one letter where ``slip`` divides the crc32 of ``<id>:<run>``: the one at the
    crc32 modulo its length. 0 leaves all runs as they are. Null texts have no words; a null id is written as nothing.
    """
    given = columns(docs, doc_id=doc_id, text=text).where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    return given.mapInArrow(_counter(least_length, slip), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, ratio: int = 5, slip: int = 199) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``: every word of :func:`word_counts` that occurs ``least_count`` times or more.

    Two words are near when one inserted, deleted or replaced code point turns one into the other. ``n_near`` counts a word's near
    words. Its ``form`` is the near word of largest count (ties: the smallest in code-point order) if that count is at least ``ratio``
    times its own; ``form_n`` is that count. Both are null without such a word. ``root`` is the word reached by following forms.
    Repeated rows count as often as they stand there; null and empty texts and an empty table give no words. Other columns are ignored.
    """
    if ratio < 2:
        raise ValueError("a form must occur at least twice as often as its variant")
    with Scratch(docs.sparkSession) as scratch:
        counts = word_counts(docs, doc_id, text, least_length, slip).where(F.col("n") >= least_count)
        words = scratch.keep(counts.mapInArrow(_keys, VOCABULARY))
        pairs = near_words(words, scratch)
        both = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))))
        best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("rank"), F.col("other"))).alias("best"))
        known = words.select("word", "n").join(best, "word", "left")
        fits = -F.col("best.rank") >= ratio * F.col("n")
        known = scratch.keep(
            known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.rank")).alias("form_n"))
        )
        roots = _roots(known, least_count, ratio, scratch)
        found = known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return scratch.keep(found, release=True)


def near_words(words: DataFrame, scratch: Scratch) -> DataFrame:
    """``(a, b, a_n, b_n)``: each pair of near words once. ``words`` is a kept table of ``VOCABULARY``."""
    spark = words.sparkSession
    sizes = {r["size"]: r["n"] for r in words.groupBy("size").agg(F.count("*").alias("n")).collect()}  # as many rows as there are word lengths
    letters = sorted(ord(r[0]) for r in words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect() if r[0])  # at most 26 + 64
    found = []
    for cells in _rounds(sizes, broadcast_bytes(spark)):
        blocks = words.mapInArrow(_marks(cells), "cell string, block long, mask long").groupBy("cell", "block").agg(F.bit_or("mask").alias("mask"))
        packed = blocks.groupBy("cell", F.floor(F.col("block") / SEGMENT).alias("segment")).applyInArrow(_pack, "cell string, segment long, bits binary").collect()
        filters = {name: np.zeros(n, np.uint64) for name, (_, _, _, n) in cells.items()}
        for row in packed:
            start = row["segment"] * SEGMENT
            part = np.frombuffer(row["bits"], np.uint64)
            filters[row["cell"]][start : start + len(part)] = part
        shipped = spark.sparkContext.broadcast(filters)
        found.append(scratch.keep(words.select("word", "size", "key").mapInArrow(_prober(cells, shipped, letters), "a long, b long")))
        shipped.destroy()
    if not found:
        found = [spark.createDataFrame([], "a long, b long")]
    positive = found[0]
    for more in found[1:]:
        positive = positive.unionByName(more)
    x = words.select(F.col("key").alias("a"), F.col("word").alias("a_word"), F.col("n").alias("a_n"))
    y = words.select(F.col("key").alias("b"), F.col("word").alias("b_word"), F.col("n").alias("b_n"))
    joined = positive.join(y, "b").join(x, "a").where(F.levenshtein("a_word", "b_word", 1) == 1)
    return joined.select(F.col("a_word").alias("a"), F.col("b_word").alias("b"), "a_n", "b_n").distinct()


def _roots(known: DataFrame, least_count: int, ratio: int, scratch: Scratch) -> DataFrame:
    """``(word, root)`` of the words with a form. Each round doubles the steps taken; counts grow by ``ratio`` a step, which bounds them."""
    steps = scratch.keep(known.where("form is not null").select("word", F.col("form").alias("root")))
    top = known.agg(F.max("form_n")).first()[0]
    longest = math.ceil(math.log(top / least_count, ratio)) + 1 if top else 0
    for _ in range(max(0, longest - 1).bit_length()):
        beyond = steps.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        steps = scratch.keep(steps.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")))
    return steps


def _rounds(sizes: dict[int, int], bound: int) -> list[dict[str, tuple[int, int, int, int]]]:
    """Filters as ``name: (length, cut, cuts, blocks)``, in groups whose bytes stay within ``bound``."""
    rounds: list[dict[str, tuple[int, int, int, int]]] = []
    room = 0
    for size, n in sorted(sizes.items()):
        blocks = -(-n * BITS // 64)
        cuts = -(-blocks * 8 // max(bound, 8))
        for cut in range(cuts):
            own = -(-blocks // cuts)
            if not rounds or own * 8 > room:
                rounds.append({})
                room = bound
            rounds[-1][f"{size}-{cut}"] = (size, cut, cuts, own)
            room -= own * 8
    return rounds


def _counter(least_length: int, slip: int):
    runs = re.compile(LETTER + rb"{%d,}" % max(1, least_length))
    end = re.compile(rb"[^a-z\x80-\xff]")

    def pieces(text: bytes) -> Iterator[bytes]:
        """The text, cut where no run of letters is."""
        start = 0
        while start < len(text):
            stop = end.search(text, start + PIECE)
            stop = stop.end() if stop else len(text)
            yield text[start:stop]
            start = stop

    def batch_of(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                seed = zlib.crc32(ids[k].as_py().encode() + b":")
                for piece in pieces(texts[k].as_buffer().to_pybytes().translate(LOWER)):
                    for run, n in Counter(runs.findall(piece)).items():
                        if slip:
                            code = zlib.crc32(run, seed)
                            if code % slip == 0:
                                whole = run.decode()
                                at = code % len(whole)
                                whole = whole[:at] + whole[at + 1 :]
                                if len(whole) < least_length:
                                    continue
                                run = whole.encode()
                        held[run] = held.get(run, 0) + n
                    if len(held) > HELD:
                        yield batch_of(held)
                        held = {}
        if held:
            yield batch_of(held)

    return count


def _powers(n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = BASE
        np.multiply.accumulate(out, out=out)
    return out


def _by_size(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, letters)`` for each length: code points as a matrix, all below 256."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, np.frombuffer("".join(words[k] for k in rows).encode("latin-1"), np.uint8).reshape(len(rows), size)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(0).to_pylist()
        if not words:
            continue
        key, size = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int32)
        for rows, letters in _by_size(words):
            size[rows] = letters.shape[1]
            key[rows] = letters.astype(np.uint64) @ _powers(letters.shape[1])
        cells = [batch.column(0), batch.column(1), pa.array(size), pa.array(key.view(np.int64))]
        yield pa.RecordBatch.from_arrays(cells, names=["word", "n", "size", "key"])


def _places(keys: np.ndarray, cuts: int, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(cut, block, mask)`` of every key: the high half of a mixed key gives the place, five times six low bits the mask."""
    x = keys.copy()
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    place = (x >> np.uint64(32)) % np.uint64(cuts * blocks)
    mask = np.zeros_like(x)
    for k in range(5):
        mask |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return place // np.uint64(blocks), place % np.uint64(blocks), mask


def _marks(cells: dict[str, tuple[int, int, int, int]]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            keys = batch.column("key").to_numpy().view(np.uint64)
            for name, (size, cut, cuts, blocks) in cells.items():
                own = keys[sizes == size]
                if len(own):
                    part, block, mask = _places(own, cuts, blocks)
                    inside = part == cut
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * int(inside.sum()), pa.string()), pa.array(block[inside].astype(np.int64)), pa.array(mask[inside].view(np.int64))], names=["cell", "block", "mask"]
                    )

    return mark


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    at = rows["block"].to_numpy() % SEGMENT
    bits = np.zeros(int(at.max()) + 1, np.uint64)
    bits[at] = rows["mask"].to_numpy().view(np.uint64)
    return pa.table({"cell": pa.array([key[0].as_py()]), "segment": pa.array([key[1].as_py()], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def edit_hashes(letters: np.ndarray, key: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, row, hash)`` of all deletions and of all replacements by larger letters, a bounded number at a time."""
    n, size = letters.shape
    powers = _powers(size)
    wide = max(1, PROBES // max(1, len(alphabet)))  # letters looked at in one go
    tall = max(1, wide // size)
    for top in range(0, n, tall):
        part, own = letters[top : top + tall], key[top : top + tall]
        value = part.astype(np.uint64) * powers
        before = np.cumsum(value, axis=1) - value
        for left in range(0, size, wide):
            at = slice(left, min(size, left + wide))
            gone = before[:, at] + (own[:, None] - before[:, at] - value[:, at]) * np.uint64(INVERSE)
            # the same letter twice in a row: either deletion gives the same word
            first = np.ones(gone.shape, dtype=bool)
            first[:, 1:] = part[:, at][:, 1:] != part[:, at][:, :-1]
            row, _ = np.nonzero(first)
            yield size - 1, row + top, gone[first]
            larger = alphabet[None, None, :] > part[:, at, None]
            changed = own[:, None, None] + (alphabet.astype(np.uint64)[None, None, :] - part[:, at, None].astype(np.uint64)) * powers[None, at, None]
            row, _, _ = np.nonzero(larger)
            yield size, row + top, changed[larger]


def _prober(cells: dict[str, tuple[int, int, int, int]], shipped, letters: list[int]):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shipped.value
        by_size: dict[int, list[tuple[str, int, int, int]]] = {}
        for name, (size, cut, cuts, blocks) in cells.items():
            by_size.setdefault(size, []).append((name, cut, cuts, blocks))
        alphabet = np.array(letters, np.uint8)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            keys = batch.column(2).to_numpy().view(np.uint64)
            for rows, matrix in _by_size(words):
                if not (matrix.shape[1] in by_size or matrix.shape[1] - 1 in by_size):
                    continue
                own = keys[rows]
                for size, row, found in edit_hashes(matrix, own, alphabet):
                    for name, cut, cuts, blocks in by_size.get(size, ()):
                        part, block, mask = _places(found, cuts, blocks)
                        bits = filters[name]
                        hit = (bits[block] & mask) == mask
                        if cuts > 1:
                            hit &= part == cut
                        if hit.any():
                            yield pa.RecordBatch.from_arrays([pa.array(own[row[hit]].view(np.int64)), pa.array(found[hit].view(np.int64))], names=["a", "b"])

    return probe
