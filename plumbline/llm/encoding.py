"""Encoding documents with a SentencePiece model through the tokenizers library, and decoding them again."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plumbline.llm.common import columns, freed
from plumbline.llm.sentencepiece_model import MARK, NORMAL, USER_DEFINED, Model, build, parse

PART_ROWS = 256  # rows of a batch that are Python strings at the same time
GROUP_CHARS = 1 << 16  # texts of about this size in all are encoded at once: a token takes over 100 bytes meanwhile
PART_CHARS = 1 << 15  # longer texts are encoded in parts, cut where a word ends


class SentencePieceCodec:
    """Batches of texts to ids and back, with the ids and texts of the SentencePiece library for the same model.

    ``threads`` is the size of the library's thread pool in this process; it holds from the first batch on.
    """

    def __init__(self, path: str, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.path = path
        with open(path, "rb") as file:
            self.model: Model = parse(file.read())
        self.whole: Tokenizer = build(self.model)
        usable = [p for p, k in zip(self.model.pieces, self.model.kinds) if k in (NORMAL, USER_DEFINED)]
        # Marking blanks is the whole normalisation of such models. It is done on the string, and where no piece crosses from a
        # word into a blank, a text is cut into parts instead of words.
        plain = not self.model.char_map and not self.model.squeeze and USER_DEFINED not in self.model.kinds
        self.parts = plain and not any(re.search(f"[^{MARK}]{MARK}", p) for p in usable)
        if self.parts:
            self.bare = Tokenizer(self.whole.model)
        self._other = None

    def _cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = (MARK if self.model.dummy_prefix else "") + text.replace(" ", MARK)
        parts, at = [], 0
        while len(text) - at > PART_CHARS:
            end = at + PART_CHARS
            while True:
                end = text.find(MARK, end)
                if end < 0 or text[end - 1] != MARK:
                    break
                end += 1
            if end < 0:
                break
            parts.append(text[at:end])
            at = end
        return [*parts, text[at:]]

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        if not self.parts:
            return [np.array(e.ids, dtype=np.int32) for e in self.whole.encode_batch_fast(list(texts), add_special_tokens=False)]
        cut = [self._cut(t) for t in texts]
        flat = [p for parts in cut for p in parts]
        done = (np.array(e.ids, dtype=np.int32) for a, b in groups(flat) for e in self.bare.encode_batch_fast(flat[a:b], add_special_tokens=False))
        return [np.concatenate([next(done) for _ in parts]) if parts else np.zeros(0, np.int32) for parts in cut]

    def decode(self, ids: Sequence[np.ndarray | Sequence[int]]) -> list[str]:
        return self.whole.decode_batch([np.asarray(x).tolist() for x in ids], skip_special_tokens=False)

    def normal(self, text: str) -> str:
        """What decoding gives back for ``text``: itself for models that only mark blanks."""
        marked = self.whole.normalizer.normalize_str(text) if not self.parts else MARK * self.model.dummy_prefix + text if text else ""
        plain = marked.replace(MARK, " ")
        return plain[1:] if self.model.dummy_prefix and plain else plain

    def differing(self, texts: Sequence[str], ids: Sequence[Sequence[int]]) -> list[int]:
        """Places where the SentencePiece library itself gives other ids."""
        if self._other is None:
            import sentencepiece

            self._other = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return [k for k, (a, b) in enumerate(zip(self._other.encode(list(texts), num_threads=1), ids)) if np.asarray(b).tolist() != a]


def groups(texts: Sequence[str | None], chars: int = GROUP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``chars`` characters each, or one longer text."""
    first = total = 0
    for k, text in enumerate(texts):
        total += len(text or "")
        if total >= chars:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", threads: int = 2, verify_every: int = 16, restore: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, ids, *keep)``: one row per row of ``docs``; a null text has null ids, an empty one none.

    Of every ``verify_every`` texts one is also encoded by the SentencePiece library, and a difference fails the job (0: none is). With
    ``restore``, a column ``restored`` says whether decoding the ids gives the text back (after the model's own
    normalisation; null for a null text). ``model`` is a path every executor can read. Whole texts are encoded, in parts cut at word ends. Other columns are ignored.
    """
    given = columns(docs, doc_id=doc_id, text=text, **{f"_{c}": c for c in keep})
    fields = [given.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("restored", T.BooleanType())] * restore + [T.StructField(c, given.schema[f"_{c}"].dataType) for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or SentencePieceCodec(model, threads)
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                texts = part.column(1).to_pylist()
                lists: list[np.ndarray | None] = []
                restored: list[bool | None] = []
                for first, end in groups(texts):
                    some = [t or "" for t in texts[first:end]]
                    ids = codec.encode(some)
                    if verify_every and (bad := codec.differing(some[::verify_every], ids[::verify_every])):
                        raise ValueError(f"ids differ from those of the SentencePiece library for {some[bad[0] * verify_every][:200]!r}")
                    if restore:
                        back = codec.decode(ids)
                        restored += [None if t is None else b == codec.normal(t) for t, b in zip(texts[first:end], back)]
                    lists += [None if t is None else x for t, x in zip(texts[first:end], ids)]
                cells = [part.column(0), pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cells + [pa.array(restored, pa.bool_())] * restore + part.columns[2:], names=schema.names)

    return given.mapInArrow(freed(run), schema)


def decode(encoded: DataFrame, model: str, doc_id: str = "doc_id", ids: str = "ids", threads: int = 2) -> DataFrame:
    """``(doc_id, text)`` from ids; null ids give a null text."""
    given = columns(encoded, doc_id=doc_id, ids=ids).select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("doc_id", given.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = None
        for batch in batches:
            codec = codec or SentencePieceCodec(model, threads)
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                lists = part.column(1).to_pylist()
                back = codec.decode([x or [] for x in lists])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else t for x, t in zip(lists, back)], pa.string())], names=schema.names)

    return given.mapInArrow(freed(run), schema)


def encoding_digest(docs: DataFrame, model: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_hash, restored)`` of every document."""
    return encode(docs, model, restore=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"), "restored")
