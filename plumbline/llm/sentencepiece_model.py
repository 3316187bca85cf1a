"""SentencePiece models on the tokenizers library: the protobuf is parsed here and every part is rebuilt.

Both model kinds are covered: unigram (scores are used as they are) and BPE (merges follow from pairs of pieces, in score
order). A text is normalised by the model's character map, blanks become the metaspace marker, and characters outside the vocabulary
fall back to byte pieces if the model has them.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

MARK = "▁"
# fixed values: numbers of the protobuf's enumerations
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    char_map: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int | None:
        return next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), None)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """``(number, value)`` of a protobuf message; nested messages and 32- or 64-bit numbers stay bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def parse(data: bytes) -> Model:
    """Numbers are those of the public SentencePiece schema; absent fields keep the schema's defaults."""
    model = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            model.pieces.append(piece.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", piece.get(2, bytes(4)))[0])
            model.kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
            model.model_type = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.suffix_mark = bool(trainer.get(24, 0))
        elif number == 3:
            normal = dict(_fields(value))
            model.char_map = normal.get(2, b"")
            model.dummy_prefix = bool(normal.get(3, 1))
            model.squeeze = bool(normal.get(4, 1))
            model.escape = bool(normal.get(5, 1))
    if model.model_type not in (UNIGRAM, BPE):
        raise ValueError("word and character models have no subword pieces to rebuild")
    if model.suffix_mark or not model.escape:
        raise ValueError("models that mark blanks behind words, or not at all, are not supported")
    return model


def _merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces to a third, best score first. Of equal scores the longer goes first, so a run grows from its left end."""
    usable = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in usable.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in usable and right in usable:
                found.append((-model.scores[i], -len(piece), i, usable[left], usable[right], (left, right)))
    found.sort()
    return [x[-1] for x in found]


def build(model: Model) -> Tokenizer:
    """A tokenizer whose ids and texts are those of the SentencePiece library for the same model."""
    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    else:
        unk = model.pieces[model.unk_id] if model.unk_id is not None else None
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, _merges(model), unk_token=unk, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps: list = []
    if model.char_map:
        steps.append(normalizers.Precompiled(model.char_map))
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip(left=True, right=True)]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(model.pieces, model.kinds) if k in (NORMAL, USER_DEFINED)):
        # no piece crosses from a word into a blank: words are encoded one by one, and the library can remember them
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tokenizer.add_tokens([AddedToken(p, normalized=False) for p, k in zip(model.pieces, model.kinds) if k == USER_DEFINED])
    back: list = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


def load(path: str) -> Tokenizer:
    with open(path, "rb") as file:
        return build(parse(file.read()))
